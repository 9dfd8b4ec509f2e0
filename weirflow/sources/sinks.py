"""Sinks by name: files, tables, and services that take batches of encoded events."""

from __future__ import annotations

import gzip
import json
import socket as _socket
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..template import confined, template
from . import codecs, metrics

# ---- files and tables: Spark's own writers ----

FORMATS = {"text": "text", "json": "json", "ndjson": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "avro": "avro"}


def to_files(df: DataFrame, path: str, format: str = "json", key_prefix: str | None = None, compression: str | None = None, mode: str = "append", max_rows_a_file: int | None = None) -> None:
    """Files under ``path``; with ``key_prefix``, a template, under a folder for each rendered key. Rows whose key has no value go.

    Folders are partitions: each is written by the tasks that hold its rows, so one with a third of all rows is many files.
    """
    columns = df.columns
    if key_prefix:
        df = df.withColumn("key", confined(template(df, key_prefix))).filter("key is not null")
    if format == "text":
        df = df.select(F.coalesce(F.col("message").cast("string"), F.lit("")).alias("value"), *(["key"] if key_prefix else []))
    writer = df.write.mode(mode).format(FORMATS[format])
    if key_prefix and "key" not in columns:
        writer = writer.partitionBy("key")
    for k, v in (("compression", compression), ("maxRecordsPerFile", max_rows_a_file)):
        if v is not None:
            writer = writer.option(k, v)
    writer.save(path)


def to_parquet(df: DataFrame, path: str, schema: str | None = None, mode: str = "relaxed", compression: str = "zstd") -> None:
    """relaxed: the schema's columns, null where missing; strict: an error if a column is missing or over."""
    from pyspark.sql.types import StructType

    if schema:
        wanted = StructType.fromDDL(schema)
        if mode == "strict" and set(wanted.names) != set(df.columns):
            raise ValueError(f"the schema has {wanted.names}, the rows have {df.columns}")
        df = df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])
    df.write.mode("append").option("compression", compression).parquet(path)


def to_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def to_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.mode("append").jdbc(url, table, properties=options)


def to_kafka(df: DataFrame, bootstrap_servers: str, topic: str, key_field: str | None = None, headers_key: str | None = None) -> None:
    """Needs Spark's Kafka module; the topic is a template."""
    rows = df.select(F.to_json(F.struct("*")).alias("value"), template(df, topic).alias("topic"), *([F.col(key_field).cast("string").alias("key")] if key_field else []))
    rows.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).save()


def to_nothing(df: DataFrame) -> None:
    df.write.mode("overwrite").format("noop").save()


def to_console(df: DataFrame, rows: int = 20) -> None:
    for r in codecs.encode_json(df).limit(rows).collect():
        print(r[0])


# ---- request bodies: rows become one text each, batches become bodies ----


@dataclass(frozen=True)
class Shape:
    """How a service takes events: each event's text, how texts make a body, what the request says of it."""

    event: Callable[[DataFrame], Column]
    join: str = "array"  # array, lines, concat, single, wrapped
    path: str = ""
    headers: Mapping[str, str] = field(default_factory=lambda: {"Content-Type": "application/json"})
    wrap: str = "{}"


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def _named(df: DataFrame, **fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _millis(df: DataFrame) -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp")) if "ts" in df.columns else F.unix_millis(F.current_timestamp())


def _message(df: DataFrame) -> Column:
    return F.col("message").cast("string") if "message" in df.columns else _json(df)


def _bulk(df: DataFrame) -> Column:
    return F.concat(F.lit('{"create":{}}\n'), _json(df), F.lit("\n"))


def _hec(df: DataFrame) -> Column:
    own = {"event": F.struct("*"), "time": _millis(df) / 1000}
    if "host" in df.columns:
        own["host"] = F.col("host")
    return _named(df, **own)


def influx_text(df: DataFrame, measurement: str = "logs", tags: Sequence[str] = ()) -> Column:
    """Line protocol of a row: tags and all other columns as fields."""
    escape = lambda c: F.regexp_replace(c, r"([,= ])", r"\\$1")
    kinds = dict(df.dtypes)
    tag = F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{t}="), escape(F.col(t).cast("string"))) for t in tags])
    text = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    one = lambda c: F.concat(F.col(c).cast("string"), F.lit("i")) if kinds[c] in ("bigint", "int") else F.col(c).cast("string") if kinds[c] in ("double", "float", "boolean") else text(c)
    body = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), one(c)) for c in df.columns if c not in (*tags, "ts")])
    return F.concat_ws(" ", tag, body, (_millis(df) * 1_000_000).cast("string"))


def _metric_json(df: DataFrame) -> Column:
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], F.element_at(e["value"], -1)))
    return _named(df, metric=F.concat_ws(".", "namespace", "name"), type=F.when(F.col("value.type") == "counter", "count").otherwise(F.col("value.type")), points=F.array(F.array(_millis(df) / 1000, F.col("value.value"))), tags=tags)


def _metric_influx(df: DataFrame) -> Column:
    escape = lambda c: F.regexp_replace(c, r"([,= ])", r"\\$1")
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit(","), escape(e["key"]), F.lit("="), escape(F.coalesce(F.element_at(e["value"], -1), F.lit(""))))), "")
    return F.concat(escape(F.concat_ws(".", "namespace", "name")), F.concat(F.lit(",metric_type="), F.col("value.type")), tags, F.lit(" value="), F.col("value.value").cast("string"), F.lit(" "), (_millis(df) * 1_000_000).cast("string"))


_TEXT = {"Content-Type": "text/plain"}
_NDJSON = {"Content-Type": "application/x-ndjson"}
#: How each service takes events.
SHAPES: Mapping[str, Shape] = {
    "http": Shape(_json, "lines", headers=_NDJSON),
    "elasticsearch": Shape(_bulk, "concat", "/_bulk", _NDJSON),
    "splunk_hec_logs": Shape(_hec, "concat", "/services/collector/event"),
    "splunk_hec_metrics": Shape(lambda df: _named(df, time=_millis(df) / 1000, event=F.lit("metric"), fields=F.struct(F.concat_ws(".", "namespace", "name").alias("metric_name"), F.col("value.value").alias("_value"))), "concat", "/services/collector"),
    "humio_logs": Shape(_hec, "concat", "/services/collector/event"),
    "humio_metrics": Shape(_hec, "concat", "/services/collector/event"),
    "influxdb_logs": Shape(influx_text, "lines", "/api/v2/write", _TEXT),
    "influxdb_metrics": Shape(_metric_influx, "lines", "/api/v2/write", _TEXT),
    "greptimedb_metrics": Shape(_metric_influx, "lines", "/v1/influxdb/write", _TEXT),
    "greptimedb_logs": Shape(_json, "lines", "/v1/events/logs", _NDJSON),
    "sematext_logs": Shape(_bulk, "concat", "/_bulk", _NDJSON),
    "sematext_metrics": Shape(_metric_influx, "lines", "/write", _TEXT),
    "clickhouse": Shape(_json, "lines", "/?input_format_import_nested_json=1", _NDJSON),
    "databend": Shape(_json, "lines", "/v1/streaming_load", _NDJSON),
    "doris": Shape(_json, "lines", "/_stream_load", _NDJSON),
    "loki": Shape(lambda df: F.to_json(F.array((_millis(df) * 1_000_000).cast("string"), _message(df))), "wrapped", "/loki/api/v1/push", wrap='{{"streams":[{{"stream":{labels},"values":[{events}]}}]}}'),
    "axiom": Shape(_json, "array", "/v1/ingest"),
    "honeycomb": Shape(lambda df: _named(df, time=F.timestamp_millis(_millis(df)), data=F.struct("*")), "array", "/1/batch"),
    "new_relic": Shape(lambda df: _named(df, timestamp=_millis(df), message=_message(df), attributes=F.struct("*")), "array", "/log/v1"),
    "mezmo": Shape(lambda df: _named(df, timestamp=_millis(df), line=_message(df)), "wrapped", "/logs/ingest", wrap='{{"lines":[{events}]}}'),
    "keep": Shape(_json, "array"),
    "appsignal": Shape(_json, "lines", "/events", _NDJSON),
    "logs_intake": Shape(_json, "array", "/api/v2/logs"),
    "events_intake": Shape(_json, "single", "/api/v1/events"),
    "metrics_intake": Shape(_metric_json, "wrapped", "/api/v1/series", wrap='{{"series":[{events}]}}'),
    "traces_intake": Shape(_json, "array", "/api/v0.2/traces"),
    "azure_logs_ingestion": Shape(_json, "array"),
    "gcp_stackdriver_logs": Shape(lambda df: _named(df, jsonPayload=F.struct("*"), timestamp=F.timestamp_millis(_millis(df))), "wrapped", "/v2/entries:write", wrap='{{"entries":[{events}]}}'),
    "gcp_stackdriver_metrics": Shape(_metric_json, "wrapped", wrap='{{"timeSeries":[{events}]}}'),
    "gcp_pubsub": Shape(lambda df: _named(df, data=F.base64(_json(df).cast("binary"))), "wrapped", wrap='{{"messages":[{events}]}}'),
    "gcp_chronicle_unstructured": Shape(lambda df: _named(df, log_text=_message(df)), "wrapped", wrap='{{"entries":[{events}]}}'),
    "aws_kinesis_streams": Shape(lambda df: _named(df, Data=F.base64(_json(df).cast("binary")), PartitionKey=F.md5(_json(df))), "wrapped", wrap='{{"Records":[{events}]}}'),
    "aws_kinesis_firehose": Shape(lambda df: _named(df, Data=F.base64(_json(df).cast("binary"))), "wrapped", wrap='{{"Records":[{events}]}}'),
    "aws_sqs": Shape(lambda df: _named(df, Id=F.md5(_json(df)), MessageBody=_json(df)), "wrapped", wrap='{{"Entries":[{events}]}}'),
    "aws_sns": Shape(lambda df: _named(df, Id=F.md5(_json(df)), Message=_json(df)), "wrapped", wrap='{{"PublishBatchRequestEntries":[{events}]}}'),
    "aws_cloudwatch_logs": Shape(lambda df: _named(df, timestamp=_millis(df), message=_message(df)), "wrapped", wrap='{{"logEvents":[{events}]}}'),
    "aws_cloudwatch_metrics": Shape(_metric_json, "wrapped", wrap='{{"MetricData":[{events}]}}'),
    "papertrail": Shape(lambda df: F.concat(F.lit("<14>1 "), F.date_format(F.timestamp_millis(_millis(df)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" - - - - - "), _message(df)), "lines", headers=_TEXT),
    "opentelemetry": Shape(lambda df: _named(df, timeUnixNano=(_millis(df) * 1_000_000).cast("string"), body=F.struct(_message(df).alias("stringValue"))), "wrapped", "/v1/logs", wrap='{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{events}]}}]}}]}}'),
}


def bodies(events: Iterator[str], shape: Shape, max_events: int = 1000, max_bytes: int = 1_000_000, labels: Mapping[str, str] | None = None) -> Iterator[bytes]:
    """Request bodies from event texts, each within the limits on events and bytes; a larger event makes a body alone."""
    held, size = [], 0

    def made() -> bytes:
        if shape.join == "lines":
            text = "".join(e + "\n" for e in held)
        elif shape.join in ("concat", "single"):
            text = "".join(held)
        elif shape.join == "array":
            text = "[" + ",".join(held) + "]"
        else:
            text = shape.wrap.format(events=",".join(held), labels=json.dumps(dict(labels or {})))
        return text.encode()

    for e in events:
        n = len(e.encode())
        if held and (len(held) >= (1 if shape.join == "single" else max_events) or size + n > max_bytes):
            yield made()
            held, size = [], 0
        held.append(e)
        size += n + 1
    if held:
        yield made()


_PACK: Mapping[str, Callable[[bytes], bytes]] = {"none": lambda b: b, "gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress}


def posted(body: bytes, url: str, headers: Mapping[str, str], method: str = "POST", retries: int = 5, timeout_s: float = 60.0, pause_s: float = 1.0) -> None:
    """One request; what may pass (429, 5xx, no connection) is tried again after growing pauses, then the task fails and Spark runs it anew."""
    for n in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers), method=method), timeout=timeout_s):
                return
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or n == retries:
                raise
        except OSError:
            if n == retries:
                raise
        time.sleep(pause_s * 2**n)


def to_http(df: DataFrame, url: str, type: str = "http", token: str | None = None, compression: str = "none", max_events: int = 1000, max_bytes: int = 1_000_000, headers: Mapping[str, str] | None = None, labels: Mapping[str, str] | None = None, retries: int = 5) -> None:
    """Posts all rows in batches from the tasks that hold them: at least once, as a task that is run again posts again."""
    shape = SHAPES[type]
    said = dict(shape.headers) | dict(headers or {}) | ({"Authorization": f"Bearer {token}"} if token else {}) | ({"Content-Encoding": {"gzip": "gzip", "zlib": "deflate"}[compression]} if compression != "none" else {})
    target = url.rstrip("/") + shape.path
    pack = _PACK[compression]

    def send(rows: Iterator) -> None:
        for body in bodies((r[0] for r in rows), shape, max_events, max_bytes, labels):
            posted(pack(body), target, said, retries=retries)

    df.select(shape.event(df).alias("e")).foreachPartition(send)


def to_socket(df: DataFrame, host: str, port: int, mode: str = "tcp", column: str = "value") -> None:
    """Lines over TCP, or a datagram each over UDP."""

    def send(rows: Iterator) -> None:
        if mode == "udp":
            with _socket.socket(_socket.AF_INET, _socket.SOCK_DGRAM) as s:
                for r in rows:
                    s.sendto(r[0].encode(), (host, port))
        else:
            with _socket.create_connection((host, port), timeout=60) as s:
                for r in rows:
                    s.sendall(r[0].encode() + b"\n")

    df.select(F.col(column).cast("string")).foreachPartition(send)


def to_statsd(df: DataFrame, host: str, port: int, mode: str = "udp") -> None:
    to_socket(metrics.encode_statsd(df), host, port, mode)


def to_redis(df: DataFrame, host: str, port: int, key: str, type: str = "list") -> None:
    """Rows pushed to a list or published to a channel, in the server's own protocol, a pipeline for each 1000 rows."""
    rows = df.select(template(df, key).alias("k"), _json(df).alias("v")).filter("k is not null")
    verb = b"RPUSH" if type == "list" else b"PUBLISH"

    def command(*parts: bytes) -> bytes:
        return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)

    def send(part: Iterator) -> None:
        with _socket.create_connection((host, port), timeout=60) as s, s.makefile("rb") as replies:
            sent = 0
            for r in part:
                s.sendall(command(verb, r[0].encode(), r[1].encode()))
                sent += 1
                if sent == 1000:
                    for _ in range(sent):
                        replies.readline()
                    sent = 0
            for _ in range(sent):
                replies.readline()

    rows.foreachPartition(send)


def to_exposition(df: DataFrame, path: str, order: Sequence[str] = ("ts",)) -> None:
    """The last value of each series as a text that a scraper can read."""
    lines = metrics.encode_exposition(metrics.prepared_for_exposition(df), order)
    lines.orderBy("family", "part", "series", "place").select("value").write.mode("overwrite").text(path)


#: Sinks by name.
SINKS: Mapping[str, Callable[..., None]] = {
    "file": to_files, "aws_s3": to_files, "gcp_cloud_storage": to_files, "azure_blob": to_files, "webhdfs": to_files, "parquet": to_parquet, "table": to_table, "databricks_zerobus": to_table, "postgres": to_jdbc, "kafka": to_kafka,
    "blackhole": to_nothing, "console": to_console, "socket": to_socket, "statsd": to_statsd, "redis": to_redis, "prometheus_exporter": to_exposition,
    **{name: (lambda df, name=name, **o: to_http(df, type=name, **o)) for name in SHAPES},
}


def write(df: DataFrame, type: str, **options) -> None:
    if type not in SINKS:
        raise ValueError(f"{type} is no sink; there are {sorted(SINKS)}")
    SINKS[type](df, **options)
