"""Sources by name: files, streams, generators and polled endpoints as DataFrames."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..model import TAGS, gauge
from . import codecs, metrics

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(*names: str):
    def wrap(f):
        for n in names:
            SOURCES[n] = f
        return f

    return wrap


def read(spark: SparkSession, type: str, **options) -> DataFrame:
    """The DataFrame of a source; an error lists the known ones."""
    if type not in SOURCES:
        raise ValueError(f"{type} is no source; there are {sorted(SOURCES)}")
    return SOURCES[type](spark, **options)


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


@source("file", "aws_s3", "stdin", "file_descriptor")
def files(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False, format: str = "text", max_files: int | None = None, schema: str | None = None, **options) -> DataFrame:
    """Lines of files by glob, with file and modification time. Streams keep their place in the query's checkpoint."""
    paths = [include] if isinstance(include, str) else list(include)
    r = _reader(spark, streaming).format(format).options(**options)
    if schema:
        r = r.schema(schema)
    if streaming and max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(paths[0]) if streaming else r.load(paths)
    if format == "text":
        df = df.select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ts"))
    return df


@source("kafka")
def kafka(spark: SparkSession, bootstrap_servers: str, topics: Sequence[str], streaming: bool = True, **options) -> DataFrame:
    """Needs Spark's Kafka module."""
    r = _reader(spark, streaming).format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true").options(**options)
    return r.load().select(F.col("value").cast("string").alias("message"), F.col("timestamp").alias("ts"), F.col("key").cast("string").alias("message_key"), "topic", "partition", "offset", "headers")


@source("pulsar")
def pulsar(spark: SparkSession, endpoint: str, topic: str, **options) -> DataFrame:
    """Needs the Pulsar connector."""
    return spark.readStream.format("pulsar").option("service.url", endpoint).option("topic", topic).options(**options).load()


@source("socket")
def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.col("value").alias("message"), F.current_timestamp().alias("ts"))


@source("syslog")
def syslog(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False, **options) -> DataFrame:
    return codecs.decode_syslog(files(spark, include, streaming, **options).select(F.col("message").alias("value")))


@source("statsd")
def statsd(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False, **options) -> DataFrame:
    return metrics.parse_statsd(files(spark, include, streaming, **options), "message")


@source("prometheus_scrape", "prometheus_pushgateway")
def exposition(spark: SparkSession, include: Sequence[str] | str, **options) -> DataFrame:
    """Texts of the exposition format, one a file."""
    return metrics.parse_exposition(spark.read.text([include] if isinstance(include, str) else list(include), wholetext=True))


@source("nginx_metrics")
def nginx(spark: SparkSession, include: Sequence[str] | str, **options) -> DataFrame:
    return metrics.parse_nginx_status(spark.read.text(include, wholetext=True), **options)


@source("apache_metrics")
def apache(spark: SparkSession, include: Sequence[str] | str, **options) -> DataFrame:
    return metrics.parse_apache_status(spark.read.text(include, wholetext=True), **options)


@source("eventstoredb_metrics", "aws_ecs_metrics", "mongodb_metrics")
def numbers(spark: SparkSession, include: Sequence[str] | str, namespace: str = "stats") -> DataFrame:
    return metrics.flattened_numbers(spark.read.text(include, wholetext=True), "value", namespace)


@source("postgresql_metrics")
def postgresql(spark: SparkSession, url: str, namespace: str = "postgresql", **options) -> DataFrame:
    """Gauges from the database's own statistics, read by JDBC (the driver must be installed)."""
    stats = spark.read.jdbc(url, "pg_stat_database", properties=options)
    names = [c for c, k in stats.dtypes if k in ("bigint", "double", "int") and c != "datid"]
    pairs = F.array(*[F.struct(F.lit(f"pg_stat_database_{c}").alias("name"), F.col(c).cast("double").alias("number")) for c in names])
    rows = stats.select("datname", F.explode(pairs).alias("x")).filter("x.number is not null")
    return rows.select(F.current_timestamp().alias("ts"), F.lit(namespace).alias("namespace"), F.col("x.name").alias("name"), F.create_map(F.lit("db"), F.array("datname")).cast(TAGS).alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), gauge(F.col("x.number")).alias("value"))


@source("docker_logs")
def docker(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False) -> DataFrame:
    """Files of the json-file driver."""
    shape = "log string, stream string, time timestamp"
    return _reader(spark, streaming).schema(shape).json(include).select(F.rtrim(F.col("log"), F.lit("\n")).alias("message"), "stream", F.col("time").alias("ts"), F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{12,64})[/-]", 1).alias("container_id"))


@source("kubernetes_logs")
def kubernetes(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False, pods: DataFrame | None = None) -> DataFrame:
    """Container logs in the CRI format, with what the path tells of the pod; partial lines are joined. ``pods``: metadata by uid."""
    lines = files(spark, include, streaming)
    rx = r"^(\S+) (stdout|stderr) ([FP]) (.*)$"
    path = r"/([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/(\d+)\.log"
    out = lines.filter(F.col("message").rlike(rx)).select(
        F.regexp_extract("message", rx, 1).try_cast("timestamp").alias("ts"), F.regexp_extract("message", rx, 2).alias("stream"), (F.regexp_extract("message", rx, 3) == "P").alias("partial"), F.regexp_extract("message", rx, 4).alias("message"),
        F.regexp_extract("file", path, 1).alias("pod_namespace"), F.regexp_extract("file", path, 2).alias("pod_name"), F.regexp_extract("file", path, 3).alias("pod_uid"), F.regexp_extract("file", path, 4).alias("container_name"), "file",
    )
    if pods is not None:
        from ..operators.enrich import small

        out = out.join(small(pods), "pod_uid", "left")
    return out


@source("journald")
def journald(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False) -> DataFrame:
    """Exports of the journal in JSON."""
    x = files(spark, include, streaming).select(F.from_json("message", "map<string,string>").alias("f"))
    at = lambda k: F.try_element_at("f", F.lit(k))
    return x.select(F.timestamp_micros(F.coalesce(at("_SOURCE_REALTIME_TIMESTAMP"), at("__REALTIME_TIMESTAMP")).cast("bigint")).alias("ts"), at("_HOSTNAME").alias("host"), at("MESSAGE").alias("message"), at("_SYSTEMD_UNIT").alias("unit"), at("PRIORITY").alias("priority"), F.col("f").alias("fields"))


@source("windows_event_log")
def windows(spark: SparkSession, include: Sequence[str] | str) -> DataFrame:
    """Exports of event logs in XML."""
    return spark.read.format("xml").option("rowTag", "Event").load(include)


@source("http_server", "http", "http_client", "aws_kinesis_firehose", "okta", "splunk_hec", "websocket", "opentelemetry", "internal_logs", "heroku_logs", "fluent", "logstash", "redis", "nats", "mqtt", "amqp", "gcp_pubsub", "aws_sqs", "dnstap")
def landed(spark: SparkSession, include: Sequence[str] | str, streaming: bool = False, decoding: str = "bytes", framing: str | None = None, schema: str | None = None) -> DataFrame:
    """What a receiver outside Spark has landed as files: one payload a line, decoded here."""
    df = files(spark, include, streaming).select(F.col("message").alias("value"))
    if framing:
        df = codecs.split_frames(df, framing)
    return DECODERS[decoding](df, **({"schema": schema} if schema else {}))


#: Decoders by name, each from a column ``value``.
DECODERS: Mapping[str, Callable[..., DataFrame]] = {
    "bytes": codecs.decode_bytes, "json": codecs.decode_json, "syslog": codecs.decode_syslog, "gelf": codecs.decode_gelf, "influxdb": codecs.decode_influxdb,
    "native_json": codecs.decode_native_json, "avro": codecs.decode_avro, "protobuf": codecs.decode_protobuf, "otlp": codecs.decode_otlp_logs,
}


def unnest_firehose(df: DataFrame, column: str = "value") -> DataFrame:
    """Records of delivery requests: request id, time and data, unpacked from base64."""
    x = df.select(F.from_json(F.col(column), "requestId string, timestamp bigint, records array<struct<data: string>>").alias("x"))
    return x.select(F.col("x.requestId").alias("request_id"), F.timestamp_millis("x.timestamp").alias("ts"), F.explode("x.records").alias("r")).select("request_id", "ts", F.unbase64("r.data").cast("string").alias("message"))


@source("demo_logs")
def demo(spark: SparkSession, count: int = 1000, format: str = "shuffle", lines: Sequence[str] = ("started", "stopped"), interval_s: float = 1.0, streaming: bool = False, seed: int = 0, start: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Invented logs, alike on every run: shuffle (given lines), json, apache_common, syslog."""
    if streaming:
        base = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(1 / interval_s))).load().select(F.col("value").alias("id"), F.col("timestamp").alias("ts"))
    else:
        base = spark.range(count).select("id", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("id") * int(interval_s * 1e6))).alias("ts"))
    pick = lambda items, salt: F.get(F.array(*map(F.lit, items)), F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(items))).cast("int"))
    host = F.concat_ws(".", *[F.pmod(F.xxhash64("id", F.lit(seed + 10 + i)), F.lit(256)).cast("string") for i in range(4)])
    method, path, status = pick(("GET", "POST", "PUT", "DELETE"), 1), pick(("/", "/index", "/login", "/search", "/cart"), 2), pick((200, 200, 200, 301, 404, 500), 3)
    size = F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(50_000)).cast("string")
    message = {
        "shuffle": pick(list(lines), 5),
        "json": F.to_json(F.struct(host.alias("host"), method.alias("method"), path.alias("request"), status.alias("status"), size.alias("bytes"))),
        "apache_common": F.concat(host, F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"), F.lit('] "'), method, F.lit(" "), path, F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), size),
        "syslog": F.concat(F.lit("<14>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" "), host, F.lit(" demo "), F.col("id").cast("string"), F.lit(" ID1 - "), pick(list(lines), 6)),
    }
    return base.select("id", "ts", message[format].alias("message"))


@source("static_metrics")
def static(spark: SparkSession, metrics: Sequence[Mapping], namespace: str = "static", streaming: bool = False, interval_s: int = 1) -> DataFrame:
    """Metrics that the configuration states: name, value and tags, all gauges."""
    rows = [F.struct(F.lit(m["name"]).alias("name"), F.lit(float(m["value"])).alias("v"), (F.create_map(*[x for k, v in m.get("tags", {}).items() for x in (F.lit(k), F.array(F.lit(v)))]) if m.get("tags") else F.create_map()).cast(TAGS).alias("tags")) for m in metrics]
    base = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % interval_s == 0).select(F.col("timestamp").alias("ts")) if streaming else spark.range(1).select(F.current_timestamp().alias("ts"))
    x = F.col("x")
    return base.select("ts", F.explode(F.array(*rows)).alias("x")).select("ts", F.lit(namespace).alias("namespace"), x["name"].alias("name"), x["tags"].alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), gauge(x["v"]).alias("value"))


@source("exec")
def executed(spark: SparkSession, command: Sequence[str], timeout_s: float = 30.0, include_stderr: bool = True) -> DataFrame:
    """Lines that a command prints on the driver."""
    done = subprocess.run(list(command), capture_output=True, text=True, timeout=timeout_s)
    rows = [(line, "stdout") for line in done.stdout.splitlines()] + [(line, "stderr") for line in done.stderr.splitlines() if include_stderr]
    return spark.createDataFrame(rows, "message string, stream string").withColumn("ts", F.current_timestamp()).withColumn("command", F.lit(" ".join(command)))


@source("unit_test", "unit_test_stream", "memory")
def rows(spark: SparkSession, events: Sequence[Mapping] | Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(e.values()) if isinstance(e, Mapping) else e for e in events], schema)


class _HostReader(DataSourceReader):
    """One partition a host, read where it runs."""

    def __init__(self, options: Mapping[str, str]):
        self.root = options.get("root", "/proc")

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from host_numbers(self.root)


class _HostStream(SimpleDataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.root, self.pause = options.get("root", "/proc"), float(options.get("interval_s", "1"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        time.sleep(self.pause)
        return iter(list(host_numbers(self.root))), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(host_numbers(self.root)))


class HostMetrics(DataSource):
    """Load, memory, CPU and network numbers of a host, from its /proc."""

    @classmethod
    def name(cls) -> str:
        return "host_metrics"

    def schema(self) -> str:
        return "name string, value double, kind string, tag string, tag_value string"

    def reader(self, schema) -> DataSourceReader:
        return _HostReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _HostStream(self.options)


def host_numbers(root: str = "/proc") -> Iterator[tuple]:
    """name, value, type, tag and its value."""
    text = lambda p: open(os.path.join(root, p)).read() if os.path.exists(os.path.join(root, p)) else ""  # noqa: E731, SIM115
    for name, x in zip(("load1", "load5", "load15"), text("loadavg").split()):
        yield name, float(x), "gauge", None, None
    for line in text("meminfo").splitlines():
        key, _, rest = line.partition(":")
        known = {"MemTotal": "memory_total_bytes", "MemFree": "memory_free_bytes", "MemAvailable": "memory_available_bytes", "Buffers": "memory_buffers_bytes", "Cached": "memory_cached_bytes", "SwapTotal": "memory_swap_total_bytes", "SwapFree": "memory_swap_free_bytes"}
        if key in known:
            yield known[key], float(rest.split()[0]) * 1024, "gauge", None, None
    modes = ("user", "nice", "system", "idle", "io_wait", "irq", "soft_irq", "steal")
    for line in text("stat").splitlines():
        if line.startswith("cpu "):
            for mode, ticks in zip(modes, line.split()[1:]):
                yield "cpu_seconds_total", float(ticks) / 100, "counter", "mode", mode
    for line in text("net/dev").splitlines()[2:]:
        device, _, rest = line.partition(":")
        cells = rest.split()
        if len(cells) >= 9:
            yield "network_receive_bytes_total", float(cells[0]), "counter", "device", device.strip()
            yield "network_transmit_bytes_total", float(cells[8]), "counter", "device", device.strip()
    for line in text("uptime").splitlines():
        yield "uptime", float(line.split()[0]), "gauge", None, None


@source("host_metrics")
def host(spark: SparkSession, streaming: bool = False, namespace: str = "host", **options) -> DataFrame:
    from ..model import counter

    spark.dataSource.register(HostMetrics)
    df = _reader(spark, streaming).format("host_metrics").options(**options).load()
    tags = F.when(F.col("tag").isNotNull(), F.create_map("tag", F.array("tag_value"))).otherwise(F.create_map().cast(TAGS))
    return df.select(F.current_timestamp().alias("ts"), F.lit(namespace).alias("namespace"), "name", tags.alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), F.when(F.col("kind") == "counter", counter(F.col("value"))).otherwise(gauge(F.col("value"))).alias("value"))


@source("internal_metrics")
def internal(spark: SparkSession, queries: Sequence | None = None, namespace: str = "engine") -> DataFrame:
    """Numbers of the running streaming queries, from their progress."""
    out = []
    for q in queries if queries is not None else spark.streams.active:
        p = q.lastProgress
        if p:
            for k in ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "batchId"):
                out.append((k, float(p[k]), str(p["name"] or p["id"])))
    df = spark.createDataFrame(out, "name string, number double, query string")
    return df.select(F.current_timestamp().alias("ts"), F.lit(namespace).alias("namespace"), "name", F.create_map(F.lit("query"), F.array("query")).cast(TAGS).alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), gauge(F.col("number")).alias("value"))


def prometheus_remote_write(df: DataFrame, desc_file: str, column: str = "value") -> DataFrame:
    """Series of remote write requests: needs Spark's Protobuf module and the protocol's descriptor; the payload is unpacked before."""
    x = codecs.decode_protobuf(df, desc_file, "prometheus.WriteRequest", column)
    each = x.select(F.explode("timeseries").alias("t")).select(F.map_from_entries(F.transform("t.labels", lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))).alias("labels"), F.explode("t.samples").alias("s"))
    tags = F.transform_values(F.map_filter("labels", lambda k, _: k != "__name__"), lambda _, v: F.array(v))
    return each.select(F.timestamp_millis("s.timestamp").alias("ts"), F.lit(None).cast("string").alias("namespace"), F.try_element_at("labels", F.lit("__name__")).alias("name"), tags.alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), gauge(F.col("s.value")).alias("value"))


