"""Decoders, encoders and framing."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codec import encode_csv, encode_key_value, object_map
from ..functions.convert import FACILITIES, LEVELS, coded
from ..functions.parse import influx_line, syslog
from ..functions.registry import Value, python
from ..model import LOG, METRIC, TAGS, gauge
from ..operators.routing import project

# ---- decoders: a column of payloads becomes rows ----


def decode_bytes(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn("message", F.col(column).cast("string")).drop(*([column] if column != "message" else []))


def decode_json(df: DataFrame, column: str = "value", schema: str | None = None) -> DataFrame:
    """Objects as rows; an array at the top gives a row for each item. Without a schema the row is a variant named ``event``."""
    text = F.col(column).cast("string")
    if schema:
        one = F.from_json(text, schema)
        many = F.from_json(text, f"array<struct<{schema}>>") if not schema.lower().startswith("array") else one
        rows = F.when(F.ltrim(text).startswith("["), many).otherwise(F.array(one))
        return df.withColumn("_e", F.explode(rows)).select(*[c for c in df.columns if c != column], "_e.*")
    found = F.try_parse_json(text)
    rows = F.when(F.schema_of_variant(found).startswith("ARRAY"), F.from_json(text, "array<variant>")).otherwise(F.array(found))
    return df.withColumn("event", F.explode(rows)).drop(column).filter("event is not null")


def decode_syslog(df: DataFrame, column: str = "value") -> DataFrame:
    x = syslog(F.col(column).cast("string"))
    return df.withColumn("_x", x).select(*[c for c in df.columns if c != column], "_x.*").filter("message is not null")


def decode_gelf(df: DataFrame, column: str = "value", lenient: bool = True) -> DataFrame:
    """version, host, short_message, full_message, ts, level, fields (additional ones, whose names begin with _). Rows that are not valid go."""
    text = F.col(column).cast("string")
    fixed = F.from_json(text, "version string, host string, short_message string, full_message string, timestamp double, level int, facility string, line double, file string")
    every = F.from_json(text, "map<string,string>")
    more = F.map_filter(every, lambda k, _: k.rlike(r"^_[\w.\-]+$") & (k != "_id"))
    out = df.withColumn("_x", fixed).withColumn("_f", F.transform_keys(more, lambda k, _: F.substring(k, 2, 2**31 - 1)))
    good = (F.col("_x.version") == "1.1") & F.col("_x.host").isNotNull() & F.col("_x.short_message").isNotNull()
    ts = F.timestamp_micros((F.col("_x.timestamp") * 1_000_000).cast("bigint"))
    x = lambda n: F.col(f"_x.{n}")
    return out.filter(good).select(*[c for c in df.columns if c != column], x("version"), x("host"), x("short_message").alias("message"), x("full_message"), ts.alias("ts"), x("level"), x("facility"), x("line"), x("file"), F.col("_f").alias("fields"))


def decode_influxdb(df: DataFrame, column: str = "value") -> DataFrame:
    """Gauges from line protocol, one for each numeric field of a line."""
    lines = df.withColumn("_line", F.explode(F.split(F.col(column).cast("string"), "\n"))).filter("trim(_line) != '' and not _line like '#%'")
    found = lines.withColumn("_m", F.explode(python(influx_line, "array<struct<name: string, tags: map<string,string>, value: double, ns: bigint>>", F.col("_line"))))
    m = F.col("_m")
    tags = F.transform_values(m["tags"], lambda _, v: F.array(v)).cast(TAGS)
    return found.select(F.timestamp_micros(F.floor(m["ns"] / 1000)).alias("ts"), F.lit(None).cast("string").alias("namespace"), m["name"].alias("name"), tags.alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), gauge(m["value"]).alias("value"))


def decode_avro(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Needs Spark's Avro module."""
    from pyspark.sql.avro.functions import from_avro

    return df.withColumn("_x", from_avro(F.col(column), schema)).select(*[c for c in df.columns if c != column], "_x.*")


def decode_protobuf(df: DataFrame, desc_file: str, message_type: str, column: str = "value") -> DataFrame:
    """Needs Spark's Protobuf module."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return df.withColumn("_x", from_protobuf(F.col(column), message_type, desc_file)).select(*[c for c in df.columns if c != column], "_x.*")


def decode_native_json(df: DataFrame, column: str = "value", kind: str = "metric") -> DataFrame:
    return df.select(F.from_json(F.col(column).cast("string"), METRIC if kind == "metric" else LOG).alias("_x")).filter("_x is not null").select("_x.*")


def decode_program(df: DataFrame, source: str) -> DataFrame:
    """A program of the remap language as decoder."""
    from ..expr import remap

    return remap(df, source, drop_on_error=True)


_OTLP_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_OTLP_PAIR = f"array<struct<key: string, value: {_OTLP_VALUE}>>"
_OTLP_LOGS = f"resourceLogs array<struct<resource: struct<attributes: {_OTLP_PAIR}>, scopeLogs: array<struct<scope: struct<name: string, version: string>, logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {_OTLP_VALUE}, attributes: {_OTLP_PAIR}, traceId: string, spanId: string, flags: int, droppedAttributesCount: int>>>>>>"


def _otlp_text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _otlp_map(pairs: Column) -> Column:
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), _otlp_text(p["value"]).alias("value"))))


def decode_otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """OTLP logs in JSON: a row for each record, with the attributes of its resource and scope."""
    x = df.select(F.from_json(F.col(column).cast("string"), _OTLP_LOGS).alias("x"))
    res = x.select(F.explode("x.resourceLogs").alias("r"))
    scope = res.select(_otlp_map(F.col("r.resource.attributes")).alias("resources"), F.explode("r.scopeLogs").alias("s"))
    rec = scope.select("resources", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("l"))
    ns = F.col("l.timeUnixNano").cast("bigint")
    return rec.select(F.timestamp_micros(F.floor(ns / 1000)).alias("ts"), ns.alias("ts_ns"), _otlp_text(F.col("l.body")).alias("message"), F.col("l.severityText").alias("severity_text"), F.col("l.severityNumber").alias("severity_number"), _otlp_map(F.col("l.attributes")).alias("attributes"), "resources", "scope", F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"))


# ---- encoders: rows become a column of texts ----


def _row(df: DataFrame) -> Value:
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return Value(whole, df.schema)


def encode_json(df: DataFrame, name: str = "value", pretty: bool = False, **projection) -> DataFrame:
    df = project(df, **projection)
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(pretty).lower(), "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}).alias(name))


def encode_logfmt(df: DataFrame, name: str = "value", **projection) -> DataFrame:
    df = project(df, **projection)
    return df.select(encode_key_value(_row(df)).alias(name))


def encode_csv_rows(df: DataFrame, fields: Sequence[str], delimiter: str = ",", name: str = "value") -> DataFrame:
    """The fields in order; one that is missing is empty."""
    cells = F.array(*[F.col(f).cast("string") if f in df.columns else F.lit("") for f in fields])
    return df.select(encode_csv(cells, delimiter).alias(name))


def encode_text(df: DataFrame, message: str = "message", name: str = "value") -> DataFrame:
    return df.select(F.coalesce(F.col(message).cast("string"), F.lit("")).alias(name))


def encode_gelf(df: DataFrame, host: str = "host", message: str = "message", time_col: str = "ts", name: str = "value") -> DataFrame:
    """Version 1.1; other columns become additional fields."""
    fixed = {"version": F.lit("1.1"), "host": F.col(host), "short_message": F.col(message), "timestamp": F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6}
    known = {host, message, time_col}
    same = ("level", "full_message", "facility", "line", "file")
    more = {c if c in same or c.startswith("_") else f"_{c}": F.col(c) for c in df.columns if c not in known}
    return df.select(F.to_json(F.struct(*[v.alias(k) for k, v in (fixed | more).items()])).alias(name))


def encode_cef(df: DataFrame, vendor: str, product: str, version: str, event_class: str, name_field: str, severity: Column | int = 5, extensions: dict[str, str] | None = None, name: str = "value") -> DataFrame:
    """CEF 0: a header of seven parts with ``|`` and ``\\`` escaped, and extensions with ``=`` escaped too."""
    head = lambda c: F.regexp_replace(c.cast("string"), r"([|\\])", r"\\$1")
    ext = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"([=\\])", r"\\$1"), "\n", r"\\n")
    level = F.lit(severity) if isinstance(severity, int) else severity
    pairs = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{k}="), ext(F.col(f)))) for k, f in (extensions or {}).items()]
    parts = [F.lit("CEF:0"), head(F.lit(vendor)), head(F.lit(product)), head(F.lit(version)), head(F.lit(event_class)), head(F.col(name_field)), level.cast("string"), F.concat_ws(" ", *pairs) if pairs else F.lit("")]
    return df.select(F.concat_ws("|", *parts).alias(name))


def encode_syslog(df: DataFrame, rfc: str = "rfc5424", facility: Column | str = "user", severity: Column | str = "info", app_name: str = "-", host: str = "host", message: str = "message", time_col: str = "ts", name: str = "value") -> DataFrame:
    number = lambda names, x: F.lit(names.index(x)) if isinstance(x, str) else F.coalesce(coded(names, x), F.lit(1 if names is FACILITIES else 6))
    pri = F.concat(F.lit("<"), (number(FACILITIES, facility) * 8 + number(LEVELS, severity)).cast("string"), F.lit(">"))
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))
    app = F.lit(app_name) if app_name not in df.columns else dash(F.col(app_name))
    ts = F.col(time_col).cast("timestamp")
    if rfc == "rfc3164":
        line = F.concat(pri, F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss "), dash(F.col(host)), F.lit(" "), app, F.lit(": "), F.coalesce(F.col(message), F.lit("")))
    else:
        line = F.concat(pri, F.lit("1 "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" "), dash(F.col(host)), F.lit(" "), app, F.lit(" - - - "), F.coalesce(F.col(message), F.lit("")))
    return df.select(line.alias(name))


def encode_avro(df: DataFrame, schema: str | None = None, name: str = "value") -> DataFrame:
    from pyspark.sql.avro.functions import to_avro

    return df.select((to_avro(F.struct("*"), schema) if schema else to_avro(F.struct("*"))).alias(name))


def encode_protobuf(df: DataFrame, desc_file: str, message_type: str, name: str = "value") -> DataFrame:
    from pyspark.sql.protobuf.functions import to_protobuf

    return df.select(to_protobuf(F.struct("*"), message_type, desc_file).alias(name))


def encode_arrow(df: DataFrame, name: str = "value") -> DataFrame:
    """Each batch as an Arrow stream of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({name: [sink.getvalue().to_pybytes()]})

    return df.mapInArrow(run, f"{name} binary")


def metric_text(metrics: DataFrame, name: str = "value") -> DataFrame:
    """Metrics as lines: time, namespace and name, tags, kind and value."""
    v = F.col("value")
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit('="'), F.element_at(e["value"], -1), F.lit('"'))), ",")
    sign = F.when(F.col("kind") == "absolute", "=").otherwise("+")
    value = F.when(v["type"].isin("counter", "gauge"), v["value"].cast("string")).when(v["type"] == "set", F.array_join(v["members"], " ")).otherwise(F.concat(v["type"], F.lit(" "), F.to_json(v)))
    full = F.concat_ws("_", "namespace", "name")
    return metrics.select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(full, F.lit("{"), tags, F.lit("}")), sign, value).alias(name))


# ---- framing ----


def split_frames(df: DataFrame, framing: str = "newline_delimited", column: str = "value", delimiter: str = "\n", max_length: int | None = None) -> DataFrame:
    """Payloads cut to frames; frames longer than ``max_length`` go."""
    c = F.col(column)
    if framing == "bytes":
        frames = F.array(c)
    elif framing in ("newline_delimited", "character_delimited"):
        text = c.cast("string")
        cut = "\r?\n" if framing == "newline_delimited" else re.escape(delimiter)
        frames = F.filter(F.split(text, cut, -1), lambda x: x != "")
    elif framing in ("length_delimited", "varint_length_delimited", "octet_counting"):
        cutter = {"length_delimited": cut_lengths, "varint_length_delimited": cut_varints, "octet_counting": cut_octets}[framing]
        frames = python(lambda x: cutter(x.encode() if isinstance(x, str) else bytes(x)), "array<binary>", c)
    else:
        raise ValueError(f"{framing} is no framing")
    out = df.withColumn(column, F.explode(frames))
    return out if max_length is None else out.filter(F.octet_length(column) <= max_length)


def cut_lengths(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def cut_varints(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = shift = 0
        while at < len(data):
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        if at + n > len(data):
            break
        out.append(data[at : at + n])
        at += n
    return out


def cut_octets(data: bytes) -> list[bytes]:
    """Frames with their length in digits before them, or ended by a new line."""
    out, at = [], 0
    while at < len(data):
        m = re.compile(rb"(\d{1,9}) ").match(data, at)
        if m:
            end = m.end() + int(m[1])
            out.append(data[m.end() : end])
        else:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end + 1
            if line := data[at:end].rstrip(b"\n"):
                out.append(line)
        at = end
    return out


def framed(df: DataFrame, framing: str = "newline_delimited", column: str = "value") -> Column:
    """The column of frames as they go out."""
    c = F.col(column)
    if framing == "bytes":
        return c
    if framing == "newline_delimited":
        return F.concat(c.cast("string"), F.lit("\n"))
    if framing == "length_delimited":
        return F.concat(F.to_binary(F.lpad(F.hex(F.octet_length(c)), 8, "0"), F.lit("hex")), c.cast("binary"))
    raise ValueError(f"{framing} is no framing for output")


def gelf_chunks(payload: bytes, number: int, size: int = 8192) -> list[bytes]:
    """A payload cut to chunks with the format's twelve-byte header."""
    if len(payload) <= size:
        return [payload]
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    if len(parts) > 128:
        raise ValueError("a message has 128 chunks at most")
    return [b"\x1e\x0f" + number.to_bytes(8, "big") + bytes([i, len(parts)]) + p for i, p in enumerate(parts)]


def joined_chunks(df: DataFrame, column: str = "value") -> DataFrame:
    """Whole messages from chunks; those of which a chunk lacks go. Payloads that are no chunks pass."""
    c = F.col(column)
    chunk = F.hex(F.substring(c, 1, 2)) == "1E0F"
    byte = lambda at: F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("int")
    parts = df.filter(chunk).select(F.hex(F.substring(c, 3, 8)).alias("id"), byte(11).alias("i"), byte(12).alias("n"), F.substring(c, 13, 2**31 - 1).alias("part"))
    whole = parts.dropDuplicates(["id", "i"]).groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "part"))).alias("p"))
    made = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    return df.filter(~F.coalesce(chunk, F.lit(False))).select(column).unionByName(whole.filter(F.size("p") == F.col("n")).select(made.alias(column)))


def payload_object(df: DataFrame) -> Column:
    """A whole row as a map of texts."""
    return object_map(_row(df))

