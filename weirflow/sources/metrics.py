"""Metric texts: statsd lines, the exposition format, status pages of servers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.registry import python
from ..model import TAGS, canonical, counter, gauge, value_of
from ..operators.statistics import DEFAULT_BUCKETS

# ---- statsd ----

_STATSD = r"^([^:|]+):([^|]*)\|(ms|[cghsd])((?:\|[^|]*)*)$"


def parse_statsd(df: DataFrame, column: str = "value", ts: Column | None = None, sanitize: bool = True) -> DataFrame:
    """Metrics from lines ``name:value|type|@rate|#tags``; lines that can't be read go.

    Counters are scaled by 1 / rate; times become seconds; h, d and ms are samples; a gauge with a sign is incremental.
    """
    lines = df.select(F.explode(F.split(F.col(column).cast("string"), "\n")).alias("_l")).filter(F.col("_l").rlike(_STATSD))
    g = lambda i: F.regexp_extract("_l", _STATSD, i)
    text, kind, rest = g(2), g(3), g(4)
    rate = F.coalesce(F.nullif(F.regexp_extract(rest, r"\|@([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0))
    rate = F.when(rate > 0, rate).otherwise(1.0)
    tags = F.filter(F.split(F.regexp_extract(rest, r"\|#([^|]*)", 1), ","), lambda t: t != "")
    pairs = F.transform(tags, lambda t: F.struct(F.substring_index(t, ":", 1).alias("key"), F.when(t.contains(":"), F.regexp_replace(t, "^[^:]*:", "")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    tag_map = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]).alias("value")))).cast(TAGS)
    number = text.try_cast("double")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(g(1), r"\s+", "_"), "/", "-"), r"[^A-Za-z0-9_.-]", "") if sanitize else g(1)
    sample = lambda v: value_of("distribution", samples=F.array(F.struct(v.alias("value"), F.round(1 / rate).cast("bigint").alias("rate"))), statistic=F.when(kind == "d", "summary").otherwise("histogram"))
    value = F.when(kind == "c", counter(number / rate)).when(kind == "g", gauge(number)).when(kind == "s", value_of("set", members=F.array(text))).when(kind == "ms", sample(number / 1000)).otherwise(sample(number))
    made = lines.select(
        (F.current_timestamp() if ts is None else ts).alias("ts"), F.lit(None).cast("string").alias("namespace"), name.alias("name"), tag_map.alias("tags"),
        F.when((kind == "g") & ~text.rlike("^[+-]"), "absolute").otherwise("incremental").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), value.alias("value"),
        (number.isNotNull() | (kind == "s")).alias("_good"),
    )
    return made.filter("_good").drop("_good")


def encode_statsd(metrics: DataFrame, name: str = "value") -> DataFrame:
    """A line for each metric, and for each sample or member of one."""
    v = F.col("value")
    tags = F.array_join(F.flatten(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.transform(e["value"], lambda x: F.when(x.isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit(":"), x))))), ",")
    full, tail = F.concat_ws(".", "namespace", "name"), F.when(F.size("tags") > 0, F.concat(F.lit("|#"), tags)).otherwise("")
    signed = lambda x: F.when((F.col("kind") == "incremental") & (x >= 0), F.concat(F.lit("+"), _plain(x))).otherwise(_plain(x))
    sampled = F.transform(v["samples"], lambda s: F.concat(full, F.lit(":"), _plain(s["value"]), F.when(v["statistic"] == "histogram", "|h").otherwise("|d"), F.when(s["rate"] > 1, F.concat(F.lit("|@"), (1 / s["rate"]).cast("string"))).otherwise(""), tail))
    lines = (
        F.when(v["type"] == "counter", F.array(F.concat(full, F.lit(":"), _plain(v["value"]), F.lit("|c"), tail)))
        .when(v["type"] == "gauge", F.array(F.concat(full, F.lit(":"), signed(v["value"]), F.lit("|g"), tail)))
        .when(v["type"] == "set", F.transform(v["members"], lambda m: F.concat(full, F.lit(":"), m, F.lit("|s"), tail)))
        .when(v["type"] == "distribution", sampled)
    )
    return metrics.select(F.explode(lines).alias(name))


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


# ---- exposition format ----

_LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{((?:[^"{}]|"(?:[^"\\]|\\.)*")*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$'
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def exposition_samples(df: DataFrame, column: str = "value") -> DataFrame:
    """family types and samples of each payload: payload id, name, labels, number, ts; a family's type comes from its TYPE line."""
    rows = df.withColumn("_p", F.monotonically_increasing_id()).select("_p", F.posexplode(F.split(F.col(column).cast("string"), "\r?\n")).alias("_i", "_l"))
    kinds = rows.filter(F.col("_l").startswith("# TYPE ")).select("_p", F.regexp_extract("_l", r"^# TYPE (\S+) (\S+)", 1).alias("family"), F.regexp_extract("_l", r"^# TYPE (\S+) (\S+)", 2).alias("type"))
    g = lambda i: F.regexp_extract("_l", _LINE, i)
    number = F.when(g(3).isin("+Inf", "Inf"), float("inf")).when(g(3) == "-Inf", float("-inf")).otherwise(g(3).try_cast("double"))
    entries = F.transform(F.regexp_extract_all(g(2), F.lit(_LABEL), F.lit(0)), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.replace(F.replace(F.regexp_replace(F.regexp_extract(x, r'(?s)^[^=]*=\s*"(.*)"$', 1), r'\\(["\\])', "$1"), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")).alias("value")))
    samples = rows.filter(F.col("_l").rlike(_LINE) & ~F.col("_l").startswith("#")).select("_p", "_i", g(1).alias("name"), F.map_from_entries(entries).alias("labels"), number.alias("number"), F.timestamp_millis(F.nullif(g(4), F.lit("")).cast("bigint")).alias("ts")).filter("number is not null")
    family = F.regexp_replace("name", "_(bucket|sum|count|total)$", "")
    own = kinds.select(F.col("_p").alias("_q"), F.col("family").alias("_f"), "type")
    exact = samples.join(own, (F.col("_p") == F.col("_q")) & (F.col("name") == F.col("_f")), "left").drop("_q", "_f")
    base = kinds.select(F.col("_p").alias("_q"), F.col("family").alias("_f"), F.col("type").alias("_t"))
    both = exact.join(base, (F.col("_p") == F.col("_q")) & (family == F.col("_f")), "left")
    grouped = F.col("_t").isin("histogram", "summary")
    return both.select("_p", "_i", "name", F.when(grouped, F.col("_f")).otherwise(F.col("name")).alias("family"), F.coalesce("type", F.when(grouped, F.col("_t")), F.lit("untyped")).alias("type"), "labels", "number", "ts")


def parse_exposition(df: DataFrame, column: str = "value", namespace: str | None = None) -> DataFrame:
    """Absolute metrics from texts in the exposition format: counters, gauges (untyped too), histograms and summaries."""
    s = exposition_samples(df, column)
    tags = lambda drop: F.transform_values(F.map_filter("labels", lambda k, _: ~k.isin(*drop) if drop else F.lit(True)), lambda _, v: F.array(v)).cast(TAGS)
    ns = F.lit(namespace).cast("string")
    row = lambda name, t, v: [F.coalesce("ts", F.current_timestamp()).alias("ts"), ns.alias("namespace"), name.alias("name"), t.alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), v.alias("value")]
    plain = s.filter(~F.col("type").isin("histogram", "summary")).select(*row(F.col("name"), tags(()), F.when(F.col("type") == "counter", counter(F.col("number"))).otherwise(gauge(F.col("number")))))
    many = s.filter(F.col("type").isin("histogram", "summary")).withColumn("_tags", canonical(tags(("le", "quantile")))).withColumn("_at", F.coalesce(F.unix_millis("ts"), F.lit(-1)))
    ends = lambda x: F.max(F.when(F.col("name") == F.concat("family", F.lit(x)), F.col("number")))
    le = F.try_element_at("labels", F.lit("le"))
    bound = F.when(le.isin("+Inf", "Inf"), float("inf")).otherwise(le.try_cast("double"))
    q = F.try_element_at("labels", F.lit("quantile")).try_cast("double")
    bucket = F.when(bound.isNotNull() & F.col("name").endswith("_bucket"), F.struct(bound.alias("upper_limit"), F.col("number").cast("bigint").alias("count")))
    quantile = F.when(q.isNotNull(), F.struct(q.alias("quantile"), F.col("number").alias("value")))
    found = many.groupBy("_p", "family", "type", "_tags", "_at").agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(bucket)).alias("b"), F.array_sort(F.collect_list(quantile)).alias("q"), ends("_sum").alias("total"), ends("_count").alias("n"))
    # the text has counts up to each bound; a histogram has counts of its own for each bucket
    finite = F.filter("b", lambda x: x["upper_limit"] != float("inf"))
    apart = F.transform(finite, lambda x, i: F.struct(x["upper_limit"].alias("upper_limit"), (x["count"] - F.coalesce(F.get(finite, i - 1)["count"], F.lit(0))).alias("count")))
    count = F.coalesce(F.col("n").cast("bigint"), F.element_at(F.transform("b", lambda x: x["count"]), -1))
    v = F.when(F.col("type") == "histogram", value_of("histogram", buckets=apart, count=count, sum=F.col("total"))).otherwise(value_of("summary", quantiles=F.col("q"), count=F.col("n").cast("bigint"), sum=F.col("total")))
    return plain.unionByName(found.select(*row(F.col("family"), F.map_from_entries("_tags").cast(TAGS), v)))


def encode_exposition(metrics: DataFrame, order: Sequence[str] = ("ts",), name: str = "value") -> DataFrame:
    """Lines of the exposition format for the last value of each series: family, place and line, TYPE lines first."""
    last = metrics.withColumn("_tags", canonical("tags")).groupBy("namespace", "name", "_tags").agg(F.max_by(F.struct("value"), F.struct(*order)).alias("_m")).select("namespace", "name", "_tags", "_m.value")
    v, full = F.col("value"), F.concat_ws("_", "namespace", "name")
    label = lambda k, x: F.concat(k, F.lit('="'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    own = F.transform("_tags", lambda e: label(e["key"], F.coalesce(F.element_at(e["value"], -1), F.lit(""))))
    braces = lambda more: F.when(F.size(F.concat(own, more)) > 0, F.concat(F.lit("{"), F.array_join(F.concat(own, more), ","), F.lit("}"))).otherwise("")
    none = F.array().cast("array<string>")
    line = lambda suffix, more, x: F.concat(full, F.lit(suffix), braces(more), F.lit(" "), _plain(x))
    upto = lambda i: F.aggregate(F.slice(v["buckets"], F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b["count"])
    buckets = F.transform(v["buckets"], lambda b, i: line("_bucket", F.array(F.concat(F.lit('le="'), _plain(b["upper_limit"]), F.lit('"'))), upto(i)))
    inf = line("_bucket", F.array(F.lit('le="+Inf"')), v["count"])
    ends = F.array(line("_sum", none, v["sum"]), line("_count", none, v["count"]))
    quantiles = F.transform(v["quantiles"], lambda q: line("", F.array(F.concat(F.lit('quantile="'), q["quantile"].cast("string"), F.lit('"'))), q["value"]))
    lines = (
        F.when(v["type"].isin("counter", "gauge"), F.array(line("", none, v["value"])))
        .when(v["type"] == "set", F.array(line("", none, F.size(v["members"]))))
        .when(v["type"] == "histogram", F.concat(buckets, F.array(inf), ends)).when(v["type"] == "summary", F.concat(quantiles, ends))
    )
    kind = F.when(v["type"] == "set", "gauge").otherwise(v["type"])
    rows = last.select(full.alias("family"), "_tags", kind.alias("type"), F.posexplode(lines).alias("place", "line"))
    body = rows.select("family", F.lit(1).alias("part"), F.to_json("_tags").alias("series"), "place", F.col("line").alias(name))
    heads = rows.select("family", "type").distinct().select("family", F.lit(0).alias("part"), F.lit("").alias("series"), F.lit(0).alias("place"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "type").alias(name))
    return heads.unionByName(body)


def prepared_for_exposition(metrics: DataFrame, bounds: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    from ..operators.statistics import to_histogram

    return to_histogram(metrics, bounds)


def summed_pushes(metrics: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """What a push gateway holds: counters and histograms summed over pushes, the last of all else."""
    from ..operators.aggregate import summed

    df = metrics.withColumn("_tags", canonical("tags")).withColumn("_type", F.col("value.type"))
    adds = df.filter(F.col("_type").isin("counter", "histogram")).withColumn("kind", F.lit("absolute"))
    by = ["namespace", "name", "_tags", "kind", "_type"]
    columns = ["ts", "namespace", "name", "tags", "kind", "value"]
    last = df.filter(~F.col("_type").isin("counter", "histogram")).withColumn("_r", F.row_number().over(Window.partitionBy("namespace", "name", "_tags").orderBy(*[F.desc(c) for c in order]))).filter("_r = 1")
    return summed(adds, by).select(*columns).unionByName(last.select(*columns))


# ---- status pages ----


def _gauges(df: DataFrame, pairs: Column, ts: Column, namespace: str, tags: dict[str, Column] | None = None) -> DataFrame:
    """A metric for each (name, kind, number) of an array."""
    own = F.create_map(*[x for k, v in (tags or {}).items() for x in (F.lit(k), F.array(v))]).cast(TAGS) if tags else F.create_map().cast(TAGS)
    x = F.col("_x")
    made = df.select("*", F.explode(pairs).alias("_x")).filter("_x.number is not null")
    return made.select(ts.alias("ts"), F.lit(namespace).alias("namespace"), x["name"].alias("name"), own.alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), F.when(x["kind"] == "counter", counter(x["number"])).otherwise(gauge(x["number"])).alias("value"))


def _pair(name: str, kind: str, number: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), number.cast("double").alias("number"))


def parse_nginx_status(df: DataFrame, column: str = "value", namespace: str = "nginx", endpoint: str = "") -> DataFrame:
    """Metrics from a basic status page."""
    c = F.col(column).cast("string")
    one = lambda rx, i=1: F.nullif(F.regexp_extract(c, rx, i), F.lit("")).try_cast("double")
    totals = r"\n\s*(\d+)\s+(\d+)\s+(\d+)"
    pairs = F.array(
        _pair("connections_active", "gauge", one(r"Active connections:\s+(\d+)")), _pair("connections_accepted_total", "counter", one(totals, 1)), _pair("connections_handled_total", "counter", one(totals, 2)),
        _pair("http_requests_total", "counter", one(totals, 3)), _pair("connections_reading", "gauge", one(r"Reading:\s+(\d+)")), _pair("connections_writing", "gauge", one(r"Writing:\s+(\d+)")), _pair("connections_waiting", "gauge", one(r"Waiting:\s+(\d+)")),
    )
    return _gauges(df, pairs, F.current_timestamp(), namespace, {"endpoint": F.lit(endpoint)})


#: States of a server's scoreboard by their letters.
SCOREBOARD = {"_": "waiting", "S": "starting", "R": "reading", "W": "sending", "K": "keepalive", "D": "dnslookup", "C": "closing", "L": "logging", "G": "finishing", "I": "idle_cleanup", ".": "open"}


def parse_apache_status(df: DataFrame, column: str = "value", namespace: str = "apache", endpoint: str = "") -> DataFrame:
    """Metrics from a machine-readable status page, with the workers of each state."""
    c = F.col(column).cast("string")
    one = lambda key: F.nullif(F.regexp_extract(c, rf"(?m)^{re.escape(key)}: ([0-9.]+)", 1), F.lit("")).try_cast("double")
    pairs = [
        _pair("access_total", "counter", one("Total Accesses")), _pair("sent_bytes_total", "counter", one("Total kBytes") * 1024), _pair("duration_seconds_total", "counter", one("Total Duration") / 1000), _pair("uptime_seconds_total", "counter", one("ServerUptimeSeconds")),
        _pair("workers_busy", "gauge", one("BusyWorkers")), _pair("workers_idle", "gauge", one("IdleWorkers")), _pair("connections", "gauge", one("ConnsTotal")), _pair("cpu_load", "gauge", one("CPULoad")),
    ]
    board = F.regexp_extract(c, r"(?m)^Scoreboard: (\S+)", 1)
    pairs += [_pair(f"scoreboard_{state}", "gauge", F.when(board != "", F.length(board) - F.length(F.replace(board, F.lit(letter), F.lit(""))))) for letter, state in SCOREBOARD.items()]
    return _gauges(df, F.array(*pairs), F.current_timestamp(), namespace, {"endpoint": F.lit(endpoint)})


def flattened_numbers(df: DataFrame, column: str, namespace: str, counters: str = "(total|count)$") -> DataFrame:
    """Metrics from any JSON text of numbers: a gauge for each number, named by its path; names that fit ``counters`` are counters."""

    def walk(text: str) -> list[dict]:
        import json

        out: list[dict] = []

        def go(x, path: str) -> None:
            if isinstance(x, dict):
                for k, v in x.items():
                    go(v, f"{path}_{k}" if path else k)
            elif isinstance(x, (int, float)) and not isinstance(x, bool):
                out.append({"name": re.sub(r"\W", "_", path), "number": float(x)})

        go(json.loads(text), "")
        return out

    found = df.select(F.explode(python(walk, "array<struct<name: string, number: double>>", F.col(column).cast("string"))).alias("_x"))
    x = F.col("_x")
    return found.select(F.current_timestamp().alias("ts"), F.lit(namespace).alias("namespace"), x["name"].alias("name"), F.create_map().cast(TAGS).alias("tags"), F.lit("absolute").alias("kind"), F.lit(None).cast("int").alias("interval_ms"), F.when(x["name"].rlike(counters), counter(x["number"])).otherwise(gauge(x["number"])).alias("value"))
