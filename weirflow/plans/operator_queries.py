"""Queries of conditions, conversions, sources and sinks, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate as agg, convert, enrich, multiline, reduce as red, routing, state, statistics as stats
from ..sources import codecs, metrics as texts, readers, sinks
from .order import own_folder
from .queries import ORDER, _session_sql, counters, events, gauges, query, table

# ---- conditions and search ----


@query("select 'is_log' as name, count(*) as n from events union all select 'always_pass', count(*) from events union all select 'is_metric', 0 union all select 'is_trace', 0 union all select 'always_fail', 0")
def condition_kinds(spark, d):
    parts = [routing.filter_events(events(spark, d), {"type": c}).agg(F.count("*").alias("n")).select(F.lit(c).alias("name"), "n") for c in ("is_log", "is_metric", "is_trace", "always_pass", "always_fail")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select event_id from events where event_type like 'v%w' or event_type like 'e%'")
def search_wildcard(spark, d):
    return routing.filter_events(events(spark, d), {"type": "search", "source": "@event_type:v*w OR @event_type:e*"}).select("event_id")


@query("select event_id from events where props is not null and not event_type = 'click'")
def search_exists(spark, d):
    return routing.filter_events(events(spark, d), {"type": "search", "source": "_exists_:@props AND NOT @event_type:click"}).select("event_id")


@query("select event_id from events")
def search_all(spark, d):
    return routing.filter_events(events(spark, d), {"type": "search", "source": "*:*"}).select("event_id")


@query("select event_id from events where value between 10 and 20 or user_id >= 100")
def search_ranges(spark, d):
    return routing.filter_events(events(spark, d), {"type": "search", "source": "@value:[10 TO 20] OR @user_id:>=100"}).select("event_id")


# ---- sampling, merging, lines ----


@query("select event_id from (select event_id, event_type, row_number() over (order by ts, event_id) as n from events) where event_type = 'error' or (n - 1) % 10 = 0")
def sample_dynamic(spark, d):
    e = events(spark, d).withColumn("own", F.when(F.col("event_type") == "error", 1.0))
    return state.sample(e, rate=10, order=ORDER, ratio_field="own").select("event_id")


@query(_session_sql("ts - pts >= interval 1 day", "arg_min(event_type, (ts, event_id)) as event_type, round(sum(value), 6) as value, string_agg(props, '' order by ts, event_id) as props"))
def reduce_sums(spark, d):
    out = red.reduce(events(spark, d), ["user_id"], ORDER, merge_strategies={"event_type": "discard", "value": "sum", "props": "concat_raw"}, expire_after_ms=86_400_000)
    return out.select("user_id", "event_type", F.round("value", 6).alias("value"), "props")


def _lines_sql(groups: str, key: str) -> str:
    return f"with m as (select *, {groups} from conversations) select conv_id, min(turn) as turn, count(*)::int as lines, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as digest from m group by conv_id, {key}"


def _lines(spark: SparkSession, d: str, start: str, condition: str, mode: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("message"))
    return multiline.join_lines(c, start, condition, mode, ["turn"], ["conv_id"]).select("conv_id", "turn", "lines", F.md5("message").alias("digest"))


_USERS = "sum((role = 'user')::int) over (partition by conv_id order by turn) as k"


@query(_lines_sql(_USERS, "case when k > 0 then k::varchar else '0:' || turn end"))
def multiline_halt_before(spark, d):
    return _lines(spark, d, "^user", "^user", "halt_before")


@query(_lines_sql("coalesce(lag(role) over (partition by conv_id order by turn), '') as before", "turn").replace("with m as (", "with l as (").replace(") select conv_id", "), m as (select *, sum((before <> 'user')::int) over (partition by conv_id order by turn) as k from l) select conv_id", 1).replace("group by conv_id, turn", "group by conv_id, k"))
def multiline_continue_past(spark, d):
    return _lines(spark, d, "^user", "^user", "continue_past")


# ---- enrichment ----


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def enrich_select(spark, d):
    out = enrich.find_records(table(spark, d, "supplier"), table(spark, d, "nation"), {"n_nationkey": F.col("s_nationkey")}, "found", select=["n_name"])
    return out.select("s_suppkey", F.col("found")[0]["n_name"].alias("n_name"))


@query("select s_suppkey from supplier where false")
def enrich_unknown(spark, d):
    return enrich.get_record(table(spark, d, "supplier"), table(spark, d, "nation"), {"n_nationkey": F.lit(-1)}).filter("record is not null").select("s_suppkey")


# ---- metrics ----


@query("select event_id, event_type as name, value from events")
def codec_native_json(spark, d):
    made = gauges(spark, d).withColumn("tags", F.map_concat("tags", F.create_map(F.lit("id"), F.array(F.col("event_id").cast("string")))))
    out = codecs.decode_native_json(made.select(F.to_json(F.struct(*[c for c in made.columns if c != "event_id"])).alias("value")))
    return out.select(F.col("tags")["id"][0].cast("bigint").alias("event_id"), "name", F.col("value.value").alias("value"))


@query("""select time_bucket(interval 1 day, ts) as window_start, count(*) filter (value <= 10) as low, count(*) filter (value > 10 and value <= 25) as middle, count(*) as n, round(sum(value), 4) as total from events group by all""")
def distribution_to_histogram(spark, d):
    made = convert.log_to_metric(events(spark, d), [{"type": "histogram", "field": "value", "name": "v"}])
    out = stats.to_histogram(agg.aggregate(made, 86_400_000, "sum"), [10.0, 25.0])
    b = F.col("value.buckets")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), b[0]["count"].alias("low"), b[1]["count"].alias("middle"), F.col("value.count").alias("n"), F.round("value.sum", 4).alias("total"))


@query("select time_bucket(interval 1 day, ts) as window_start, count(distinct user_id) as members from events group by all")
def metric_sets(spark, d):
    made = convert.log_to_metric(events(spark, d), [{"type": "set", "field": "user_id", "name": "users"}])
    out = agg.aggregate(made, 86_400_000, "sum")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.size("value.members").cast("bigint").alias("members"))


@query("select event_type || '_seen' as name, 'u' || user_id as host, value from events")
def exposition_parse(spark, d):
    text = F.format_string('# TYPE %s_seen gauge\n%s_seen{host="u%d"} %s', "event_type", "event_type", "user_id", F.col("value").cast("string"))
    out = texts.parse_exposition(events(spark, d).select(text.alias("value")))
    return out.select("name", F.col("tags")["host"][0].alias("host"), F.col("value.value").alias("value"))


@query("select event_type as name, user_id::varchar as user, value from events")
def statsd_source(spark, d):
    lines = events(spark, d).select(F.format_string("%s:%s|g|#user:%d", "event_type", F.col("value").cast("string"), "user_id").alias("message"))
    out = readers.read(spark, "statsd", include=_landed(spark, lines, "text"))
    return out.select("name", F.col("tags")["user"][0].alias("user"), F.col("value.value").alias("value"))


# ---- sources and sinks: what a sink writes, a source reads ----


def _landed(spark: SparkSession, df: DataFrame, format: str) -> str:
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    sinks.to_files(df, path, format)
    return path


@query("select event_id, event_type, 'json' as format from events union all select event_id, event_type, 'csv' from events union all select event_id, event_type, 'parquet' from events")
def sink_files(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    parts = [readers.read(spark, "file", include=_landed(spark, e, f), format=f, schema="event_id long, event_type string").withColumn("format", F.lit(f)) for f in ("json", "csv", "parquet")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select event_id, event_type as message from events")
def source_landed_json(spark, d):
    path = _landed(spark, events(spark, d).select("event_id", F.col("event_type").alias("message")), "json")
    return readers.read(spark, "http_server", include=path, decoding="json", schema="event_id long, message string")


@query("select event_id, event_type as message, 'stdout' as stream from events")
def source_docker(spark, d):
    e = events(spark, d)
    rows = e.select(F.concat(F.concat_ws(" ", "event_id", "event_type"), F.lit("\n")).alias("log"), F.lit("stdout").alias("stream"), F.lit("2024-01-01T00:00:00Z").alias("time"))
    out = readers.read(spark, "docker_logs", include=_landed(spark, rows, "json"))
    return out.select(F.split("message", " ")[0].cast("bigint").alias("event_id"), F.split("message", " ")[1].alias("message"), "stream")


@query("select event_id, event_type as message, 'u' || user_id as host, epoch_us(ts) as us from events")
def source_journald(spark, d):
    e = events(spark, d)
    rows = e.select(F.to_json(F.struct(F.concat_ws(" ", "event_id", "event_type").alias("MESSAGE"), F.concat(F.lit("u"), "user_id").alias("_HOSTNAME"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("__REALTIME_TIMESTAMP"))).alias("message"))
    out = readers.read(spark, "journald", include=_landed(spark, rows, "text"))
    return out.select(F.split("message", " ")[0].cast("bigint").alias("event_id"), F.split("message", " ")[1].alias("message"), "host", F.unix_micros("ts").alias("us"))


@query("select event_id, event_type as message, 'u' || user_id as hostname from events")
def source_syslog(spark, d):
    e = events(spark, d).select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.concat_ws(" ", "event_id", "event_type").alias("message"))
    lines = codecs.encode_syslog(e, app_name="app").withColumnRenamed("value", "message")
    out = readers.read(spark, "syslog", include=_landed(spark, lines, "text"))
    return out.select(F.split("message", " ")[0].cast("bigint").alias("event_id"), F.split("message", " ")[1].alias("message"), "hostname")


@query("select event_id, event_type as message, 'stdout' as stream, false as partial from events")
def source_kubernetes(spark, d):
    lines = events(spark, d).select(F.format_string("2024-01-01T00:00:00Z stdout F %d %s", "event_id", "event_type").alias("message"))
    out = readers.read(spark, "kubernetes_logs", include=_landed(spark, lines, "text"))
    return out.select(F.split("message", " ")[0].cast("bigint").alias("event_id"), F.split("message", " ")[1].alias("message"), "stream", "partial")


@query("select 'x' as name, 2::double as value, 1000::bigint as demo")
def source_made(spark, d):
    still = readers.read(spark, "static_metrics", metrics=[{"name": "x", "value": 2, "tags": {"a": "b"}}])
    demo = readers.read(spark, "demo_logs", count=1000, format="json").agg(F.count("*").alias("demo"))
    return still.select("name", F.col("value.value").alias("value")).crossJoin(F.broadcast(demo))  # one row each
