"""The catalogue of queries over the test tables, each through an operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..expr import remap
from ..functions import call
from ..functions.registry import Value
from ..model import counter, gauge, metric, tags_of
from ..operators import aggregate as agg, convert, enrich, multiline, reduce as red, routing, state, statistics as stats, traces
from ..sources import codecs, metrics as texts
from ..template import template

ORDER = ("ts", "event_id")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def gauges(spark: SparkSession, d: str) -> DataFrame:
    """Events as absolute gauges, a series for each type."""
    e = events(spark, d)
    return e.select("event_id", *metric(F.col("ts"), F.col("event_type"), "absolute", gauge(F.col("value"))))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Events as incremental counters, a series for each type and user."""
    e = events(spark, d)
    return e.select("event_id", *metric(F.col("ts"), F.col("event_type"), "incremental", counter(F.col("value")), tags_of(user=F.col("user_id"))))


def plain(df: DataFrame) -> DataFrame:
    """What aggregated metrics hold, in plain columns."""
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "name", F.round("value.value", 6).alias("value"))


# ---- the flagship ----


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type as name, count(*)::double as value from events group by all")
def metrics_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = routing.filter_events(events(spark, d), "is_string(.event_type)")
    made = convert.log_to_metric(e, [{"type": "counter", "field": "event_type", "name": "{{ event_type }}"}])
    return plain(agg.aggregate(made, 3_600_000, "auto"))


# ---- filters and routes ----


@query("select event_id, value from events where event_type = 'purchase' and value > 20")
def filter_remap(spark, d):
    return routing.filter_events(events(spark, d), '.event_type == "purchase" && .value > 20').select("event_id", "value")


@query("select event_id from events where (event_type = 'purchase' or event_type like 's%') and value > 20 and user_id <> 7")
def filter_search(spark, d):
    return routing.filter_events(events(spark, d), {"type": "search", "source": "(@event_type:purchase OR @event_type:s*) @value:>20 -@user_id:7"}).select("event_id")


@query("select 'big' as route, event_id from events where value > 50 union all select 'errors', event_id from events where event_type = 'error' union all select '_unmatched', event_id from events where not (value > 50 or event_type = 'error')")
def route_column(spark, d):
    return routing.route_column(events(spark, d), {"big": ".value > 50", "errors": '.event_type == "error"'}).select("route", "event_id")


@query("select case when value > 50 then 'big' when event_type = 'error' then 'errors' else '_unmatched' end as route, event_id from events")
def exclusive_route(spark, d):
    return routing.exclusive_route(events(spark, d), [("big", ".value > 50"), ("errors", '.event_type == "error"')]).select("route", "event_id")


@query("select event_id as id, event_type as kind from events where value > 90 union all select o_orderkey, o_orderpriority from orders where o_totalprice > 400000")
def union_inputs(spark, d):
    a = events(spark, d).filter("value > 90").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    b = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"))
    return routing.union_inputs(a, b)


@query("select event_type || '/' || strftime(ts, '%Y-%m-%d') || '/u' || user_id as path, count(*) as n from events group by all")
def template_partition(spark, d):
    e = events(spark, d)
    return e.select(template(e, "{{ event_type }}/%Y-%m-%d/u{{ user_id }}").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


# ---- programs ----


@query("""select event_id, upper(event_type) as label, case when value > 50 then 'high' when value > 10 then 'mid' else 'low' end as band,
 round(value * 2 + 1, 6) as scaled, cast(json_extract(props, '$.k') as bigint) as k from events""")
def remap_program(spark, d):
    out = remap(events(spark, d), """
        .label = upcase(.event_type)
        if .value > 50 { .band = "high" } else if .value > 10 { .band = "mid" } else { .band = "low" }
        .scaled = round(.value * 2 + 1, precision: 6)
        parsed = parse_json(.props) ?? {}
        .k = to_int(parsed.k) ?? -1
    """)
    return out.select("event_id", "label", "band", "scaled", "k")


@query("select event_id, value / nullif(user_id - 7, 0) is null as failed, coalesce(round(value / nullif(user_id - 7, 0), 6), 0) as share from events")
def remap_errors(spark, d):
    out = remap(events(spark, d), """
        .share, .err = .value / (.user_id - 7)
        .failed = !is_null(.err)
        .share = round(.share, precision: 6)
    """)
    return out.select("event_id", "failed", "share")


@query("select event_id, case when event_type = 'error' then 'aborted' end as dropped_reason from events where event_type = 'error'")
def remap_dropped(spark, d):
    _, dropped = remap(events(spark, d), 'if .event_type == "error" { abort }\n.ok = true', reroute_dropped=True)
    return dropped.select("event_id", "dropped_reason")


# ---- conversion ----


@query("""select name, kind, count(*) as n, round(sum(value), 6) as total from (
 select event_type || '_count' as name, 'incremental' as kind, 1.0 as value from events union all
 select 'value_total', 'incremental', value from events union all select 'last_' || event_type, 'absolute', value from events) group by all""")
def log_to_metric(spark, d):
    rules = [
        {"type": "counter", "field": "event_type", "name": "{{ event_type }}_count"},
        {"type": "counter", "field": "value", "name": "value_total", "increment_by_value": True},
        {"type": "gauge", "field": "value", "name": "last_{{ event_type }}", "tags": {"user": "{{ user_id }}"}},
    ]
    return convert.log_to_metric(events(spark, d), rules).groupBy("name", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value.value"), 6).alias("total"))


@query("select event_id, user_id::varchar as host, event_type as name, 'incremental' as kind, value from events")
def metric_to_log(spark, d):
    c = counters(spark, d)
    tagged = c.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("host"), F.element_at("tags", "user"))))
    logs = convert.metric_to_log(tagged.withColumn("namespace", F.col("event_id").cast("string")))
    return logs.select(F.col("namespace").cast("bigint").alias("event_id"), "host", "name", "kind", F.col("value.value").alias("value"))


# ---- aggregation ----

_BUCKET = "time_bucket(interval 1 hour, ts)"


def _by_hour(select: str) -> str:
    return f"select {_BUCKET} as window_start, event_type as name, round({select}, 6) as value from events group by all"


@query(f"select {_BUCKET} as window_start, event_type as name, round(sum(value), 6) as value from events group by {_BUCKET}, event_type, user_id")
def aggregate_auto(spark, d):
    return plain(agg.aggregate(counters(spark, d), 3_600_000, "auto", ORDER))


def _summed(spark: SparkSession, d: str, passed: DataFrame) -> DataFrame:
    """Daily sums of all counters, and gauges that the mode passes on."""
    both = counters(spark, d).unionByName(passed.withColumn("name", F.lit("pass")))
    return plain(agg.aggregate(both, 86_400_000, "sum", ORDER))


@query("select time_bucket(interval 1 day, ts) as window_start, event_type as name, round(sum(value), 6) as value from events group by time_bucket(interval 1 day, ts), event_type, user_id union all select null, 'pass', value from events")
def aggregate_sum(spark, d):
    return _summed(spark, d, gauges(spark, d))


@query(_by_hour("arg_max(value, (ts, event_id))"))
def aggregate_latest(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "latest", ORDER))


@query(_by_hour("count(*)::double"))
def aggregate_count(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "count", ORDER))


@query(f"""with l as (select {_BUCKET} as w, event_type as name, arg_max(value, (ts, event_id)) as v from events group by all),
 p as (select *, lag(w) over (partition by name order by w) as pw, lag(v) over (partition by name order by w) as pv from l)
 select w as window_start, name, round(case when w - pw = interval 1 hour then v - pv else v end, 6) as value from p""")
def aggregate_diff(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "diff", ORDER))


@query(_by_hour("max(value)"))
def aggregate_max(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "max", ORDER))


@query(_by_hour("min(value)"))
def aggregate_min(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "min", ORDER))


@query(_by_hour("avg(value)"))
def aggregate_mean(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "mean", ORDER))


@query(_by_hour("stddev_pop(value)"))
def aggregate_stdev(spark, d):
    return plain(agg.aggregate(gauges(spark, d), 3_600_000, "stdev", ORDER))


@query("""with g as (select *, lag(ts) over (partition by event_type, user_id order by ts, event_id) as p from events),
 r as (select *, sum(case when p is null or ts - p > interval 1 day then 1 else 0 end) over (partition by event_type, user_id order by ts, event_id) as run from g)
 select event_id, round(sum(value) over (partition by event_type, user_id, run order by ts, event_id), 6) as value from r""")
def incremental_to_absolute(spark, d):
    return agg.incremental_to_absolute(counters(spark, d), ORDER, 86_400).select("event_id", F.round("value.value", 6).alias("value"))


@query("""select event_id, round(v, 6) as value from (select event_id, value - lag(value) over (partition by event_type, user_id order by ts, event_id) as v from events) where v >= 0""")
def absolute_to_incremental(spark, d):
    c = counters(spark, d).withColumn("kind", F.lit("absolute"))
    return agg.absolute_to_incremental(c, ORDER).select("event_id", F.round("value.value", 6).alias("value"))


# ---- sampling and state ----


@query("select event_id, '10' as sample_rate from (select event_id, row_number() over (partition by event_type order by ts, event_id) as n from events) where (n - 1) % 10 = 0")
def sample_rate(spark, d):
    return state.sample(events(spark, d), rate=10, order=ORDER, group_by=["event_type"]).select("event_id", "sample_rate")


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) as n from events) where floor(1 + (n - 1) * 0.125 + 1e-12) > floor(1 + (n - 2) * 0.125 + 1e-12)")
def sample_ratio(spark, d):
    return state.sample(events(spark, d), ratio=0.125, order=ORDER, sample_rate_key=None).select("event_id")


@query("select event_id from (select event_id, event_type, row_number() over (partition by event_type = 'error', user_id order by ts, event_id) as n from events) where event_type = 'error' or (n - 1) % 5 = 0")
def sample_exclude(spark, d):
    return state.sample(events(spark, d), rate=5, order=ORDER, group_by=["user_id"], exclude='.event_type == "error"').select("event_id")


@query()
def sample_key(spark, d):
    return state.sample(events(spark, d), rate=4, order=ORDER, key_field="user_id").select("event_id", "user_id")


@query("select user_id, count(*) as n, true as whole from events group by user_id")
def sample_key_law(spark, d):
    """All rows of a key share a fate; SQL has no such hash, so the law is held, not the members."""
    e = events(spark, d)
    kept = state.sample(e, rate=4, order=ORDER, key_field="user_id").groupBy("user_id").agg(F.count("*").alias("k"))
    all_ = e.groupBy("user_id").agg(F.count("*").alias("n")).join(kept, "user_id", "left")
    return all_.select("user_id", "n", (F.coalesce("k", F.lit(0)).isin(0) | (F.col("k") == F.col("n"))).alias("whole"))


@query("select event_id from (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def dedupe_match(spark, d):
    return state.dedupe(events(spark, d), ORDER, match=["user_id", "event_type"]).select("event_id")


@query("select event_id from (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events) where p is null or ts - p >= interval 6 hour")
def dedupe_timed_refresh(spark, d):
    return state.dedupe_timed(events(spark, d), 21_600_000, order=ORDER, match=["user_id"], refresh_on_drop=True).select("event_id")


@query("""with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
 f as (select event_id, user_id, n, ts as last, true as kept from e where n = 1 union all
  select e.event_id, e.user_id, e.n, case when e.ts - f.last >= interval 6 hour then e.ts else f.last end, e.ts - f.last >= interval 6 hour from f join e on e.user_id = f.user_id and e.n = f.n + 1)
 select event_id from f where kept""")
def dedupe_timed(spark, d):
    return state.dedupe_timed(events(spark, d), 21_600_000, order=ORDER, match=["user_id"]).select("event_id")


@query("""with e as (select *, row_number() over (partition by event_type order by ts, event_id) as n from events),
 p as (select *, lag(n) over (partition by event_type, user_id order by n) as last from e),
 c as (select p.event_type, p.n, count(distinct x.user_id) as between_keys from p join e x on x.event_type = p.event_type and x.n > p.last and x.n < p.n group by all)
 select event_id from p left join c using (event_type, n) where last is null or coalesce(between_keys, 0) >= 20""")
def dedupe_recent(spark, d):
    return state.dedupe_recent(events(spark, d), ORDER, match=["user_id"], num_events=20, scope=["event_type"]).select("event_id")


_CONTEXT = """with r as (select *, row_number() over ({0} order by ts, event_id) as n from events where value <= 95),
 f as (select *, case when value < 2 then n end as s from r),
 k as (select event_id, s, n - last_value(s ignore nulls) over ({0} order by n rows between unbounded preceding and current row) as k,
  first_value(s ignore nulls) over ({0} order by n rows between current row and unbounded following) - n as d from f)
 select event_id from k where s is not null or k <= 2 or (d <= 3 and (k is null or k <> 3)) union all select event_id from events where value > 95"""


@query(_CONTEXT.format("partition by user_id"))
def window_context(spark, d):
    return state.context_window(events(spark, d), ".value < 2", ".value > 95", 3, 2, ORDER, ["user_id"]).select("event_id")


@query(_CONTEXT.format(""))
def window_context_global(spark, d):
    return state.context_window(events(spark, d), ".value < 2", ".value > 95", 3, 2, ORDER).select("event_id")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) * 1000 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
 f as (select event_id, user_id, n, t + 21600000000000 as due, true as kept from e where n = 1 union all
  select e.event_id, e.user_id, e.n, case when greatest(f.due, e.t) - e.t > 43200000000000 then f.due else greatest(f.due, e.t) + 21600000000000 end, greatest(f.due, e.t) - e.t <= 43200000000000
  from f join e on e.user_id = f.user_id and e.n = f.n + 1)
 select event_id from f where kept""")
def throttle(spark, d):
    return state.throttle(events(spark, d), 3, 64_800, ["user_id"], order=ORDER).select("event_id")


@query("select event_id from (select event_id, row_number() over (partition by user_id, time_bucket(interval 1 day, ts) order by ts, event_id) as n from events) where n <= 2")
def throttle_fixed(spark, d):
    return state.throttle_fixed(events(spark, d), 2, 86_400, ["user_id"], order=ORDER).select("event_id")


@query("""with f as (select event_type, user_id, min((ts, event_id)) as first from events group by all),
 r as (select *, row_number() over (partition by event_type order by first) as k from f)
 select event_id, case when k <= 40 then e.user_id::varchar end as user from events e join r using (event_type, user_id)""")
def cardinality_drop_tag(spark, d):
    out = state.cardinality_limit(counters(spark, d), 40, ORDER, ["name"])
    return out.select("event_id", F.get(F.try_element_at("tags", F.lit("user")), 0).alias("user"))


@query("""with f as (select event_type, user_id, min((ts, event_id)) as first from events group by all), r as (select *, row_number() over (partition by event_type order by first) as k from f)
 select event_id, event_type as name from events join r using (event_type, user_id) where k <= 40""")
def cardinality_drop_event(spark, d):
    return state.cardinality_limit_events(counters(spark, d), 40, ORDER, ["name"]).select("event_id", "name")


# ---- reduce ----


def _session_sql(begins: str, select: str, key: str = "user_id") -> str:
    return f"""with b as (select *, case when {begins} then 1 else 0 end as b from (select *, lag(event_type) over w as pt, lag(ts) over w as pts from events window w as (partition by {key} order by ts, event_id))),
 s as (select *, sum(b) over (partition by {key} order by ts, event_id) as sid from b)
 select {key}, {select} from s group by {key}, sid"""


_FIELDS = "count(*) as n, round(sum(value), 6) as value, min(ts) as ts, arg_max(ts, (ts, event_id)) as ts_end, arg_min(event_type, (ts, event_id)) as event_type"


def _reduced(df: DataFrame, **options) -> DataFrame:
    rows = df.withColumn("n", F.lit(1).cast("bigint"))
    return red.reduce(rows, ["user_id"], ORDER, expire_after_ms=options.pop("expire_after_ms", None), **options).select("user_id", "n", F.round("value", 6).alias("value"), "ts", "ts_end", "event_type")


@query(_session_sql("event_type = 'signup'", _FIELDS))
def reduce_starts(spark, d):
    return _reduced(events(spark, d), starts_when='.event_type == "signup"')


@query(_session_sql("pt = 'purchase'", _FIELDS))
def reduce_ends(spark, d):
    return _reduced(events(spark, d), ends_when='.event_type == "purchase"')


@query(_session_sql("ts - pts >= interval 12 hour", _FIELDS))
def reduce_gap(spark, d):
    return _reduced(events(spark, d), expire_after_ms=43_200_000)


@query("""with s as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as sid from events)
 select user_id, count(*) as n, round(sum(value), 6) as value, min(ts) as ts, arg_max(ts, (ts, event_id)) as ts_end, arg_min(event_type, (ts, event_id)) as event_type from s group by user_id, sid""")
def reduce_max_events(spark, d):
    return _reduced(events(spark, d), max_events=4)


@query(_session_sql("ts - pts >= interval 1 day", """arg_max(event_type, (ts, event_id)) as event_type, round(max(value), 6) as value, string_agg(props, ' ' order by ts, event_id) as props, min(event_id) as event_id"""))
def reduce_strategies(spark, d):
    rules = {"event_type": "retain", "value": "max", "props": "concat", "event_id": "min"}
    out = red.reduce(events(spark, d), ["user_id"], ORDER, merge_strategies=rules, expire_after_ms=86_400_000)
    return out.select("user_id", "event_type", F.round("value", 6).alias("value"), "props", "event_id")


@query(_session_sql("ts - pts >= interval 1 day", """array_to_string(list(event_type order by ts, event_id), ',') as events, array_to_string(list_sort(list(distinct props)), ';') as props, string_agg(event_id::varchar, chr(10) order by ts, event_id) as ids"""))
def reduce_arrays(spark, d):
    e = events(spark, d).withColumn("ids", F.col("event_id").cast("string"))
    out = red.reduce(e, ["user_id"], ORDER, merge_strategies={"event_type": "array", "props": "flat_unique", "ids": "concat_newline"}, expire_after_ms=86_400_000)
    return out.select("user_id", F.array_join("event_type", ",").alias("events"), F.array_join("props", ";").alias("props"), "ids")


def _lists(c: DataFrame, words: Column) -> DataFrame:
    """Lists of words merged by turn: all together, the longest and the shortest."""
    rows = c.select("conv_id", "turn", words.alias("words"), words.alias("longest"), words.alias("shortest"), F.timestamp_seconds(F.col("turn")).alias("ts"))
    out = red.reduce(rows, ["conv_id"], ("turn",), merge_strategies={"words": "concat", "longest": "longest_array", "shortest": "shortest_array"}, expire_after_ms=None)
    return out.select("conv_id", *[F.array_join(c, " ").alias(c) for c in ("words", "longest", "shortest")])


@query("""with a as (select *, [x for x in string_split(text, ' ') if x <> ''] as words, turn as t from conversations)
 select conv_id, array_to_string(flatten(list(words order by t)), ' ') as words, array_to_string(arg_min(words, (-len(words), t)), ' ') as longest, array_to_string(arg_min(words, (len(words), t)), ' ') as shortest from a group by conv_id""")
def reduce_lists(spark, d):
    return _lists(table(spark, d, "conversations"), F.filter(F.split("text", " "), lambda w: w != ""))


# ---- enrichment ----


@query("select s_suppkey, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def enrich_record(spark, d):
    out = enrich.get_record(table(spark, d, "supplier"), table(spark, d, "nation"), {"n_nationkey": F.col("s_nationkey")})
    return out.select("s_suppkey", F.col("record.n_name").alias("n_name"), F.col("record.n_regionkey").alias("n_regionkey"))


@query("select r_name, array_to_string(list(n_name order by n_nationkey), ',') as nations from region join nation on r_regionkey = n_regionkey group by r_name")
def enrich_records(spark, d):
    out = enrich.find_records(table(spark, d, "region"), table(spark, d, "nation"), {"n_regionkey": F.col("r_regionkey")}, order=["n_nationkey"])
    return out.select("r_name", F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("nations"))


@query("select c_custkey, lower(c_mktsegment) as seg from customer")
def enrich_ignore_case(spark, d):
    c = table(spark, d, "customer")
    segments = c.select(F.lower("c_mktsegment").alias("seg")).distinct()
    out = enrich.get_record(c, segments, {"seg": F.upper("c_mktsegment")}, case_sensitive=False)
    return out.select("c_custkey", F.col("record.seg").alias("seg"))


@query("select c_custkey, case when n_regionkey < 2 then n_name else 'other' end as label from customer join nation on c_nationkey = n_nationkey")
def enrich_wildcard(spark, d):
    n = table(spark, d, "nation")
    known = n.filter("n_regionkey < 2").select(F.col("n_name").alias("key"), F.col("n_name").alias("label")).unionByName(spark.range(1).select(F.lit("*").alias("key"), F.lit("other").alias("label")))
    named = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = enrich.find_records(named, known, {"key": F.col("n_name")}, wildcard="*")
    return out.select("c_custkey", F.get("records", 0)["label"].alias("label"))


@query("select c_custkey, count(o_orderkey) as n, coalesce(round(sum(o_totalprice), 2), 0) as total from customer left join orders on o_custkey = c_custkey and o_orderdate between timestamp '1997-01-01' and timestamp '1997-06-30' group by c_custkey")
def enrich_between_dates(spark, d):
    span = enrich.Between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz"))
    out = enrich.find_records(table(spark, d, "customer"), table(spark, d, "orders"), {"o_custkey": F.col("c_custkey"), "o_orderdate": span}, select=["o_totalprice"], order=["o_orderkey"])
    total = F.aggregate("records", F.lit(0.0), lambda a, r: a + r["o_totalprice"])
    return out.select("c_custkey", F.size("records").cast("bigint").alias("n"), F.round(total, 2).alias("total"))


@query("select s_suppkey, n_name as nation from supplier join nation on s_nationkey = n_nationkey")
def enrich_program(spark, d):
    out = remap(table(spark, d, "supplier"), 'row = get_enrichment_table_record!("nation", {"n_nationkey": .s_nationkey}, select: ["n_name"])\n.nation = row.n_name', tables={"nation": table(spark, d, "nation")})
    return out.select("s_suppkey", "nation")


@query("with m as (select user_id as key, arg_max(event_type, (ts, event_id)) as value, max(ts) as seen from events group by all) select key, value, 86400 - (epoch(timestamp '2024-01-30 12:00:00')::bigint - floor(epoch(seen))::bigint) as ttl from m where ttl >= 0")
def enrich_memory(spark, d):
    e = events(spark, d)
    out = enrich.memory_table(e.withColumn("key", F.col("user_id")), 86_400, F.lit("2024-01-30T12:00:00Z").cast("timestamp"), value="event_type")
    return out.select("key", "value", "ttl")


@query("select event_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def enrich_member(spark, d):
    members = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return enrich.is_member(events(spark, d), members, ["user_id"]).select("event_id")


def _priced(spark: SparkSession, d: str, orders: DataFrame) -> DataFrame:
    """Orders with the parts whose range holds their price."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 20).alias("high"))
    return enrich.range_join(orders, p, "low", "high", F.col("o_totalprice"), 64, "inner").select("o_orderkey", "p_partkey")


@query("select o_orderkey, p_partkey from orders join part on o_totalprice between p_retailprice * 100 and p_retailprice * 100 + 20")
def enrich_range(spark, d):
    return _priced(spark, d, table(spark, d, "orders"))


# ---- statistics and texts ----


def _quantile_sql() -> str:
    names = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    picks = ", ".join(f"min(case when upto >= greatest(1, round({q} * alln)) then v end) as {n}" for n, q in names.items())
    return f"""with e as (select l_returnflag, l_quantity as v, count(*) as n from lineitem group by all),
 r as (select *, sum(n) over (partition by l_returnflag order by v) as upto, sum(n) over (partition by l_returnflag) as alln from e)
 select l_returnflag, min(v) as min, max(v) as max, min(case when upto >= greatest(1, round(0.5 * alln)) then v end) as median, round(sum(v * n) / sum(n), 6) as avg, sum(v * n) as sum, sum(n)::bigint as count, {picks} from r group by l_returnflag"""


@query(_quantile_sql())
def dist_quantiles(spark, d):
    return stats.weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("avg", F.round("avg", 6))


@query("select l_returnflag, le, n from (select l_returnflag, count(*) filter (l_quantity <= 5) as b5, count(*) filter (l_quantity <= 25) as b25, count(*) as alln from lineitem group by all), lateral (select '5' as le, b5 as n union all select '25', b25 union all select '+Inf', alln)")
def histogram_buckets(spark, d):
    return stats.histogram_buckets(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [5, 25])


@query("""with q as (select l_returnflag, count(*) as count, min(l_extendedprice) as lo, max(l_extendedprice) as hi, list_sort(list(l_extendedprice)) as xs from lineitem group by all),
 m as (select *, xs[floor(0.5 * (count - 1))::bigint + 1] as a, xs[floor(0.99 * (count - 1))::bigint + 1] as b, 1.01 / 0.99::double as g from q)
 select l_returnflag, count, round(least(hi, greatest(lo, power(g, ceil(ln(a) / ln(g))) * 2 / (g + 1))), 4) as p50, round(least(hi, greatest(lo, power(g, ceil(ln(b) / ln(g))) * 2 / (g + 1))), 4) as p99 from m""")
def sketch_quantiles(spark, d):
    s = stats.sketched(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "count", F.round(stats.sketch_quantile(0.5), 4).alias("p50"), F.round(stats.sketch_quantile(0.99), 4).alias("p99"))


@query("""with l as (select event_type, user_id, arg_max(value, (ts, event_id)) as v from events group by all)
 select '# TYPE ' || event_type || ' counter' as line from l group by event_type union all
 select event_type || '{user="' || user_id || '"} ' || regexp_replace(v::varchar, '\\.0$', '') from l""")
def prom_text(spark, d):
    return texts.encode_exposition(counters(spark, d), ORDER, "line").select("line")


@query("select event_type as name, count(*) as n, round(sum(value), 6) as total from events group by all")
def statsd_round_trip(spark, d):
    lines = texts.encode_statsd(counters(spark, d))
    return texts.parse_statsd(lines).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value.value"), 6).alias("total"))


@query("""select l_returnflag as service, l_linestatus as name, time_bucket(interval 10 second, l_shipdate + to_microseconds((l_quantity * 1000000)::bigint)) as bucket,
 count(*)::double as hits, sum(case when l_linenumber = 1 then 1 else 0 end)::double as errors, sum(l_quantity * 1e9) as duration from lineitem group by all""")
def trace_stats(spark, d):
    x = table(spark, d, "lineitem")
    span = F.struct(
        F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("name"), F.lit("r").alias("resource"), F.lit("web").alias("type"), F.col("l_linenumber").cast("bigint").alias("span_id"), F.lit(0).cast("bigint").alias("parent_id"),
        F.col("l_shipdate").cast("timestamp").alias("start"), (F.col("l_quantity") * 1_000_000_000).cast("bigint").alias("duration"), (F.col("l_linenumber") == 1).cast("int").alias("error"),
        F.create_map().cast("map<string,string>").alias("meta"), F.create_map().cast("map<string,double>").alias("metrics"),
    )
    rows = x.select(F.col("l_orderkey").cast("string").alias("trace_id"), F.lit("prod").alias("env"), F.lit("h").alias("host"), F.array(span).alias("spans"))
    out = traces.span_stats(traces.spans_of(rows), ("service", "name"))
    return out.select("service", "name", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "hits", "errors", F.col("duration").cast("double").alias("duration"))


@query("""with m as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as k from conversations)
 select conv_id, min(turn) as turn, string_agg(text, chr(10) order by turn) as message, count(*)::int as lines from m group by conv_id, k""")
def multiline_conversations(spark, d):
    c = table(spark, d, "conversations")
    return multiline.join_from_starts(c.withColumnRenamed("text", "message"), F.col("role") == "user", ["turn"], ["conv_id"])


@query("""with m as (select *, sum((role <> 'assistant')::int) over (partition by conv_id order by turn) as k from conversations),
 f as (select *, first_value(role) over (partition by conv_id, k order by turn) as begun from m)
 select conv_id, min(turn) as turn, count(*)::int as lines, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as digest from f group by conv_id, case when begun = 'user' then k::varchar else k || ':' || turn end""")
def multiline_fold(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("message"))
    return multiline.join_lines(c, "^user", "^assistant", "continue_through", ["turn"], ["conv_id"]).select("conv_id", "turn", "lines", F.md5("message").alias("digest"))


# ---- functions ----


@query("""select event_id, upper(event_type) as up, substr(event_type, 2) as tail, left(event_type, 3) || case when length(event_type) > 3 then '...' else '' end as cut, replace(event_type, 'i', '_') as swapped,
 contains(lower(event_type), 'er') as has, starts_with(event_type, 'p') as starts, length(props)::bigint as size, array_to_string(string_split(props, ':'), '|') as parts from events""")
def fn_string(spark, d):
    e = events(spark, d)
    t = F.col("event_type")
    kind = e.schema["event_type"].dataType
    return e.select(
        "event_id", call("upcase", t).alias("up"), call("slice", Value(t, kind), 1).alias("tail"), call("truncate", t, 3, "...").alias("cut"), call("replace", t, "i", **{"with": F.lit("_")}).alias("swapped"),
        call("contains", t, F.lit("ER"), False).alias("has"), call("starts_with", t, F.lit("p")).alias("starts"), call("length", Value(F.col("props"), kind)).alias("size"), call("join", call("split", F.col("props"), ":"), "|").alias("parts"),
    )


@query("""select l_orderkey, l_linenumber, abs(l_tax - 1) as away, ceil(l_extendedprice * 10) / 10 as up, floor(l_extendedprice / 1) as down, (l_partkey % 7)::bigint as rest, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(l_discount * 10 - 0) / 2), 2) + cos(radians(0)) * cos(radians(l_discount * 10)) * power(sin(radians(l_tax * 10) / 2), 2)))), 6) as km from lineitem""")
def fn_number(spark, d):
    x = table(spark, d, "lineitem")
    dbl = x.schema["l_tax"].dataType
    return x.select(
        "l_orderkey", "l_linenumber", call("abs", F.col("l_tax") - 1).alias("away"), call("ceil", Value(F.col("l_extendedprice"), dbl), 1).alias("up"), call("floor", Value(F.col("l_extendedprice"), dbl)).alias("down"), call("mod", F.col("l_partkey"), F.lit(7)).alias("rest"),
        F.round(call("haversine", F.lit(0.0), F.lit(0.0), F.col("l_discount") * 10, F.col("l_tax") * 10), 6).alias("km"),
    )


@query("select event_id, strftime(ts, '%d/%b/%Y:%H:%M:%S') as shown, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 as s, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as again from events")
def fn_timestamp(spark, d):
    e = events(spark, d)
    at = F.col("ts").cast("timestamp")
    text = call("format_timestamp", at, "%Y-%m-%d %H:%M:%S")
    again = call("parse_timestamp", Value(text, e.schema["props"].dataType), "%Y-%m-%d %H:%M:%S")
    return e.select("event_id", call("format_timestamp", at, "%d/%b/%Y:%T").alias("shown"), call("to_unix_timestamp", at, "milliseconds").alias("ms"), call("to_unix_timestamp", at).alias("s"), again.cast("timestamp_ntz").alias("again"))


def _arrays(t: DataFrame) -> DataFrame:
    """What the array functions make of the words ``l`` of each document."""
    a = F.col("l")
    kind = t.schema["l"].dataType
    return t.select(
        "doc_id", call("length", Value(a, kind)).alias("n"), call("includes", a, F.lit("the")).alias("has"), call("join", call("pop", a), " ").alias("popped"), call("join", call("push", a, F.lit("end")), " ").alias("pushed"),
        F.size(call("unique", a)).cast("bigint").alias("kinds"),
    )


@query("""with w as (select doc_id, [x for x in string_split(text, ' ') if x <> ''] as l from documents where text is not null)
 select doc_id, len(l)::bigint as n, list_contains(l, 'the') as has, md5(array_to_string(l[1:greatest(0, len(l) - 1)], ' ')) as popped, md5(array_to_string(list_append(l, 'end'), ' ')) as pushed, len(list_distinct(l))::bigint as kinds from w""")
def fn_array(spark, d):
    out = _arrays(table(spark, d, "documents").filter("text is not null").withColumn("l", F.filter(F.split("text", " "), lambda w: w != "")))
    return out.withColumns({c: F.md5(c) for c in ("popped", "pushed")})


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, '{\"k\":' || json_extract(props, '$.k') || '}' as again from events")
def fn_json(spark, d):
    e = events(spark, d)
    v = call("parse_json", F.col("props"))
    kind = e.select(v.alias("v")).schema["v"].dataType
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), call("encode_json", Value(v, kind)).alias("again"))


@query("""select event_id, '10.0.' || user_id % 256 || '.' || event_id % 256 as ip, (167772160 + (user_id % 256) * 256 + event_id % 256)::bigint as number, user_id % 256 < 128 as inside from events""")
def fn_ip(spark, d):
    e = events(spark, d)
    ip = F.concat_ws(".", F.lit("10.0"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))
    return e.select("event_id", ip.alias("ip"), call("ip_aton", ip).alias("number"), call("ip_cidr_contains_v4", F.lit("10.0.0.0/17"), ip).alias("inside"))


@query("select event_id, md5(props) as md5, sha1(props) as sha1, sha256(props) as sha2, base64(props::blob) as b64, lower(hex(props)) as b16 from events")
def fn_hash(spark, d):
    p = F.col("props")
    return events(spark, d).select("event_id", call("md5", p).alias("md5"), call("sha1", p).alias("sha1"), call("sha2", p, "SHA-256").alias("sha2"), call("encode_base64", p).alias("b64"), call("encode_base16", p).alias("b16"))


@query(r"select doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g')) as digest from documents")
def redact_documents(spark, d):
    import re

    rx = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    return table(spark, d, "documents").select("doc_id", F.md5(call("redact", F.col("text"), [rx])).alias("digest"))


@query(r"""select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host,
 case when regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) = '' then '/' else regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) end as path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from pages where url like '%://%'""")
def parse_url_pages(spark, d):
    p = table(spark, d, "pages").filter("url like '%://%'")
    u = call("parse_url", F.col("url"))
    return p.withColumn("u", u).select("page_id", F.col("u.scheme").alias("scheme"), F.col("u.host").alias("host"), F.col("u.path").alias("path"), F.try_element_at("u.query", F.lit("page")).alias("page"))


@query("""with c as (select event_id, unnest(string_split(props, '')) as ch from events), n as (select event_id, ch, count(*) as k from c where ch <> '' group by all),
 t as (select event_id, sum(k) as alln from n group by all) select event_id, round(-sum((k / alln) * log2(k / alln)), 6) as entropy from n join t using (event_id) group by event_id""")
def entropy_props(spark, d):
    return events(spark, d).select("event_id", F.round(call("shannon_entropy", F.col("props")), 6).alias("entropy"))


@query("""select event_id, '<14>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z u' || user_id || ' app - - - ' || event_type as line from events""")
def encode_syslog(spark, d):
    e = events(spark, d).select(F.col("event_id"), F.col("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.col("event_type").alias("message"))
    # the encoder gives the line alone, so the id travels through the message
    lines = codecs.encode_syslog(e.withColumn("message", F.concat_ws("\u0001", "event_id", "message")), app_name="app")
    return lines.select(F.regexp_extract("value", r" (\d+)\x01", 1).cast("bigint").alias("event_id"), F.regexp_replace("value", r"\d+\x01", "").alias("line"))


@query("select event_id, event_type as message, 'user' as facility, 'info' as severity, 'u' || user_id as hostname, ts from events")
def syslog_round_trip(spark, d):
    e = events(spark, d).select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.concat_ws(" ", "event_id", "event_type").alias("message"))
    x = codecs.decode_syslog(codecs.encode_syslog(e, app_name="app"))
    return x.select(F.split("message", " ")[0].cast("bigint").alias("event_id"), F.split("message", " ")[1].alias("message"), "facility", "severity", "hostname", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


@query("select user_id, count(*) as n, round(sum(value), 6) as total from events where event_type <> 'error' group by user_id")
def pipeline_config(spark, d):
    from .pipeline import Pipeline

    config = {
        "transforms": {
            "split": {"type": "exclusive_route", "inputs": ["events"], "routes": [{"name": "bad", "condition": '.event_type == "error"'}]},
            "shaped": {"type": "remap", "inputs": ["split._unmatched"], "source": ".name = \"seen\"\n.total = .value"},
        }
    }
    out = Pipeline(spark, config, {"events": events(spark, d)}).output("shaped")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("total"), 6).alias("total"))
