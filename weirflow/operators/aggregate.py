"""Metric aggregation over tumbling event-time windows, and conversion between incremental and absolute metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import BUCKETS, VALUE, canonical
from ..plans.order import staged

MODES = ("auto", "sum", "latest", "count", "diff", "max", "min", "mean", "stdev")
SERIES = ("namespace", "name", "_tags")


def windowed(df: DataFrame, interval_ms: int, time_col: str = "ts") -> DataFrame:
    """Adds _window, the start of the tumbling window of each row, and _tags, the tags in one order."""
    return df.withColumn("_window", F.window(F.col(time_col), f"{interval_ms} milliseconds")["start"]).withColumn("_tags", canonical("tags"))


def _latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct("ts", "kind", "value", "tags"), F.struct(*order)).alias("_m"))


def summed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sum of the values of each ``by`` (which holds kind and _type): the rule of each type, combined before the shuffle.

    Counters and gauges add up; sets unite; samples follow one another; histograms add bucket by bucket.
    """
    v = F.col("value")
    plain = df.filter(F.col("_type").isin("counter", "gauge")).groupBy(*by).agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), F.sum(v["value"]).alias("value"))
    null = lambda kind: F.lit(None).cast(kind)
    struct = lambda **x: F.struct(F.col("_type").alias("type"), *[x.get(n, null(t)).alias(n) for n, t in (("value", "double"), ("members", "array<string>"), ("samples", "array<struct<value:double,rate:bigint>>"), ("statistic", "string"), ("buckets", "array<struct<upper_limit:double,count:bigint>>"), ("quantiles", "array<struct<quantile:double,value:double>>"), ("count", "bigint"), ("sum", "double"))])
    keep = [*by, "ts", "tags"]
    parts = [plain.select(*keep, struct(value=F.col("value")).cast(VALUE).alias("value"))]
    sets = df.filter(F.col("_type") == "set").withColumn("m", F.explode_outer(v["members"])).groupBy(*by).agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), F.array_sort(F.collect_set("m")).alias("m"))
    parts.append(sets.select(*keep, struct(members=F.col("m")).cast(VALUE).alias("value")))
    # equal sample values are one sample whose rate is their sum, so what is collected is the distinct values
    spread = df.filter(F.col("_type") == "distribution").withColumn("s", F.explode_outer(v["samples"])).withColumn("st", v["statistic"])
    each = spread.groupBy(*by, "st", F.col("s.value").alias("x")).agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), F.sum("s.rate").alias("rate"))
    dist = each.groupBy(*by, "st").agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct(F.col("x").alias("value"), "rate")))).alias("s"))
    parts.append(dist.select(*keep, struct(samples=F.col("s"), statistic=F.col("st")).cast(VALUE).alias("value")))
    hist = df.filter(F.col("_type") == "histogram").withColumn("n", v["count"]).withColumn("total", v["sum"])
    sums = hist.groupBy(*by).agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    bounds = hist.withColumn("b", F.explode(v["buckets"])).groupBy(*by, F.col("b.upper_limit").alias("upper_limit")).agg(F.sum("b.count").alias("count"))
    listed = bounds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("upper_limit", "count"))).alias("b"))
    same = None
    for c in by:
        one = sums[c].eqNullSafe(listed[c])
        same = one if same is None else same & one
    both = sums.join(listed, same, "left").select(*[sums[c] for c in by], "ts", "tags", "n", "total", "b", sums["_type"].alias("_t"))
    parts.append(both.select(*keep, struct(buckets=F.coalesce("b", F.array().cast(BUCKETS)), count=F.col("n"), sum=F.col("total")).cast(VALUE).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _current(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of each window and series, the rows since its kind or type last changed.

    Kinds are first listed by aggregation. Only series that changed within a window are joined back, as a change
    throws away what was gathered before it.
    """
    by = ["_window", *SERIES]
    listed = df.groupBy(*by, "kind", "_type").agg(F.max(F.struct(*order)).alias("_upto"))
    ranked = listed.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_upto"))))
    broken = ranked.filter("_place = 2").select(*[F.col(c).alias(f"b{c}") for c in by], F.col("_upto").alias("_break"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"b{c}"))
    # few rows: one for each window and series with more than one kind or type
    return df.join(broken, same, "left").filter(F.col("_break").isNull() | (F.struct(*order) > F.col("_break"))).drop("_break", *[f"b{c}" for c in by])


def _shaped(df: DataFrame, interval_ms: int) -> DataFrame:
    return df.select(F.col("_window").alias("window_start"), "ts", "namespace", "name", "tags", "kind", F.lit(interval_ms).alias("interval_ms"), "value")


def aggregate(metrics: DataFrame, interval_ms: int = 10_000, mode: str = "auto", order: Sequence[str] = ("ts",)) -> DataFrame:
    """A metric for each window and series, by ``mode``; ``window_start`` is null for rows that pass through as they are.

    auto: incremental metrics are summed and absolute ones replaced by the latest; a change of kind or type starts anew.
    sum, latest: only incremental, only absolute ones; the others pass. count: how many rows have the kind of the first.
    diff: the latest absolute value less that of the window before, if the series was there; a counter that fell stays
    as it is. max, min, mean, stdev: of absolute gauges; incremental metrics pass. ``order`` must be total within a series.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    df = windowed(metrics, interval_ms).withColumn("_type", F.col("value.type"))
    by = ["_window", *SERIES]
    rows = df
    passed = None
    if mode == "sum":
        rows, passed = df.filter("kind = 'incremental'"), df.filter("kind = 'absolute'")
    elif mode not in ("auto", "count"):
        rows, passed = df.filter("kind = 'absolute'"), df.filter("kind = 'incremental'")
    if mode in ("auto", "sum"):
        # one pass settles every window and series of one kind whose values add up or replace each other
        each = rows.groupBy(*by, "kind", "_type").agg(F.sum("value.value").alias("_sum"), F.max("ts").alias("_ts"), F.max_by(F.struct("ts", "kind", "value", "tags"), F.struct(*order)).alias("_m"))
        each = staged(each.withColumn("_kinds", F.count("*").over(Window.partitionBy(*by))))
        adds = (F.col("kind") == "incremental") & F.col("_type").isin("counter", "gauge")
        simple = (F.col("_kinds") == 1) & (adds | (F.col("kind") == "absolute") | (F.col("_type") == "summary"))
        settled = each.filter(simple).select(*by, F.when(adds, F.col("_ts")).otherwise(F.col("_m.ts")).alias("ts"), F.col("_m.tags").alias("tags"), "kind", F.when(adds, F.col("_m.value").withField("value", F.col("_sum"))).otherwise(F.col("_m.value")).alias("value"))
        settled = _shaped(settled, interval_ms)
        left = each.filter(~simple).select(*[F.col(c).alias(f"l{c}") for c in by]).distinct()
        if not left.head(1):
            return settled if passed is None else settled.unionByName(_passed(passed))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"l{c}"))
        now = _current(staged(rows.join(left, same, "left_semi")), order)
        out = summed(now.filter("kind = 'incremental'"), [*by, "kind", "_type"])
        # summaries cannot be added: the last one stays
        last = _latest(now.filter("kind = 'absolute' or _type = 'summary'"), by, order).select(*by, "_m.*")
        out = _shaped(out.filter("_type != 'summary'").unionByName(last.withColumn("_type", F.col("value.type")).select(*out.columns)), interval_ms).unionByName(settled)
    elif mode == "latest":
        out = _shaped(_latest(rows, by, order).select(*by, "_m.*"), interval_ms)
    elif mode == "count":
        kinds = rows.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"), F.max("ts").alias("ts"), F.first("tags").alias("tags"))
        one = kinds.groupBy(*by).agg(F.min_by(F.struct("kind", "n", "ts", "tags"), "_first").alias("_m")).select(*by, "_m.*")
        out = _shaped(one.withColumn("value", _as("counter", F.col("n").cast("double"))), interval_ms)
    elif mode == "diff":
        last = _latest(rows, by, order).select(*by, "_m.*")
        w = Window.partitionBy(*SERIES).orderBy("_window")
        before = F.lag(F.struct("_window", "value", "kind")).over(w)
        last = last.withColumn("_p", before)
        near = F.unix_millis("_window") - F.unix_millis("_p._window") == interval_ms
        less = F.col("value.value") - F.col("_p.value.value")
        fits = near & (F.col("value.type") == F.col("_p.value.type")) & ((F.col("value.type") == "gauge") | ((F.col("value.type") == "counter") & (less >= 0)))
        out = _shaped(last.withColumn("value", F.when(F.coalesce(fits, F.lit(False)), F.col("value").withField("value", less)).otherwise(F.col("value"))), interval_ms)
    elif mode in ("max", "min"):
        v = F.col("value.value")
        best = F.max_by if mode == "max" else F.min_by
        row = F.struct("ts", "kind", "value", "tags")
        at = F.struct(*order)
        found = rows.groupBy(*by).agg(F.min_by(row, at).alias("_one"), best(row, v).alias("_best"), (F.max if mode == "max" else F.min)(F.when(F.col("_type") == "gauge", v)).alias("_v"))
        # the first row decides: if it isn't a gauge it stays
        chosen = F.when(F.col("_one.value.type") == "gauge", F.struct(F.col("_best.ts").alias("ts"), F.lit("absolute").alias("kind"), F.col("_one.value").withField("value", F.col("_v")).alias("value"), F.col("_best.tags").alias("tags"))).otherwise(F.col("_one"))
        out = _shaped(found.withColumn("_m", chosen).select(*by, "_m.*"), interval_ms)
    else:
        gauges = rows.filter(F.col("_type") == "gauge")
        f = F.avg if mode == "mean" else F.stddev_pop
        found = gauges.groupBy(*by).agg(F.max("ts").alias("ts"), F.first("tags").alias("tags"), f("value.value").alias("_v"))
        out = _shaped(found.withColumn("kind", F.lit("absolute")).withColumn("value", _as("gauge", F.col("_v"))), interval_ms)
    if passed is not None:
        out = out.unionByName(_passed(passed))
    return out


def _passed(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(None).cast("timestamp").alias("window_start"), "ts", "namespace", "name", "tags", "kind", "interval_ms", "value")


def _as(type: str, value: Column) -> Column:
    from ..model import value_of

    return value_of(type, value=value)


def incremental_to_absolute(metrics: DataFrame, order: Sequence[str] = ("ts",), ttl_s: float = 300.0) -> DataFrame:
    """Incremental counters and gauges become running totals of their series; absolute ones set the total anew.

    A series unseen for over ``ttl_s`` seconds, or one whose type changes, starts from nothing. Other types pass unchanged.
    """
    df = metrics.withColumn("_tags", canonical("tags")).withColumn("_type", F.col("value.type"))
    series = Window.partitionBy(*SERIES).orderBy(*order)
    plain = df.filter(F.col("_type").isin("counter", "gauge"))
    before = F.lag(F.struct("ts", "_type")).over(series)
    stale = F.unix_micros("ts") - F.unix_micros(before["ts"]) > int(ttl_s * 1e6)
    new = before.isNull() | stale | (before["_type"] != F.col("_type")) | (F.col("kind") == "absolute")
    marked = plain.withColumn("_new", new.cast("int"))
    run = marked.withColumn("_run", F.sum("_new").over(series))
    total = F.sum("value.value").over(Window.partitionBy(*SERIES, "_run").orderBy(*order))
    out = run.withColumn("value", F.col("value").withField("value", total)).withColumn("kind", F.lit("absolute"))
    rest = df.filter(~F.coalesce(F.col("_type").isin("counter", "gauge"), F.lit(False)))
    return out.select(*metrics.columns).unionByName(rest.select(*metrics.columns))


def absolute_to_incremental(metrics: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Absolute metrics become differences from the row before of their series; incremental ones pass.

    The first row of a series gives nothing, nor does one whose type changed or, for counters and histograms, one
    that fell: it is the new baseline.
    """
    df = metrics.withColumn("_tags", canonical("tags"))
    passed = metrics.filter("kind = 'incremental'")
    w = Window.partitionBy(*SERIES).orderBy(*order)
    rows = df.filter("kind = 'absolute'").withColumn("_p", F.lag("value").over(w))
    v, p = F.col("value"), F.col("_p")
    less = v["value"] - p["value"]
    pairs = F.arrays_zip(v["buckets"].alias("a"), p["buckets"].alias("b"))
    fell = F.exists(pairs, lambda x: x["a"]["count"] < x["b"]["count"]) | (v["count"] < p["count"])
    alike = F.transform(v["buckets"], lambda x: x["upper_limit"]) == F.transform(p["buckets"], lambda x: x["upper_limit"])
    by_type = (
        F.when(v["type"] == "counter", less >= 0).when(v["type"] == "gauge", F.lit(True)).when(v["type"] == "set", F.lit(True))
        .when(v["type"] == "distribution", v["statistic"] == p["statistic"]).when(v["type"] == "histogram", alike & ~fell).otherwise(F.lit(False))
    )
    fits = F.coalesce((v["type"] == p["type"]) & by_type, F.lit(False))
    changed = (
        F.when(v["type"].isin("counter", "gauge"), v.withField("value", less))
        .when(v["type"] == "set", v.withField("members", F.array_except(v["members"], p["members"])))
        .when(v["type"] == "distribution", v.withField("samples", F.filter(v["samples"], lambda s: ~F.exists(p["samples"], lambda t: t["value"] == s["value"]))))
        .otherwise(v.withField("buckets", F.transform(pairs, lambda x: F.struct(x["a"]["upper_limit"].alias("upper_limit"), (x["a"]["count"] - x["b"]["count"]).alias("count")))).withField("count", v["count"] - p["count"]).withField("sum", v["sum"] - p["sum"]))
    )
    out = rows.filter(fits).withColumn("value", changed).withColumn("kind", F.lit("incremental"))
    return out.select(*metrics.columns).unionByName(passed)
