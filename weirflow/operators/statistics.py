"""Statistics of metric values: distributions, histograms, summaries and sketches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import BUCKETS, counter, gauge

#: Bounds and quantiles of the exposition format where none are given.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
DEFAULT_QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, rate: str | None = None, quantiles: Sequence[float] = DEFAULT_QUANTILES) -> DataFrame:
    """min, max, median, avg, sum, count and quantiles of each key: the smallest value up to which ``round(p * count)`` samples lie.

    Values are first counted, so a key's rows are combined before the shuffle and only distinct values are put in order.
    """
    n = F.col(rate).cast("bigint") if rate else F.lit(1).cast("bigint")
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(n).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = each.withColumn("_upto", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    picks = [_pick(q).alias(_label(q)) for q in quantiles]
    return ranked.groupBy(*keys).agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"), _pick(0.5).alias("median"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("avg"),
        F.sum(F.col("_v") * F.col("_n")).alias("sum"), F.sum("_n").alias("count"), *picks,
    )


def _label(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def _pick(q: float) -> Column:
    return F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.round(F.lit(q) * F.col("_all"))), F.col("_v")))


def distribution_statistics(metrics: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = DEFAULT_QUANTILES) -> DataFrame:
    """As ``weighted_quantiles`` over the samples of distribution metrics."""
    samples = metrics.filter("value.type = 'distribution'").select(*keys, F.explode("value.samples").alias("_s")).select(*keys, F.col("_s.value").alias("_x"), F.col("_s.rate").alias("_r"))
    return weighted_quantiles(samples, keys, "_x", "_r", quantiles)


def compress_samples(samples: Column) -> Column:
    """Samples in order of value, equal values as one with the sum of their rates."""
    values = F.array_sort(F.array_distinct(F.transform(samples, lambda s: s["value"])))
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(F.filter(samples, lambda s: s["value"] == v), F.lit(0).cast("bigint"), lambda a, s: a + s["rate"]).alias("rate")))


def to_histogram(metrics: DataFrame, bounds: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """Distributions as histograms: a sample counts in the first bucket whose bound is not below it; beyond the last, only in count and sum."""
    s = F.col("value.samples")
    total = lambda f, kind: F.aggregate(s, F.lit(0).cast(kind), f)
    between = lambda low, high: lambda x: (x["value"] <= high) & (F.lit(True) if low is None else x["value"] > low)
    buckets = []
    for low, b in zip((None, *bounds), bounds):
        n = F.aggregate(F.filter(s, between(low, b)), F.lit(0).cast("bigint"), lambda a, x: a + x["rate"])
        buckets.append(F.struct(F.lit(float(b)).alias("upper_limit"), n.alias("count")))
    v = F.col("value").withField("type", F.lit("histogram")).withField("buckets", F.array(*buckets).cast(BUCKETS)).withField("count", total(lambda a, x: a + x["rate"], "bigint")).withField("sum", total(lambda a, x: a + x["value"] * x["rate"], "double")).withField("samples", F.lit(None).cast("array<struct<value:double,rate:bigint>>")).withField("statistic", F.lit(None).cast("string"))
    return metrics.withColumn("value", F.when(F.col("value.type") == "distribution", v).otherwise(F.col("value")))


def histogram_buckets(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """keys, le and the cumulative count of values up to each bound, +Inf included, from plain values in one aggregation."""
    aggs = [F.count(F.when(F.col(value) <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*keys).agg(*aggs, F.count(value).alias("_all"))
    rows = F.array(*[F.struct(F.lit(_number(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return one.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.le", "_r.n")


def _number(x: float) -> str:
    return f"{x:g}"


def split_summaries(metrics: DataFrame) -> DataFrame:
    """Summaries as counters ``_count`` and ``_sum`` and a gauge for each quantile; other metrics stay."""
    v = F.col("value")
    row = lambda name, tags, value, kind=None: F.struct("ts", "namespace", name.alias("name"), tags.alias("tags"), F.col("kind") if kind is None else F.lit(kind).alias("kind"), "interval_ms", value.alias("value"))
    quantiles = F.transform(v["quantiles"], lambda q: row(F.col("name"), F.map_concat(F.map_filter("tags", lambda k, _: k != "quantile"), F.create_map(F.lit("quantile"), F.array(q["quantile"].cast("string")))), gauge(q["value"]), "absolute"))
    parts = F.concat(F.array(row(F.concat("name", F.lit("_count")), F.col("tags"), counter(v["count"])), row(F.concat("name", F.lit("_sum")), F.col("tags"), counter(v["sum"]))), quantiles)
    split = metrics.filter("value.type = 'summary'").select(F.explode(parts).alias("_m")).select("_m.*")
    return metrics.filter("value.type != 'summary'").unionByName(split)


#: A sketch's relative accuracy; a key of it holds values within a ratio of 1 + 2 * ACCURACY / (1 - ACCURACY).
ACCURACY = 0.01


def sketched(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """keys, count, sum, min, max, zero and bins (index, n; negative values under negative signs): a mergeable relative-error sketch.

    A value's bin is the ceiling of its logarithm to the base (1 + a) / (1 - a), so sketches merge by adding bins and a quantile
    is off by the share a at most. All of it is built-in aggregation; bins grow with the range of values, not with rows.
    """
    base = math.log((1 + accuracy) / (1 - accuracy))
    v = F.col(value).cast("double")
    sign = F.signum(v).cast("int")
    index = F.when(v != 0, F.ceil(F.ln(F.abs(v)) / base)).otherwise(0)
    bins = df.filter(v.isNotNull()).groupBy(*keys, sign.alias("sign"), index.cast("int").alias("index")).agg(F.count("*").alias("n"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return bins.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("_s").alias("sum"), F.min("_lo").alias("min"), F.max("_hi").alias("max"), F.array_sort(F.collect_list(F.struct("sign", "index", "n"))).alias("bins"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several rows of a key as one."""
    each = sketches.select(*keys, F.explode("bins").alias("b")).groupBy(*keys, "b.sign", "b.index").agg(F.sum("b.n").alias("n"))
    bins = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sign", "index", "n"))).alias("bins"))
    sums = sketches.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    return sums.join(bins, list(keys)) if keys else sums.crossJoin(F.broadcast(bins))  # one row each


def sketch_quantile(q: float, accuracy: float = ACCURACY) -> Column:
    """The quantile of a row of ``sketched``, from its bins in order of value."""
    gamma = (1 + accuracy) / (1 - accuracy)
    order = F.concat(F.reverse(F.filter("bins", lambda b: b["sign"] < 0)), F.filter("bins", lambda b: b["sign"] == 0), F.filter("bins", lambda b: b["sign"] > 0))
    rank = F.lit(q) * (F.col("count") - 1)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
    middle = lambda b: b["sign"] * F.pow(F.lit(gamma), b["index"]) * 2 / (gamma + 1)
    step = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.when(a["v"].isNotNull(), a["v"]).when(a["n"] + b["n"] > rank, middle(b)).alias("v"))
    return F.least(F.col("max"), F.greatest(F.col("min"), F.aggregate(order, start, step, lambda a: a["v"])))

