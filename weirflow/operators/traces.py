"""Statistics of trace spans in ten-second buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEYS = ("env", "host", "version", "service", "name", "resource", "type", "status_code", "synthetics")


def spans_of(traces: DataFrame) -> DataFrame:
    """A row for each span that counts: top-level, measured or partial ones; with weight, top_level, end and key columns.

    A span is top-level if it has no parent in its trace or its parent's service is another.
    """
    s = F.col("_s")
    parents = F.map_from_entries(F.transform("spans", lambda x: F.struct(x["span_id"].alias("key"), x["service"].alias("value"))))
    rows = traces.withColumn("_services", parents).withColumn("_s", F.explode("spans"))
    meta = lambda k: F.coalesce(F.try_element_at(s["meta"], F.lit(k)), F.lit(""))
    number = lambda k: F.try_element_at(s["metrics"], F.lit(k))
    above = F.try_element_at("_services", s["parent_id"])
    top = above.isNull() | (above != s["service"])
    out = rows.select(
        F.coalesce("env", F.lit("none")).alias("env"), F.coalesce("host", F.lit("")).alias("host"), meta("version").alias("version"),
        s["service"].alias("service"), s["name"].alias("name"), s["resource"].alias("resource"), s["type"].alias("type"),
        F.coalesce(meta("http.status_code").try_cast("int"), F.lit(0)).alias("status_code"), meta("origin").startswith("synthetics").alias("synthetics"),
        top.alias("top_level"), (F.coalesce(number("measured"), F.lit(0.0)) == 1).alias("measured"), number("partial_version").isNotNull().alias("partial"),
        F.coalesce(F.when(number("sample_rate") > 0, 1 / number("sample_rate")), F.lit(1.0)).alias("weight"),
        s["error"].alias("error"), s["duration"].alias("duration"), F.timestamp_micros(F.unix_micros(s["start"]) + F.floor(s["duration"] / 1000)).alias("end"),
    )
    return out.filter("top_level or measured or partial")


def span_stats(spans: DataFrame, keys: tuple[str, ...] = KEYS, bucket_s: int = 10) -> DataFrame:
    """hits, top_level_hits, errors and duration of each bucket and key, each span by its weight."""
    rows = spans.withColumn("bucket", F.window("end", f"{bucket_s} seconds")["start"])
    w = F.col("weight")
    return rows.groupBy("bucket", *keys).agg(
        F.sum(w).alias("hits"), F.sum(F.when(F.col("top_level"), w).otherwise(0.0)).alias("top_level_hits"),
        F.sum(F.when(F.col("error") != 0, w).otherwise(0.0)).alias("errors"), F.sum(F.col("duration") * w).alias("duration"),
    )


def clamped(spans: DataFrame, order: str, keys: tuple[str, ...] = (), bucket_s: int = 10, open_buckets: int = 2) -> DataFrame:
    """``spans`` whose end is moved into the oldest bucket still open when they came, by ``order``: late spans are not lost."""
    us = F.unix_micros("end")
    step = bucket_s * 1_000_000
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    newest = F.max(F.floor(us / step)).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    oldest = (newest - open_buckets + 1) * step
    return spans.withColumn("end", F.timestamp_micros(F.greatest(us, oldest)))
