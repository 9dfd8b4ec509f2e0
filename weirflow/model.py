"""The data model: logs, metrics and traces as three DataFrame schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SAMPLES = "array<struct<value: double, rate: bigint>>"
BUCKETS = "array<struct<upper_limit: double, count: bigint>>"
QUANTILES = "array<struct<quantile: double, value: double>>"
#: ``value`` holds counters and gauges; the other fields belong to the other types.
VALUE = f"struct<type: string, value: double, members: array<string>, samples: {SAMPLES}, statistic: string, buckets: {BUCKETS}, quantiles: {QUANTILES}, count: bigint, sum: double>"
TAGS = "map<string, array<string>>"
METRIC = f"ts timestamp, namespace string, name string, tags {TAGS}, kind string, interval_ms int, value {VALUE}"
LOG = "ts timestamp, host string, message string, source_type string, fields map<string, string>"
SPAN = "struct<service: string, name: string, resource: string, type: string, span_id: bigint, parent_id: bigint, start: timestamp, duration: bigint, error: int, meta: map<string, string>, metrics: map<string, double>>"
TRACE = f"trace_id string, ts timestamp, env string, host string, spans array<{SPAN}>"

TYPES = ("counter", "gauge", "set", "distribution", "histogram", "summary")
KINDS = ("incremental", "absolute")


@dataclass(frozen=True)
class LogSchema:
    """Names of the columns with a meaning of their own."""

    message: str = "message"
    timestamp: str = "ts"
    host: str = "host"
    source_type: str = "source_type"


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def value_of(type: str, **fields: Column) -> Column:
    """A metric's value struct; fields that are not given are null."""
    kinds = {"value": "double", "members": "array<string>", "samples": SAMPLES, "statistic": "string", "buckets": BUCKETS, "quantiles": QUANTILES, "count": "bigint", "sum": "double"}
    if wrong := set(fields) - set(kinds):
        raise ValueError(f"a metric value has no {sorted(wrong)}")
    return F.struct(F.lit(type).alias("type"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def counter(value: Column) -> Column:
    return value_of("counter", value=value)


def gauge(value: Column) -> Column:
    return value_of("gauge", value=value)


def tags_of(**tags: Column) -> Column:
    """Tags of one value each; a tag whose value is null is left out."""
    if not tags:
        return F.create_map().cast(TAGS)
    every = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.array(v.cast("string")))])
    return F.map_filter(every, lambda _, v: v[0].isNotNull())


def canonical(tags: Column | str) -> Column:
    """Tags in one order, so that equal series compare and group equal."""
    return F.array_sort(F.map_entries(tags))


def metric(ts: Column, name: Column, kind: str, value: Column, tags: Column | None = None, namespace: Column | None = None) -> list[Column]:
    """The columns of a metric."""
    return [
        ts.cast("timestamp").alias("ts"),
        (F.lit(None).cast("string") if namespace is None else namespace).alias("namespace"),
        name.alias("name"),
        (tags_of() if tags is None else tags).alias("tags"),
        F.lit(kind).alias("kind"),
        F.lit(None).cast("int").alias("interval_ms"),
        value.alias("value"),
    ]


def require(df: DataFrame, schema: str) -> DataFrame:
    """``df`` if it has every column of ``schema`` by name; an error names what lacks."""
    wanted = StructType.fromDDL(schema).names
    if lacks := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns {lacks} are missing; there are {df.columns}")
    return df
