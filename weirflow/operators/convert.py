"""Conversion between logs, metrics and traces, and user code over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..model import METRIC, TAGS, counter, gauge, metric, tags_of, value_of
from ..template import template


def log_to_metric(df: DataFrame, metrics: Sequence[Mapping], time_col: str = "ts") -> DataFrame:
    """Metrics from logs: each rule of ``metrics`` has type, field and perhaps name, namespace, tags, kind, increment_by_value.

    A rule gives nothing for a row that lacks its field or whose value is no number where one is needed. Counters count
    rows, or add up the field with increment_by_value; gauges are absolute; histograms and summaries are samples of
    rate 1. Names and tags are templates. All rules are one pass over the rows.
    """
    made = []
    for rule in metrics:
        kind, field = rule["type"], rule["field"]
        value = F.col(field)
        number = value.try_cast("double") if dict(df.dtypes).get(field) != "boolean" else F.lit(None).cast("double")
        name = template(df, rule.get("name", field))
        namespace = template(df, rule["namespace"]) if rule.get("namespace") else None
        tags = _tags(df, rule.get("tags") or {})
        if kind == "counter":
            v, there = counter(number if rule.get("increment_by_value") else F.lit(1.0)), number.isNotNull() if rule.get("increment_by_value") else value.isNotNull()
        elif kind == "gauge":
            v, there = gauge(number), number.isNotNull()
        elif kind == "set":
            v, there = value_of("set", members=F.array(value.cast("string"))), value.isNotNull()
        elif kind in ("histogram", "summary"):
            v, there = value_of("distribution", samples=F.array(F.struct(number.alias("value"), F.lit(1).cast("bigint").alias("rate"))), statistic=F.lit(kind)), number.isNotNull()
        else:
            raise ValueError(f"{kind} is no type of metric")
        absolute = rule.get("kind", "absolute" if kind == "gauge" else "incremental")
        row = F.struct(*metric(F.col(time_col), name, absolute, v, tags, namespace))
        made.append(F.when(there & name.isNotNull(), row))
    return df.select(F.explode(F.array_compact(F.array(*made))).alias("_m")).select("_m.*")


def _tags(df: DataFrame, tags: Mapping) -> Column:
    """Tags from templates; a key that ends in * takes over every entry of the map or struct that its value names."""
    plain = {k: v for k, v in tags.items() if not k.endswith("*")}
    out = tags_of(**{k: template(df, v) for k, v in plain.items()})
    for key, source in tags.items():
        if key.endswith("*"):
            name = source.strip("{} ").lstrip(".")
            kind = dict(df.dtypes)[name]
            entries = F.col(name) if kind.startswith("map") else F.from_json(F.to_json(F.col(name)), "map<string,string>")
            spread = F.transform_values(F.transform_keys(entries, lambda k, _: F.concat(F.lit(key[:-1]), k)), lambda _, v: F.array(v.cast("string")))
            out = F.map_concat(out, F.coalesce(spread, F.create_map().cast(TAGS)))
    return out


def all_metrics(df: DataFrame, column: str = "message") -> DataFrame:
    """Metrics from their own JSON form in ``column``; what doesn't parse is left out."""
    return df.select(F.from_json(F.col(column), METRIC).alias("_m")).filter("_m.name is not null").select("_m.*")


def metric_to_log(metrics: DataFrame, host_tag: str = "host", metric_tag_values: str = "single") -> DataFrame:
    """Metrics as logs: host from its tag, the rest as columns; tags as single values (the last) or full sets."""
    rest = F.map_filter("tags", lambda k, _: k != host_tag)
    tags = F.transform_values(rest, lambda _, v: F.element_at(v, -1)) if metric_tag_values == "single" else rest
    host = F.try_element_at("tags", F.lit(host_tag))
    return metrics.select(
        F.coalesce("ts", F.current_timestamp()).alias("ts"), F.when(F.size(host) > 0, F.element_at(host, -1)).alias("host"),
        "namespace", "name", tags.alias("tags"), "kind", "interval_ms", "value",
    )


def trace_to_log(traces: DataFrame) -> DataFrame:
    """Traces are logs with spans: nothing but the kind of event changes."""
    return traces


class Hooks:
    """User code over rows: ``init(emit)``, ``process(row, emit)``, ``shutdown(emit)``; each may emit any number of rows."""

    def init(self, emit: Callable[[dict], None]) -> None:
        pass

    def process(self, row: dict, emit: Callable[[dict], None]) -> None:
        emit(row)

    def shutdown(self, emit: Callable[[dict], None]) -> None:
        pass


def scripted(df: DataFrame, make: Callable[[], Hooks], schema: str | None = None) -> DataFrame:
    """Rows through ``make()`` hooks; one instance runs for each partition, so state is that of a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema) if schema else df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, hooks, rows = to_arrow_schema(out), make(), []
        hooks.init(rows.append)
        for batch in batches:
            for row in batch.to_pylist():
                hooks.process(row, rows.append)
            if rows:
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in shape.names} for r in rows], schema=shape)
                rows.clear()
        hooks.shutdown(rows.append)
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in shape.names} for r in rows], schema=shape)

    return df.mapInArrow(run, out)


def delayed(df: DataFrame, delay_ms: int, time_col: str = "ts", name: str = "release_ts") -> DataFrame:
    """When each row would be let go; a batch's content does not change."""
    return df.withColumn(name, F.timestamp_micros(F.unix_micros(F.col(time_col).cast("timestamp")) + delay_ms * 1000))
