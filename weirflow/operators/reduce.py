"""Reduce: sessions of rows merged to one row, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType, StructType, TimestampNTZType, TimestampType

from ..conditions import condition
from ..plans.order import fold

STRATEGIES = ("discard", "retain", "sum", "max", "min", "array", "concat", "concat_newline", "concat_raw", "shortest_array", "longest_array", "flat_unique")


class _Sessions:
    """Session numbers where starts, ends and limits interact; see ``sessions``."""

    def __init__(self, expire_us: int | None, period_us: int | None, most: int | None):
        self.expire, self.period, self.most = expire_us, period_us, most
        self.number, self.open, self.size, self.last, self.began = 0, False, 0, 0, 0

    def __call__(self, us: int, starts: bool, ends: bool) -> tuple:
        if self.open and (self.expire is not None and us - self.last >= self.expire or self.period is not None and us - self.began >= self.period):
            self.open = False
        if starts or not self.open:
            self.number, self.size, self.began, self.open = self.number + 1, 0, us, True
        self.size, self.last = self.size + 1, us
        # a row that starts a session never ends it as well
        if not starts and (ends or self.most is not None and self.size >= self.most):
            self.open = False
        return (self.number,)


def sessions(df: DataFrame, group_by: Sequence[str], order: Sequence[str] = ("ts",), time_col: str = "ts", starts_when=None, ends_when=None, expire_after_ms: int | None = None, end_every_period_ms: int | None = None, max_events: int | None = None, name: str = "_session") -> DataFrame:
    """Adds the number of each row's session within its group.

    A session ends before a row for which ``starts_when`` holds, after one for which ``ends_when`` holds, after a pause of
    ``expire_after_ms``. These are windows. ``max_events`` and ``end_every_period_ms`` count from where a session
    began, so they take a fold.
    """
    if starts_when is not None and ends_when is not None:
        raise ValueError("give either starts_when or ends_when")
    starts = condition(df, starts_when) if starts_when is not None else F.lit(False)
    ends = condition(df, ends_when) if ends_when is not None else F.lit(False)
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    if end_every_period_ms is not None or max_events is not None:
        ms = lambda x: None if x is None else x * 1000
        marked = df.withColumn("_us", us).withColumn("_starts", starts).withColumn("_ends", ends)
        make = lambda: _Sessions(ms(expire_after_ms), ms(end_every_period_ms), max_events)
        return fold(marked, group_by, order, ["_us", "_starts", "_ends"], make, f"{name} bigint").drop("_us", "_starts", "_ends")
    w = Window.partitionBy(*group_by).orderBy(*order) if group_by else Window.partitionBy(F.lit(0)).orderBy(*order)
    begins = starts | F.coalesce(F.lag(ends).over(w), F.lit(False))
    if expire_after_ms is not None:
        begins = begins | F.coalesce(us - F.lag(us).over(w) >= expire_after_ms * 1000, F.lit(False))
    return df.withColumn("_begins", begins.cast("int")).withColumn(name, F.sum("_begins").over(w)).drop("_begins")


def merged(kind, strategy: str | None, field: str, at: Column) -> list[Column]:
    """The aggregates of a field; ``at`` orders the rows of a session. Null is skipped, as it can't be told from an absent field."""
    c = F.col(field)
    there = c.isNotNull()
    first = F.min_by(c, F.when(there, at)).alias(field)
    last = F.max_by(c, F.when(there, at)).alias(field)
    if strategy is None:
        if isinstance(kind, NumericType):
            return [F.sum(c).alias(field)]
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return [first, last.alias(f"{field}_end")]
        return [first]
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {STRATEGIES}")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(there, F.struct(at.alias("at"), c.alias("v"))))), lambda x: x["v"])
    listed = kind.typeName() == "array"
    if strategy == "discard":
        return [first]
    if strategy == "retain":
        return [last]
    if strategy in ("sum", "max", "min"):
        if not isinstance(kind, NumericType):
            raise ValueError(f"{strategy} needs a number, {field} is {kind.simpleString()}")
        return [{"sum": F.sum, "max": F.max, "min": F.min}[strategy](c).alias(field)]
    if strategy == "array":
        return [ordered.alias(field)]
    if strategy == "concat" and listed:
        return [F.flatten(ordered).alias(field)]
    if strategy.startswith("concat"):
        if not isinstance(kind, StringType):
            raise ValueError(f"{strategy} needs a string, {field} is {kind.simpleString()}")
        return [F.array_join(ordered, {"concat": " ", "concat_newline": "\n", "concat_raw": ""}[strategy]).alias(field)]
    if strategy == "flat_unique":
        return [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(field) if listed else F.array_sort(F.collect_set(c)).alias(field)]
    if not listed:
        raise ValueError(f"{strategy} needs an array, {field} is {kind.simpleString()}")
    # of arrays of one length the first wins
    size = F.struct((F.size(c) if strategy == "shortest_array" else -F.size(c)).alias("n"), at.alias("at"))
    return [F.min_by(c, F.when(there, size)).alias(field)]


def reduce(df: DataFrame, group_by: Sequence[str] = (), order: Sequence[str] = ("ts",), time_col: str = "ts", merge_strategies: Mapping[str, str] | None = None, starts_when=None, ends_when=None, expire_after_ms: int | None = 30_000, end_every_period_ms: int | None = None, max_events: int | None = None) -> DataFrame:
    """One row for each session: numbers are summed, of other fields the first value stays, timestamps also give ``<field>_end``.

    ``merge_strategies`` name another rule for a field. Fields of structs are merged one by one unless the struct has a rule.
    """
    rows = sessions(df, group_by, order, time_col, starts_when, ends_when, expire_after_ms, end_every_period_ms, max_events)
    rules = dict(merge_strategies or {})
    if wrong := [p for p in rules if "[" in p]:
        raise ValueError(f"rules name fields, not places in arrays: {wrong}")
    flat: dict[str, Column] = {}
    kinds: dict = {}

    def open_up(schema: StructType, prefix: str, at: Column | None) -> None:
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            c = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            if path in group_by:
                continue
            if isinstance(f.dataType, StructType) and path not in rules:
                open_up(f.dataType, path + ".", c)
            else:
                flat[path], kinds[path] = c, f.dataType

    open_up(df.schema, "", None)
    names = {p: f"_f{i}" for i, p in enumerate(flat)}
    at = F.struct(*order)
    slim = rows.select(*group_by, "_session", at.alias("_at"), *[c.alias(names[p]) for p, c in flat.items()])
    aggs = []
    for p in flat:
        found = merged(kinds[p], rules.get(p), names[p], F.col("_at"))
        aggs += found
    out = slim.groupBy(*group_by, "_session").agg(*aggs)

    def build(schema: StructType, prefix: str) -> list[Column]:
        cols = []
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if path in group_by:
                cols.append(F.col(f"`{f.name}`"))
            elif path in names:
                cols.append(F.col(names[path]).alias(f.name))
                if rules.get(path) is None and isinstance(f.dataType, (TimestampType, TimestampNTZType)):
                    cols.append(F.col(f"{names[path]}_end").alias(f"{f.name}_end"))
            else:
                cols.append(F.struct(*build(f.dataType, path + ".")).alias(f.name))
        return cols

    return out.select(*build(df.schema, ""))
