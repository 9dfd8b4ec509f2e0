"""Sampling, deduplication, context windows, throttling and cardinality limits over ordered streams.

``order`` names columns that order the rows totally; arrival order in a stream processor becomes this order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..conditions import condition
from ..plans.order import first_by, fold, row_numbers


def sample(df: DataFrame, rate: int | None = None, ratio: float | None = None, order: Sequence[str] = ("ts",), group_by: Sequence[str] = (), key_field: str | None = None, exclude: Column | str | Mapping | None = None, sample_rate_key: str | None = "sample_rate", rate_field: str | None = None, ratio_field: str | None = None) -> DataFrame:
    """One row in ``rate``, or the share ``ratio`` of rows, the first of each group among them; ``exclude`` rows always stay.

    Rows are counted within ``group_by``. With ``key_field`` a hash of the field decides instead, so all rows of a
    value share a fate; a row without it is counted. ``rate_field`` and ``ratio_field`` hold a rate or share of their own for
    each row where valid. Kept rows carry the rate as text in ``sample_rate_key``.
    """
    if (rate is None) == (ratio is None):
        raise ValueError("give either rate or ratio")
    if rate is not None and rate < 1 or ratio is not None and not 0 < ratio <= 1:
        raise ValueError("rate must be 1 or more, ratio above 0 and up to 1")
    free = condition(df, exclude) if exclude is not None else F.lit(False)
    marked = df.withColumn("_free", free)
    counted = row_numbers(marked.filter("not _free"), group_by, order)
    n = F.col("_n")
    if rate is not None:
        keeps = (n - 1) % rate == 0
    else:
        r = F.lit(float(ratio))
        keeps = F.floor(1 + (n - 1) * r + 1e-12) > F.floor(1 + (n - 2) * r + 1e-12)
    label = F.lit(str(rate if rate is not None else ratio))
    if key_field:
        hashed = F.pmod(F.xxhash64(F.col(key_field).cast("string")), F.lit(2**53)) / F.lit(float(2**53))
        by_key = F.pmod(F.xxhash64(F.col(key_field).cast("string")), F.lit(rate)) == 0 if rate is not None else hashed <= ratio
        keeps = F.when(F.col(key_field).isNull(), keeps).otherwise(by_key)
    own = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in group_by], n), F.lit(2**53)) / F.lit(float(2**53))
    if rate_field:
        good = F.col(rate_field) >= 1
        keeps = F.when(good, own * F.col(rate_field) < 1).otherwise(keeps)
        label = F.when(good, F.col(rate_field).cast("string")).otherwise(label)
    if ratio_field:
        good = (F.col(ratio_field) > 0) & (F.col(ratio_field) <= 1)
        keeps = F.when(good, own <= F.col(ratio_field)).otherwise(keeps)
        label = F.when(good, F.col(ratio_field).cast("string")).otherwise(label)
    out = counted.filter(keeps).drop("_n", "_free")
    if sample_rate_key:
        out = out.withColumn(sample_rate_key, label)
    if exclude is None:
        return out
    return out.unionByName(marked.filter("_free").drop("_free"), allowMissingColumns=True)


def _typed(df: DataFrame, field: str) -> list[Column]:
    """A field as a key: columns have one type each, and a variant's type counts with its value."""
    kind = dict(df.dtypes).get(field)
    if kind == "variant":
        return [F.schema_of_variant(field), F.to_json(F.col(field))]
    if kind is not None and kind.startswith("map"):
        return [F.array_sort(F.map_entries(field))]
    return [F.col(field)]


def _key(df: DataFrame, match: Sequence[str] | None, ignore: Sequence[str] | None) -> list[Column]:
    if match is not None and ignore is not None:
        raise ValueError("give either match or ignore")
    fields = match if match is not None else [c for c in df.columns if c not in (ignore or ())]
    return [x for f in fields for x in _typed(df, f)]


def dedupe(df: DataFrame, order: Sequence[str] = ("ts",), match: Sequence[str] | None = None, ignore: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key. Keys are the fields ``match``, or all but ``ignore``; null is a value of its own.

    An aggregation, so a key that holds a third of all rows is combined before the shuffle.
    """
    return first_by(df, _key(df, match, ignore), order)


class _Recent:
    """The keys seen last, at most ``most``; a duplicate counts as seen."""

    def __init__(self, most: int):
        self.most, self.seen = most, OrderedDict()

    def __call__(self, key: str) -> tuple:
        if key in self.seen:
            self.seen.move_to_end(key)
            return (False,)
        self.seen[key] = True
        if len(self.seen) > self.most:
            self.seen.popitem(last=False)
        return (True,)


def dedupe_recent(df: DataFrame, order: Sequence[str], match: Sequence[str] | None = None, ignore: Sequence[str] | None = None, num_events: int = 5000, scope: Sequence[str] = ()) -> DataFrame:
    """As ``dedupe`` with a memory of the ``num_events`` keys seen last, within each ``scope``; a key that was pushed out is new again."""
    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_key(df, match, ignore))]), {"ignoreNullFields": "false"})
    out = fold(df.withColumn("_id", key), scope, order, ["_id"], lambda: _Recent(num_events), "_keep boolean")
    return out.filter("_keep").drop("_id", "_keep")


class _Aged:
    def __init__(self, age: int):
        self.age, self.last = age, None

    def __call__(self, at: int) -> tuple:
        if self.last is not None and at - self.last < self.age:
            return (False,)
        self.last = at
        return (True,)


def dedupe_timed(df: DataFrame, max_age_ms: int, time_col: str = "ts", order: Sequence[str] = ("ts",), match: Sequence[str] | None = None, ignore: Sequence[str] | None = None, refresh_on_drop: bool = False) -> DataFrame:
    """Drops a row whose key was accepted less than ``max_age_ms`` before; with ``refresh_on_drop``, was seen."""
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    key = _key(df, match, ignore)
    if refresh_on_drop:
        before = F.lag(at).over(Window.partitionBy(*key).orderBy(*order))
        return df.withColumn("_gap", at - before).filter(F.col("_gap").isNull() | (F.col("_gap") >= max_age_ms * 1000)).drop("_gap")
    out = fold(df.withColumn("_us", at), key, order, ["_us"], lambda: _Aged(max_age_ms * 1000), "_keep boolean")
    return out.filter("_keep").drop("_us", "_keep")


def context_window(df: DataFrame, flush_when: Column | str | Mapping, forward_when: Column | str | Mapping | None = None, num_events_before: int = 100, num_events_after: int = 0, order: Sequence[str] = ("ts",), group_by: Sequence[str] = ()) -> DataFrame:
    """Rows around those for which ``flush_when`` holds: so many before, the row, so many after; ``forward_when`` rows always stay.

    Of the rows that are not forwarded, with k rows since the last flush and d to the next, one stays if it flushes,
    if k is at most ``num_events_after``, or if d is at most ``num_events_before`` and k is not ``num_events_after`` + 1: the row
    that ends a run after a flush is always dropped.
    """
    marked = df.withColumn("_flush", condition(df, flush_when)).withColumn("_pass", condition(df, forward_when) if forward_when is not None else F.lit(False))
    rows = row_numbers(marked.filter("not _pass"), group_by, order)
    spot = F.when(F.col("_flush"), F.col("_n"))
    if group_by:
        w = Window.partitionBy(*group_by).orderBy(*order)
        last, following = F.last(spot, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(spot, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("_k", F.col("_n") - last).withColumn("_d", following - F.col("_n"))
    else:
        rows = _near_flushes(rows, max(num_events_before, num_events_after + 1))
    k, d = F.col("_k"), F.col("_d")
    stays = F.col("_flush") | (k <= num_events_after) | ((d <= num_events_before) & (k.isNull() | (k != num_events_after + 1)))
    out = rows.filter(F.coalesce(stays, F.lit(False))).select(*df.columns)
    return out.unionByName(marked.filter("_pass").select(*df.columns))


def _near_flushes(rows: DataFrame, reach: int) -> DataFrame:
    """Without groups one window would be one task: rows go to blocks of numbers, and each block sees the flushes within reach."""
    block = max(4 * reach, 4096)
    at = F.expr(f"_n div {block}")
    flushes = rows.filter("_flush").select(F.col("_n").alias("_f"), F.explode(F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda x: F.floor((F.col("_n") + x) / block)))).alias("_b"))
    marks = flushes.groupBy("_b").agg(F.array_sort(F.collect_set("_f")).alias("_at"))  # at most block + 2 * reach numbers
    out = rows.withColumn("_b", at).join(marks, "_b", "left")
    before = F.array_max(F.filter("_at", lambda x: x <= F.col("_n")))
    after = F.array_min(F.filter("_at", lambda x: x >= F.col("_n")))
    return out.withColumn("_k", F.col("_n") - before).withColumn("_d", after - F.col("_n")).drop("_b", "_at")


class _Bucket:
    """The generic cell rate algorithm in whole nanoseconds: a burst of ``threshold``, then one row each window / threshold."""

    def __init__(self, threshold: int, window_s: float):
        self.step = int(window_s * 1e9) // threshold
        self.slack, self.due = self.step * (threshold - 1), None

    def __call__(self, free: bool, us: int) -> tuple:
        if free:
            return (True,)
        at = us * 1000
        due = at if self.due is None else max(self.due, at)
        if due - at > self.slack:
            return (False,)
        self.due = due + self.step
        return (True,)


def throttle(df: DataFrame, threshold: int, window_s: float, key_field: Sequence[str] = (), exclude: Column | str | Mapping | None = None, time_col: str = "ts", order: Sequence[str] = ("ts",)) -> DataFrame:
    """At most ``threshold`` rows a window for each key, by a leaking bucket; rows over the limit go. ``exclude`` rows are not counted.

    Each decision needs the one before, so a key's rows run through one task in order; memory does not grow with them.
    """
    free = condition(df, exclude) if exclude is not None else F.lit(False)
    marked = df.withColumn("_free", free).withColumn("_us", F.unix_micros(F.col(time_col).cast("timestamp")))
    out = fold(marked, key_field, order, ["_free", "_us"], lambda: _Bucket(threshold, window_s), "_keep boolean")
    return out.filter("_keep").drop("_free", "_us", "_keep")


def throttle_fixed(df: DataFrame, threshold: int, window_s: int, key_field: Sequence[str] = (), time_col: str = "ts", order: Sequence[str] = ("ts",)) -> DataFrame:
    """The first ``threshold`` rows of each key in each fixed window: a limit of its own kind, without a fold."""
    df = df.withColumn("_w", F.window(time_col, f"{window_s} seconds")["start"])
    return row_numbers(df, ["_w", *key_field], order).filter(F.col("_n") <= threshold).drop("_n", "_w")


def cardinality_limit(metrics: DataFrame, value_limit: int = 500, order: Sequence[str] = ("ts",), scope: Sequence[str] = (), per_tag: Mapping[str, int | None] | None = None) -> DataFrame:
    """Drops tags whose value is none of the first ``value_limit`` of that tag, in each ``scope``; ``per_tag`` has limits of its own (None: no limit).

    The value that counts is the whole set of a tag's values. First sightings come from an aggregation, and only they
    are ranked, so rows are not.
    """
    per_tag = dict(per_tag or {})
    tags = metrics.select(*scope, F.struct(*order).alias("_o"), F.explode("tags").alias("_tag", "_value"))
    value = F.array_sort("_value")
    first = tags.withColumn("_value", value).groupBy(*scope, "_tag", "_value").agg(F.min("_o").alias("_first"))
    limit = F.lit(value_limit)
    for tag, n in per_tag.items():
        limit = F.when(F.col("_tag") == tag, F.lit(2**31 - 1 if n is None else n)).otherwise(limit)
    # a tag's distinct values are ranked by when they came; they are as many as the tag's cardinality
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope, "_tag").orderBy("_first", "_value")))
    over = ranked.filter(F.col("_rank") > limit).select(*[F.col(c).alias(f"s_{c}") for c in scope], "_tag", F.col("_value").alias("_bad"))
    rows = metrics.withColumn("_row", F.struct(*order))
    gone = rows.select(*scope, "_row", F.explode("tags").alias("_tag", "_v")).withColumn("_v", F.array_sort("_v"))
    same = (gone["_tag"] == over["_tag"]) & gone["_v"].eqNullSafe(over["_bad"])
    for c in scope:
        same = same & gone[c].eqNullSafe(over[f"s_{c}"])
    bad = gone.join(over, same).groupBy("_row").agg(F.collect_set(gone["_tag"]).alias("_drop"))
    joined = rows.join(bad, "_row", "left")
    return joined.withColumn("tags", F.map_filter("tags", lambda k, _: F.col("_drop").isNull() | ~F.array_contains("_drop", k))).select(*metrics.columns)


class _Limits:
    def __init__(self, limit: int, per_tag: Mapping[str, int | None], most_keys: int | None):
        self.limit, self.per_tag, self.most = limit, per_tag, most_keys
        self.known: dict[str, set] = {}

    def __call__(self, tags) -> tuple:
        pairs = [(k, tuple(sorted(v or (), key=str))) for k, v in (tags or [])]
        room = lambda k: k in self.known or self.most is None or len(self.known) < self.most
        for k, v in pairs:
            limit = self.per_tag.get(k, self.limit)
            if limit is not None and room(k) and v not in self.known.get(k, ()) and len(self.known.get(k, ())) >= limit:
                return (False,)
        for k, v in pairs:
            if self.per_tag.get(k, self.limit) is not None and room(k):
                self.known.setdefault(k, set()).add(v)
        return (True,)


def cardinality_limit_events(metrics: DataFrame, value_limit: int = 500, order: Sequence[str] = ("ts",), scope: Sequence[str] = (), per_tag: Mapping[str, int | None] | None = None, max_tracked_keys: int | None = None) -> DataFrame:
    """Drops the whole row if any tag is over its limit; then none of its values counts as seen. A fold within each ``scope``."""
    limits = dict(per_tag or {})
    rows = metrics.withColumn("_entries", F.array_sort(F.map_entries("tags")))
    marked = rows.withColumn("_entries", F.transform("_entries", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    out = fold(marked, scope, order, ["_entries"], lambda: _Pairs(_Limits(value_limit, limits, max_tracked_keys)), "_keep boolean")
    return out.filter("_keep").select(*metrics.columns)


class _Pairs:
    """Rows of structs become pairs."""

    def __init__(self, step: _Limits):
        self.step = step

    def __call__(self, entries) -> tuple:
        return self.step([(e["key"], e["value"]) for e in entries or []])
