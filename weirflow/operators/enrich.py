"""Enrichment: rows joined with lookup tables, one record or all records for each row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.order import staged

#: A lookup table of at most so many bytes in Catalyst's estimate is sent to all executors; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Between:
    """The table's column lies between two values of the row, both included; None leaves an end open."""

    from_: Column | None = None
    to: Column | None = None


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if Catalyst's estimate of its size is at most ``most`` bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def file_table(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, header: bool = True, delimiter: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """A table from CSV; ``types``: int, float, bool, string, date, timestamp, or either of the last two as ``date|format``."""
    df = spark.read.csv(path, header=header, sep=delimiter)
    if names:
        df = df.toDF(*names)
    elif not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])

    def cast(c: str, kind: str) -> Column:
        base, _, form = kind.partition("|")
        if base in ("date", "timestamp"):
            from ..functions.time import java_format

            return F.try_to_timestamp(F.col(c), F.lit(java_format(form))) if form else F.try_to_timestamp(F.col(c))
        return F.col(c).try_cast({"int": "bigint", "integer": "bigint", "float": "double", "bool": "boolean", "boolean": "boolean", "string": "string"}[base])

    return df.withColumns({c: cast(c, k) for c, k in (types or {}).items()})


def _matches(df: DataFrame, table: DataFrame, where: Mapping[str, Column | Between], case_sensitive: bool) -> tuple[DataFrame, DataFrame, Column, dict]:
    if missing := [c for c in where if c not in table.columns]:
        raise ValueError(f"the table has no {missing}; it has {table.columns}")
    fold = (lambda c: c) if case_sensitive else F.lower
    left, test, equal = df, F.lit(True), {}
    for i, (name, value) in enumerate(where.items()):
        t = F.col(f"_t_{name}")
        if isinstance(value, Between):
            for side, v in (("from", value.from_), ("to", value.to)):
                if v is not None:
                    left = left.withColumn(f"_{side}{i}", v)
                    test = test & (t >= F.col(f"_{side}{i}") if side == "from" else t <= F.col(f"_{side}{i}"))
        else:
            text = dict(table.dtypes)[name] == "string"
            value = F.lit(value) if not isinstance(value, Column) else value
            left = left.withColumn(f"_c{i}", fold(value.cast("string")) if text else value)
            equal[name] = f"_c{i}"
            test = test & (F.col(f"_c{i}") == (fold(t) if text else t))
    return left, table.select(*[F.col(c).alias(f"_t_{c}") for c in table.columns]), test, equal


def find_records(df: DataFrame, table: DataFrame, where: Mapping[str, Column | Between], name: str = "records", select: Sequence[str] | None = None, case_sensitive: bool = True, wildcard: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Adds an array of the table's records that meet all conditions, in the table's ``order``; empty without any.

    Records of equal keys are gathered before the join, so the rows are not multiplied. With ``wildcard``, records under
    the wildcard in every equality stand in where no record has the exact values.
    """
    fields = list(select or table.columns)
    left, right, test, equal = _matches(df, table, where, case_sensitive)
    rank = F.struct(*[F.col(f"_t_{c}") for c in (order or table.columns)])
    record = F.struct(*[F.col(f"_t_{c}").alias(c) for c in fields])
    listed = lambda rows: F.transform(F.array_sort(rows), lambda x: x["r"])
    ranged = any(isinstance(v, Between) for v in where.values())
    item = F.struct(rank.alias("o"), record.alias("r"))
    if not ranged:
        fold = (lambda c: c) if case_sensitive else F.lower
        kinds = dict(table.dtypes)
        keys = [(fold(F.col(f"_t_{c}")) if kinds[c] == "string" else F.col(f"_t_{c}")).alias(f"_e{i}") for i, c in enumerate(equal)]
        grouped = small(right.groupBy(*keys).agg(listed(F.collect_list(item)).alias("_hits")))
        on = F.lit(True)
        for i, c in enumerate(equal.values()):
            on = on & (F.col(c) == F.col(f"_e{i}"))
        out = left.join(grouped, on, "left").drop(*[f"_e{i}" for i in range(len(equal))])
        if wildcard is not None:
            star = right.filter(" and ".join(f"`_t_{c}` = '{wildcard}'" for c in equal)).groupBy().agg(listed(F.collect_list(item)).alias("_star"))
            out = out.join(small(star))  # one row
            out = out.withColumn("_hits", F.coalesce("_hits", "_star")).drop("_star")
        empty = F.array().cast(grouped.schema["_hits"].dataType)
        return out.withColumn(name, F.coalesce("_hits", empty)).select(*df.columns, name)
    # a range multiplies rows by their hits only; they are gathered by a number of the row, written so that both sides agree on it
    numbered = staged(left.withColumn("_id", F.monotonically_increasing_id()))
    hits = numbered.select("_id", *[c for c in left.columns if c not in df.columns]).join(small(right), test).groupBy("_id").agg(listed(F.collect_list(item)).alias("_hits"))
    out = numbered.join(hits, "_id", "left")
    return out.withColumn(name, F.coalesce("_hits", F.array().cast(hits.schema["_hits"].dataType))).select(*df.columns, name)


def get_record(df: DataFrame, table: DataFrame, where: Mapping[str, Column | Between], name: str = "record", select: Sequence[str] | None = None, case_sensitive: bool = True, wildcard: str | None = None) -> DataFrame:
    """Adds the one record that meets all conditions; null where there is none or more than one, and says which in ``<name>_error``."""
    found = find_records(df, table, where, "_found", select, case_sensitive, wildcard)
    n = F.size("_found")
    error = F.when(n == 0, "no rows found").when(n > 1, "more than one row found")
    return found.withColumn(name, F.when(n == 1, F.get("_found", 0))).withColumn(f"{name}_error", error).drop("_found")


def range_join(df: DataFrame, table: DataFrame, low: str, high: str, value: Column, width: int, how: str = "left") -> DataFrame:
    """Rows joined with the table's intervals [low, high] that hold ``value``: an equi-join on buckets of ``width``.

    An interval is listed under each bucket that it touches, so no row is compared with the whole table.
    """
    right = table.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    left = df.withColumn("_v", value).withColumn("_bucket", F.floor(value / width))
    test = (left["_bucket"] == right["_bucket"]) & (left["_v"] >= right[low]) & (left["_v"] <= right[high])
    return left.join(right, test, how).drop("_v", "_bucket")


def address_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = sum((F.get(parts, i).try_cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, 0).try_cast("bigint") * 256**3)
    return F.when(good & F.forall(parts, lambda p: p.try_cast("int") <= 255), number)


def geo_lookup(df: DataFrame, table: DataFrame, ip: str, prefix_bits: int = 16) -> DataFrame:
    """Rows with the fields of the address range (columns ``first`` and ``last``, as text) that holds ``ip``."""
    ranges = table.withColumn("_low", address_number(F.col("first"))).withColumn("_high", address_number(F.col("last"))).drop("first", "last")
    return range_join(df, ranges, "_low", "_high", address_number(F.col(ip)), 2 ** (32 - prefix_bits)).drop("_low", "_high")


def memory_table(rows: DataFrame, ttl_s: int | None = None, now: Column | None = None, key: str = "key", value: str = "value", time_col: str = "ts", ttl_field: str | None = None) -> DataFrame:
    """key, value, ttl: the last value written under each key, without those older than their time to live in whole seconds."""
    at = F.col(time_col).cast("timestamp")
    life = F.coalesce(F.col(ttl_field).cast("bigint"), F.lit(ttl_s).cast("bigint")) if ttl_field else F.lit(ttl_s).cast("bigint")
    last = rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(F.col(value).alias("value"), at.alias("at"), life.alias("life")), at).alias("m")).select("key", "m.*")
    age = F.unix_seconds(F.current_timestamp() if now is None else now) - F.unix_seconds("at")
    out = last.withColumn("ttl", F.col("life") - age)
    return out.filter("life is null or ttl >= 0").select("key", "value", "ttl")


def is_member(df: DataFrame, members: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """Rows whose keys are among the members: exact, where a stream processor holds a Bloom or cuckoo filter."""
    return df.join(small(members.select(*keys).distinct()), list(keys), "left_anti" if negate else "left_semi")


def with_metadata(df: DataFrame, fields: Mapping[str, str | None], required: bool = True, tags: bool = False) -> DataFrame:
    """The same metadata for every row, as columns or as tags of metrics."""
    if required and (lacks := [k for k, v in fields.items() if v is None]):
        raise ValueError(f"metadata lacks {lacks}")
    known = {k: v for k, v in fields.items() if v is not None}
    if not tags:
        return df.withColumns({k: F.lit(v) for k, v in known.items()})
    own = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(F.lit(v)))])
    return df.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin(*known)), own))


def newest(table: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
