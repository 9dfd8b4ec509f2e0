"""Order and sequence: row numbers, folds and staging that hold for keys of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="weirflow-plan-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/weirflow-plan-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back; a lost executor costs no recomputation of what came before."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OWNED: set[str] = set()

#: Rows of one key that a window may hold in one task.
HOT = 1_000_000


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_n") -> DataFrame:
    """``df`` with its row number (from 1) in ``order`` within ``keys``.

    With keys of HOT rows at most this is a window. Else a window would put all rows, or all of a key, in one task, so the rows are
    range-partitioned, sorted in place and staged, and each partition's rows are counted on from the rows before it.
    """
    if keys and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > HOT:
        ranged = [*keys, *order]
        dealt = staged(df.repartitionByRange(*ranged).sortWithinPartitions(*ranged).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
        begun = staged(dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c")))
        # a row for each key and partition that holds some of it; a hot key's partitions are few rows
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        begun = begun.withColumn("_before", before).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_before")
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = dealt.join(begun, same)
        return out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name)
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = staged(dealt.groupBy(part.alias("_part")).count())
    # a row for each partition of the range exchange, whatever the size of the table
    before = counts.selectExpr("_part", "coalesce(sum(count) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.expr("_at & 8589934591") + 1).drop("_at", "_part", "_before")


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``: an aggregation that is combined before the shuffle, so a hot key costs nothing."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    keyed = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keyed)]).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def fold(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], needs: Sequence[str], start: Callable[[], Callable], adds: str) -> DataFrame:
    """A sequential fold of each key's rows in ``order``, for state that no window expresses.

    ``start()`` makes a key's state: a callable that takes one row's values of ``needs`` and returns the values of the columns
    ``adds`` (a schema). Rows are dealt by key and sorted on disk; a task holds one batch and the state of one key, so memory
    does not grow with a key. The rows of a key run through one task, since each step needs the one before.
    """
    added = _parse_datatype_string(adds)
    keyed = [F.col(k) if isinstance(k, str) else k for k in keys]
    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keyed)])) if keyed else F.lit("")
    dealt = df.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", *order)
    out = StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in added.fields]])
    names, own = df.columns, [f.name for f in added.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            read = {c: batch.column(batch.schema.get_field_index(c)) for c in (*names, "_key")}
            found: list[tuple] = []
            for k, *row in zip(read["_key"].to_pylist(), *[read[c].to_pylist() for c in needs]):
                if step is None or k != last:
                    last, step = k, start()
                found.append(step(*row))
            more = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[read[c] for c in names], *more], [*names, *own])

    return dealt.mapInArrow(run, out)
