"""What several operators share: staging in the shared folder, components, words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster without it is refused.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="weirflow-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_OWNED: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/weirflow-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def staged(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, nothing is computed twice."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with _row (from 0, in the order given) and _total; equal rows come in any order among themselves.

    The rows are range-partitioned, sorted in place and written; then a prefix sum over one count a partition.
    """
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).count()
    before = staged(counts.selectExpr("_part", "coalesce(sum(count) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before", "sum(count) over () as _total"))
    # one row for each partition of the range exchange, so the size is bounded
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("_row", F.col("_before") + F.expr("_at & 8589934591")).drop("_at", "_part", "_before")


def sound(v: Column) -> Column:
    """Whether a point can be compared: not null, no null component, all finite, not zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(points: DataFrame, key: str = "vec_id", point: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows with a key whose point is sound."""
    return points.filter(F.col(key).isNotNull() & sound(F.col(point))).select(F.col(key).cast("long").alias("vec_id"), F.col(point).alias("embedding"))


def as_matrix(column) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges a-b join what earlier ones had not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b)."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # staged, so that the join's two sides come straight from an exchange and a hub's rows can be split
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return staged(out.filter("a != b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root: the smallest node reachable.

    Alternating large-star and small-star steps; a step is two joins whose hub rows can be split.
    """
    edges = staged(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    now = mark(edges)
    while now[0]:
        edges = _star(_star(edges, True), False)
        before, now = now, mark(edges)
        if now == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


# ---- words of many texts at once, as 64-bit hashes ----

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64, 2 * len(_POWERS)), _BASE)]).astype(np.uint64))
    return _POWERS


def runs(texts, most: int = 2_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, a longer text alone."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            out.append((start, i))
            start, size = i, 0
        size += n + 1
    return [*out, (start, len(texts))] if len(texts) else out


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: word hashes, words of each text, last byte and last byte but one of each word.

    Null is an empty text. Words are runs without ASCII white space; ``lower`` maps A-Z only.
    """
    parts = [_words(texts[a:b], lower) for a, b in runs(texts)] or [_words([], lower)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _words(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[buf]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(raw), np.int64), none.astype(np.uint8), none.astype(np.uint8)
    lengths = ends - starts
    inside = np.flatnonzero(~blank)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (_LOWER if lower else _BYTE)[buf[inside]] * _powers(int(lengths.max()) + 1)[offset]
    hashed = mix(np.add.reduceat(value, np.cumsum(lengths) - lengths))
    bounds = np.cumsum([1 + len(r) for r in raw])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    last = fold[buf[ends - 1]]
    before = np.where(lengths > 1, fold[buf[np.maximum(ends - 2, 0)]], 0).astype(np.uint8)
    return hashed, counts, last, before
