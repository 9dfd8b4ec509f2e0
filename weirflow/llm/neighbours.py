"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, usable

#: Coordinates of the second hash at most, so that its signed axes fit MASK bits.
SECOND, MASK = 64, 128
#: Points of a task; how far a cosine in half precision may be off, with room.
MOST, SLACK = 2048, 0.002
#: Pairs of points tried in each table for the chance that a neighbour is found.
TRIALS = 256
KEYS = ["dim", "tab", "one", "part"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def heights(x: np.ndarray, table: int, which: int, seed: int) -> np.ndarray:
    """Heights of each row along the signed axes 2i (plus) and 2i+1 (minus), after pseudo-rotations HD3 HD2 HD1.

    The second hash of a table takes SECOND coordinates of its rotation at most.
    """
    n, d = x.shape
    width = 1 << max(0, d - 1).bit_length()
    rng = np.random.default_rng([seed, table, which, width])
    y = np.zeros((n, width))
    y[:, :d] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    y = y[:, :SECOND] if which else y
    return np.stack([y, -y], 2).reshape(n, -1)


def codes(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """Of each row and table the nearest signed axes of both hashes, as one number."""
    return np.stack([heights(x, t, 0, seed).argmax(1) * MASK + heights(x, t, 1, seed).argmax(1) for t in range(tables)], 1).astype(">i4")


def probes(x: np.ndarray, table: int, count: int, seed: int) -> np.ndarray:
    """The ``count`` pairs of axes with the largest sums of heights."""
    one, two = heights(x, table, 0, seed), heights(x, table, 1, seed)
    total = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
    best = np.argpartition(-total, min(count, total.shape[1]) - 1, axis=1)[:, :count]
    return best // two.shape[1] * MASK + best % two.shape[1]


@cache
def sure(width: int, tables: int, count: int, seed: int, miss: float) -> float:
    """The least cosine at which a point lies in a cell that its query probes, in any table, but for a chance of ``miss``.

    Tried with random pairs of points of ``width`` coordinates, a power of two: rotations make the chance in a table that of any pair
    at this cosine, and tables miss it independently.
    """
    if 2 * width * min(2 * width, MASK) <= count:
        return -2.0
    if width == 1:
        return 1.0
    rng = np.random.default_rng([seed, width])
    x, z = rng.standard_normal((2, TRIALS, width))
    x /= np.sqrt((x * x).sum(1))[:, None]
    z -= (x * z).sum(1)[:, None] * x
    z /= np.sqrt((z * z).sum(1))[:, None]
    axes = [(heights(x, t, 0, seed), heights(x, t, 1, seed)) for t in range(tables)]
    axes = [(one, two, np.sort(two, 1)) for one, two in axes]

    def missed(at: float) -> float:
        y, chance = at * x + np.sqrt(1 - at * at) * z, 1.0
        for t, (one, two, rising) in enumerate(axes):
            a, b = heights(y, t, 0, seed).argmax(1), heights(y, t, 1, seed).argmax(1)
            # pairs of axes that the query probes before the point's
            before = [two[i].size * one[i].size - np.searchsorted(rising[i], one[i, a[i]] + two[i, b[i]] + 1e-12 - one[i], "right").sum() for i in range(TRIALS)]
            chance *= np.mean(np.array(before) >= count)
        return chance

    low, high = -1.0, 1.0
    while high - low > 0.005:
        at = (low + high) / 2
        low, high = (low, at) if missed(at) <= miss else (at, high)
    return high


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in doubles."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _unit(x: list[bytes], kind: str, dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(x), kind).reshape(-1, dim).astype(np.float64)
    m = m / np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def _coded(classes: DataFrame, kind: str, tables: int, seed: int) -> DataFrame:
    """Each class with its point as bytes and its codes in all tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [np.asarray(v, kind).tobytes() for v in batch["embedding"]]
            dims = batch["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = [raw[i] for i in at]
                found = codes(_unit(x, kind, int(dim)), tables, seed)
                yield pd.DataFrame({"rep": batch["rep"].to_numpy()[at], "dim": dim, "x": x, "codes": [c.tobytes() for c in found]})

    return classes.select("rep", "embedding").mapInPandas(run, "rep long, dim int, x binary, codes binary")


class Cells:
    """How the cells of a table, the pairs of axes, are dealt to parts: small ones of one first axis together, a large one to several."""

    def __init__(self, counts: pd.DataFrame):
        counts = counts.sort_values(["dim", "tab", "code"]).reset_index(drop=True)
        self.key = (counts["dim"].to_numpy(np.int64) << 40) | (counts["tab"].to_numpy(np.int64) << 32) | counts["code"].to_numpy(np.int64)
        n = counts["n"].to_numpy(np.int64)
        upto = np.cumsum(n)
        first = np.flatnonzero(np.diff(self.key // MASK, prepend=-1))
        begin = np.repeat((upto - n)[first], np.diff(np.append(first, len(n))))
        self.low, self.high = (upto - n - begin) // MOST, (upto - 1 - begin) // MOST

    def of(self, dim: int, tab: int, code: np.ndarray) -> np.ndarray:
        """Numbers of the cells; -1 where nothing is in one."""
        key = (np.int64(dim) << 40) | (np.int64(tab) << 32) | code.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(key.shape, -1)


_ROW = "dim int, tab int, one int, part int, query boolean, rep long, code int, mask binary, x binary"


def _index(coded: DataFrame, kind: str, cells: Cells, tables: int) -> DataFrame:
    """Each point in every table, in the part of its cell that its id picks; in half precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                half = [v.tobytes() for v in _unit(part["x"].tolist(), kind, dim).astype("<f2")]
                code, rep = np.frombuffer(b"".join(part["codes"]), ">i4").reshape(-1, tables), part["rep"].to_numpy()
                for tab in range(tables):
                    at = cells.of(dim, tab, code[:, tab])
                    low, high = cells.low[at], cells.high[at]
                    mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    yield pd.DataFrame({"dim": dim, "tab": tab, "one": code[:, tab] // MASK, "part": low + mixed.astype(np.int64) % (high - low + 1), "query": False, "rep": rep, "code": code[:, tab] % MASK, "mask": None, "x": half})

    return coded.select("rep", "dim", "x", "codes").mapInPandas(run, _ROW)


def _asked(wanted: DataFrame, kind: str, cells: Cells, tables: int, count: int, seed: int) -> DataFrame:
    """Each query once for each part that holds a cell it probes, with the second axes it probes there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                unit = _unit(part["x"].tolist(), kind, dim)
                half, rep = [v.tobytes() for v in unit.astype("<f2")], part["rep"].to_numpy()
                for tab in range(tables):
                    at = cells.of(dim, tab, probes(unit, tab, count, seed))
                    row, column = np.nonzero(at >= 0)
                    cell = at[row, column]
                    times = cells.high[cell] - cells.low[cell] + 1
                    row, again = np.repeat(row, times), np.repeat(cell, times)
                    place = cells.low[again] + np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    code = cells.key[again] & 0xFFFFFFFF
                    group, to = np.unique(np.stack([row, code // MASK, place]), axis=1, return_inverse=True)
                    bits = np.zeros((group.shape[1], MASK), bool)
                    bits[to.ravel(), code % MASK] = True
                    mask = [m.tobytes() for m in np.packbits(bits, axis=1)]
                    yield pd.DataFrame({"dim": dim, "tab": tab, "one": group[1], "part": group[2], "query": True, "rep": rep[group[0]], "code": 0, "mask": mask, "x": [half[i] for i in group[0]]})

    return wanted.select("rep", "dim", "x").mapInPandas(run, _ROW)


def _everywhere(wanted: DataFrame, kind: str, cells: Cells) -> DataFrame:
    """Each query once for each part of the first table, with all second axes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                at = np.flatnonzero(cells.key >> 32 == dim << 8)
                parts = pd.Series(cells.high[at] + 1).groupby((cells.key[at] & 0xFFFFFFFF) // MASK).max()
                one, place = np.repeat(parts.index.to_numpy(), parts), np.concatenate([np.arange(n) for n in parts])
                for rep, v in zip(part["rep"], _unit(part["x"].tolist(), kind, dim).astype("<f2")):
                    yield pd.DataFrame({"dim": dim, "tab": 0, "one": one, "part": place, "query": True, "rep": rep, "code": 0, "mask": b"\xff" * (MASK // 8), "x": v.tobytes()})

    return wanted.select("rep", "dim", "x").mapInPandas(run, _ROW)


def _best(keep: int):
    """Of the cells that each query probes in a part, the nearest ``keep`` and what half precision can't tell from them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["query"].to_numpy(bool)
        q, c = group[asks], group[~asks]
        if not len(q) or not len(c):
            return pd.DataFrame({"q": [], "rep": [], "near": []})
        dim = int(group["dim"].iloc[0])
        read = lambda g: np.frombuffer(b"".join(g["x"]), "<f2").reshape(-1, dim).astype(np.float32)
        y, q_ids, c_ids, code, out = read(c), q["rep"].to_numpy(), c["rep"].to_numpy(), c["code"].to_numpy(), []
        bits = np.unpackbits(np.frombuffer(b"".join(q["mask"]), np.uint8).reshape(-1, MASK // 8), axis=1).astype(bool)
        x = read(q)
        for at in range(0, len(x), 512):
            near = np.where(bits[at : at + 512][:, code], x[at : at + 512] @ y.T, -3)
            least = np.partition(near, -keep, axis=1)[:, -keep] if near.shape[1] > keep else np.full(len(near), -2.5)
            i, j = np.nonzero((near >= least[:, None] - 2 * SLACK) & (near > -2.5))
            out.append(pd.DataFrame({"q": q_ids[at + i], "rep": c_ids[j], "near": near[i, j].astype(np.float64)}))
        return pd.concat(out)

    return run


def _searched(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """q, rep: for each query what may be among its nearest ``keep`` classes of those found; a task holds MOST points and the queries that probe them.

    Queries of a part are dealt out too, so that a crowded part's queries need not meet in one task.
    """
    asked = staged(queries)
    crowd = staged(asked.groupBy(*KEYS).count().select(*KEYS, F.ceil(F.col("count") / MOST).cast("int").alias("n")))
    # a point goes to as many tasks as its part's queries fill; to none if no query probes the part
    left = index.join(crowd, KEYS).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    right = asked.join(crowd, KEYS).withColumn("deal", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).drop("n")
    found = left.unionByName(right).groupBy(*KEYS, "deal").applyInPandas(_best(keep), "q long, rep long, near double")
    each = staged(found.groupBy("q", "rep").agg(F.max("near").alias("near")))
    by = Window.partitionBy("q").orderBy(F.desc("near"), "rep")
    last = each.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= keep).groupBy("q").agg(F.min("near").alias("last"))
    return each.join(last, "q").filter(F.col("near") >= F.col("last") - 2 * SLACK).select("q", "rep")


def _exact(pairs: DataFrame, coded: DataFrame, kind: str) -> DataFrame:
    """The pairs with the cosine of the original points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.zeros(len(batch))
            for dim, at in batch.groupby("dim").indices.items():
                x, y = (np.frombuffer(b"".join(batch[c].iloc[at]), kind).reshape(-1, dim).astype(np.float64) for c in ("x", "y"))
                score[at] = cosine(x, y)
            yield batch[["q", "rep"]].assign(score=score)

    left, right = coded.select(F.col("rep").alias("q"), "dim", "x"), coded.select("rep", F.col("x").alias("y"))
    return pairs.join(left, "q").join(right, "rep").select("q", "rep", "dim", "x", "y").mapInPandas(run, "q long, rep long, score double")


def _hits(found: DataFrame, coded: DataFrame, classes: DataFrame, kind: str, k: int) -> DataFrame:
    """q, hits: for each query the k+1 nearest ids of the classes found, itself among them, by exact cosine."""
    scored = _exact(found, coded, kind)
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = scored.withColumn("n", F.row_number().over(by_class)).filter(F.col("n") <= k + 1).drop("n")
    spread = top.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return staged(spread.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("hits")))


def nearest(points: DataFrame, is_query: Column, k: int = 5, tables: int = 6, count: int = 1000, seed: int = 3, miss: float = 0.01) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found of every row that ``is_query`` selects.

    Equal points are one class: it is hashed once and stands for its k+1 smallest ids, which is all that an answer can
    hold of them. In every table two hashes give a class its cell, a pair of signed axes; a query looks in the ``count`` cells
    whose axes are nearest to it, however many rows there are, and what it finds is ranked by exact cosine of the original points.
    Cells are dealt to tasks by what they hold, so that the share of rows a query meets is that of its cells however large the
    table; how many rows each cell holds is all that reaches the driver. A query is compared with all rows, in blocks, if it finds
    fewer than k, or if a row as near as the k-th it finds would have been missed with a chance of more than ``miss``, which depends on
    that cosine only; in a table of far points that may be every query. Points are compared with those of their own length only.
    Null, zero or non-finite points and null ids take no part; repeated ids count as rows of their own, except that a query never
    finds its own id; an empty table gives an empty result.
    """
    rows = usable(points).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    kind = "<f4" if "float" in points.schema["embedding"].dataType.simpleString() else "<f8"
    first = Window.partitionBy("h", "g").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = staged(few.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    coded = staged(_coded(classes, kind, tables, seed))
    classes = classes.drop("embedding")
    askers = staged(rows.filter(is_query).select("vec_id", "h", "g").join(classes.select("h", "g", "rep"), ["h", "g"]).select("vec_id", F.col("rep").alias("q")))
    wanted = staged(askers.select(F.col("q").alias("rep")).distinct().join(coded, "rep"))
    listed = coded.select("dim", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.conv(F.hex(F.substring("codes", t * 4 + 1, 4)), 16, 10).cast("long"))).alias("tab", "code"))
    cells = Cells(listed.groupBy("dim", "tab", "code").agg(F.count("*").alias("n")).toPandas())
    index = _index(coded, kind, cells, tables)
    found = staged(_searched(index, _asked(wanted, kind, cells, tables, count, seed), k + 1))
    hits = _hits(found, coded, classes, kind, k)
    width = {int(d): 1 << (int(d) - 1).bit_length() for d in np.unique(cells.key >> 40)}
    least = points.sparkSession.createDataFrame([(d, sure(w, tables, count, seed, miss)) for d, w in width.items()], "dim int, least double")
    # copies count: the k-th of the other ids stands behind the query's own
    kth = hits.filter(F.size("hits") > k).select(F.col("q").alias("rep"), (-F.col("hits")[k]["s"]).alias("kth"))
    short = staged(wanted.join(kth.join(wanted.select("rep", "dim"), "rep").join(F.broadcast(least), "dim").filter("kth >= least").select("rep"), "rep", "left_anti"))
    if short.head(1):
        again = _hits(staged(_searched(index.filter("tab = 0"), _everywhere(short, kind, cells), k + 1)), coded, classes, kind, k)
        hits = hits.join(short.select(F.col("rep").alias("q")), "q", "left_anti").union(again)
    hits = askers.join(hits, "q").select("vec_id", F.slice(F.filter("hits", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("hits"))
    return hits.select(F.col("vec_id").alias("query_id"), F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
