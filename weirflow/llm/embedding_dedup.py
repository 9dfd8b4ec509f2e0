"""Near-duplicate embeddings by sorted projection passes: bounded windows of neighbours in several lexicographic orders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import components, sound, staged, usable

BITS = 63
#: Rows of a block: a window reaches back to the start of the block before. Rows that are bounded together; of a tile; of a task of small components.
BLOCK, CHUNK, TILE, TASK = 1024, 512, 2048, 8192
#: The share of pairs at the least similarity that no pass need bring together, of points spread evenly.
MISSED = 0.001


def passes(classes: int, least: float) -> int:
    """How many orders it takes: a pair agrees in a hash with one less its angle over pi, and meets if it agrees in as many
    hashes as there are blocks to tell apart. More for more points."""
    apart = math.log2(max(1.0, classes / BLOCK))
    meets = (1 - math.acos(min(1.0, least)) / math.pi) ** apart
    return 1 if meets == 1 else math.ceil(math.log(MISSED) / math.log(1 - meets))


def _compact(classes: DataFrame, kind: str) -> DataFrame:
    """The points as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [np.asarray(v, kind) for v in batch["embedding"]]
            yield batch.drop(columns="embedding").assign(dim=[len(v) for v in x], x=[v.tobytes() for v in x])

    return classes.select("h", "g", "rep", "copies", "embedding").mapInPandas(run, "h long, g long, rep long, copies long, dim int, x binary")


def _unit(x: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Rows of one length as unit points in double precision."""
    m = np.frombuffer(b"".join(x), kind).reshape(-1, dim).astype(np.float64)
    m = m / np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def _coded(classes: DataFrame, kind: str, orders: int, seed: int) -> DataFrame:
    """A row for each point and order: the signs of random projections, concatenated to one number that sorts
    lexicographically, and the unit point in half precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                unit = _unit(part["x"].tolist(), kind, dim)
                half = [v.tobytes() for v in unit.astype("<f2")]
                for order in range(orders):
                    signs = unit @ np.random.default_rng([seed, dim, order]).normal(size=(dim, BITS)) > 0
                    code = np.zeros(len(unit), np.int64)
                    for i in range(BITS):
                        code = code << 1 | signs[:, i]
                    yield pd.DataFrame({"order": order, "dim": dim, "code": code, "rep": part["rep"].to_numpy(), "x": half})

    return classes.select("rep", "dim", "x").mapInPandas(run, "order int, dim int, code long, rep long, x binary")


def _span(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Which of the links i-j join what was apart; ``parent`` has the root of every place, before and after."""
    kept = []
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return kept
        for k in np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]).tolist():
            x, y = int(a[k]), int(b[k])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((int(i[k]), int(j[k])))
        while ((up := parent[parent]) != parent).any():
            parent[:] = up


def _near(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (of x alone, or of x and y) in half precision that link or may link, and which of them surely do."""
    # a component is off by 2**-11 of itself at most, so each point by that, and the product by twice that
    slack = 2.1 * 2.0**-11 + (x.shape[1] + 8) * 2.0**-23
    s = x @ (x if y is None else y).T
    i, j = np.nonzero(s >= least - slack)
    if y is None:
        i, j = i[i < j], j[i < j]
    return i, j, s[i, j] >= least + slack


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> pd.DataFrame:
    """Of the pairs of places i-j the sure ones that join components, and those to be verified between what these leave apart."""
    parent = np.arange(len(ids))
    kept = np.array(_span(parent, i[sure], j[sure]), np.int64).reshape(-1, 2)
    i, j = i[~sure], j[~sure]
    apart = parent[i] != parent[j]
    i, j = i[apart], j[apart]
    return pd.DataFrame({"a": ids[np.concatenate([kept[:, 0], i])], "b": ids[np.concatenate([kept[:, 1], j])], "sure": np.arange(len(kept) + len(i)) < len(kept)})


def _joined(rep: np.ndarray, x: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None, least: float) -> pd.DataFrame:
    """Of a block, and of it with the block before: sure links that join components, and pairs to be verified between what these leave apart."""
    i, j, sure = _near(x, None, least)
    ids = rep
    if before is not None:
        p, q, more = _near(before[1], x, least)
        ids = np.concatenate([rep, before[0]])
        i, j, sure = np.concatenate([i, p + len(rep)]), np.concatenate([j, q]), np.concatenate([sure, more])
    return _forest(ids, i, j, sure)


_FOUND = "a long, b long, sure boolean, edge long, side int, order int, dim int, reps binary, x binary"


def _windows(least: float):
    """Compares each block of a sorted partition with itself and the one before; the partition's first and last block come out too."""

    def edge(at: int, side: int, key: tuple[int, int], rep: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"edge": [at], "side": [side], "order": [key[0]], "dim": [key[1]], "reps": [rep.tobytes()], "x": [x.astype("<f2").tobytes()]})

    def shaped(df: pd.DataFrame) -> pd.DataFrame:
        out = df.reindex(columns=["a", "b", "sure", "edge", "side", "order", "dim", "reps", "x"])
        return out.astype({"a": "Int64", "b": "Int64", "sure": "boolean", "edge": "Int64", "side": "Int32", "order": "Int32", "dim": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, key, first = TaskContext.get().partitionId(), None, True
        reps, xs, size, before = [], [], 0, None

        def cut(upto: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal reps, xs, size
            rep, x = np.concatenate(reps), np.concatenate(xs)
            reps, xs, size = [rep[upto:]], [x[upto:]], len(rep) - min(upto, len(rep))
            return rep[:upto], x[:upto]

        def ended() -> Iterator[pd.DataFrame]:
            nonlocal before, first
            if size:
                block = cut(BLOCK)
                yield shaped(_joined(*block, before, least))
                if first:
                    yield shaped(edge(part - 1, 1, key, *block))
                    first = False
                before = block if before is None else tuple(np.concatenate([o, n])[-BLOCK:] for o, n in zip(before, block))

        for batch in batches:
            keys = batch["order"].to_numpy(np.int64) << 32 | batch["dim"].to_numpy(np.int64)
            starts = np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(batch))
            for p, q in zip(starts, starts[1:]):
                now = (int(batch["order"].iloc[p]), int(batch["dim"].iloc[p]))
                if key is not None and now != key:
                    yield from ended()
                    reps, xs, size, before, first = [], [], 0, None, False
                key = now
                reps.append(batch["rep"].to_numpy(np.int64)[p:q])
                xs.append(np.frombuffer(b"".join(batch["x"].iloc[p:q]), "<f2").reshape(-1, now[1]).astype(np.float32))
                size += q - p
                while size >= BLOCK:
                    block = cut(BLOCK)
                    yield shaped(_joined(*block, before, least))
                    if first:
                        yield shaped(edge(part - 1, 1, key, *block))
                        first = False
                    before = block
        if key is not None:
            yield from ended()
            if before is not None:
                yield shaped(edge(part, 0, key, *before))

    return run


def _across(least: float):
    """The last block of a partition with the first of the next one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("side")
        if len(group) < 2:
            return pd.DataFrame({"a": [], "b": [], "sure": []}, dtype="int64").astype({"sure": "bool"})
        dim = int(group["dim"].iloc[0])
        (p, x), (q, y) = [(np.frombuffer(r, np.int64), np.frombuffer(v, "<f2").reshape(-1, dim).astype(np.float32)) for r, v in zip(group["reps"], group["x"])]
        i, j, sure = _near(x, y, least)
        return _forest(np.concatenate([p, q]), i, j + len(p), sure)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, kind: str, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for dim, at in batch.groupby("dim").indices.items():
                x, y = _unit(batch["xa"].iloc[at].tolist(), kind, dim), _unit(batch["xb"].iloc[at].tolist(), kind, dim)
                good[at] = (x * y).sum(1) >= least
            yield batch.loc[good, ["a", "b"]]

    left, right = classes.select(F.col("rep").alias("a"), "dim", F.col("x").alias("xa")), classes.select(F.col("rep").alias("b"), F.col("x").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "dim", "xa", "xb").mapInPandas(run, "a long, b long")


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk: a direction, and the largest angle of its rows with it."""
    centres, widths = [], []
    for a in range(0, len(x), CHUNK):
        part = x[a : a + CHUNK]
        c = part.sum(0)
        c = c / n if (n := np.sqrt(c @ c)) > 1e-9 else part[0]
        centres.append(c)
        widths.append(np.arccos(np.clip((part @ c).min(), -1, 1)))
    return np.array(centres), np.array(widths)


def _compare(x: np.ndarray, y: np.ndarray, more: np.ndarray, less: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many rows, of copies ``less`` and ``more``, each row of x and of y links with on the other side; not with itself.

    Products are single, within a bound of their error; what lies that near to ``least`` is done again in double. Chunks whose
    angles rule every link out or in are not multiplied.
    """
    dim = x.shape[1]
    slack, angle = (dim + 8) * 2.0**-23, np.arccos(min(1.0, least))
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    (cx, wx), (cy, wy) = _bounds(x), _bounds(y)
    between, wide = np.arccos(np.clip(cx @ cy.T, -1, 1)), wx[:, None] + wy[None, :]
    left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for p, a in enumerate(range(0, len(x), CHUNK)):
        for q, b in enumerate(range(0, len(y), CHUNK)):
            if between[p, q] - wide[p, q] > angle + 1e-6:
                continue
            u, v = slice(a, a + CHUNK), slice(b, b + CHUNK)
            if between[p, q] + wide[p, q] < angle - 1e-6:
                good = np.ones((len(x4[u]), len(y4[v])), bool)
            else:
                s = x4[u] @ y4[v].T
                good = s >= least + slack
                i, j = np.nonzero((s >= least - slack) & ~good)
                good[i, j] = (x[a + i] * y[b + j]).sum(1) >= least
            if same and a == b:
                np.fill_diagonal(good, False)
            left[u] += good @ less[v]
            right[v] += more[u] @ good
    return left, right


def _small(kind: str, least: float):
    """Links of each class within its component, of many whole components together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("root", kind="stable").reset_index(drop=True)
        cuts = np.append(np.flatnonzero(np.diff(group["root"].to_numpy(), prepend=group["root"].iloc[0] - 1)), len(group))
        copies, links = group["copies"].to_numpy(np.int64), np.zeros(len(group), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            x = _unit(group["x"].iloc[a:b].tolist(), kind, int(group["dim"].iloc[a]))
            links[a:b] = _compare(x, x, copies[a:b], copies[a:b], True, least)[0]
        return pd.DataFrame({"rep": group["rep"], "links": links})

    return run


def _tile(kind: str):
    """Of a tile of a large component: a direction, the largest angle with it, and its copies."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(group["x"].tolist(), kind, int(group["dim"].iloc[0]))
        c = x.sum(0)
        c = c / n if (n := np.sqrt(c @ c)) > 1e-9 else x[0]
        wide = float(np.arccos(np.clip((x @ c).min(), -1, 1)))
        return pd.DataFrame({"root": group["root"].iloc[:1], "tile": group["tile"].iloc[:1], "centre": [c.tobytes()], "wide": [wide], "held": [int(group["copies"].sum())]})

    return run


def _sorted_out(least: float):
    """Pairs of tiles: those that cannot link go; of the others, whether every row links with every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        angle = np.arccos(min(1.0, least))
        for batch in batches:
            dot = np.array([np.frombuffer(p) @ np.frombuffer(q) for p, q in zip(batch["centre"], batch["centre2"])])
            between, wide = np.arccos(np.clip(dot, -1, 1)), batch["wide"].to_numpy() + batch["wide2"].to_numpy()
            out = batch.assign(all=between + wide < angle - 1e-6)
            yield out.loc[between - wide <= angle + 1e-6, ["root", "tile", "tile2", "held", "held2", "all"]]

    return run


def _pair_of_tiles(kind: str, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        same = (group["tile"] == group["tile2"]).all()
        first, second = (group, group) if same else (group[group["side"] == 0], group[group["side"] == 1])
        x, y = (_unit(g["x"].tolist(), kind, int(g["dim"].iloc[0])) for g in (first, second))
        left, right = _compare(x, y, first["copies"].to_numpy(np.int64), second["copies"].to_numpy(np.int64), same, least)
        parts = [pd.DataFrame({"rep": first["rep"], "links": left})] + ([] if same else [pd.DataFrame({"rep": second["rep"], "links": right})])
        return pd.concat(parts)

    return run


def _counted(classes: DataFrame, roots: DataFrame, kind: str, least: float) -> DataFrame:
    """rep and links of every class of a component: whole components are dealt to tasks by their number, large ones in tiles.

    Tiles whose angles decide every pair of their rows meet as two numbers only.
    """
    sizes = staged(roots.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("n")))
    rows = roots.join(sizes, "root").withColumnRenamed("node", "rep").join(classes.select("rep", "copies", "dim", "x"), "rep")
    rows = staged(rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")))
    tasks = max(1, -(-int(sizes.filter("tiles = 1").agg(F.sum("n")).first()[0] or 0) // TASK))
    whole = rows.filter("tiles = 1").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    out = whole.groupBy("task").applyInPandas(_small(kind, least), "rep long, links long")
    large = rows.filter("tiles > 1")
    tiles = staged(large.groupBy("root", "tile").applyInPandas(_tile(kind), "root long, tile int, centre binary, wide double, held long"))
    other = tiles.select("root", *[F.col(c).alias(f"{c}2") for c in ("tile", "centre", "wide", "held")])
    met = staged(tiles.join(other, "root").filter("tile <= tile2").mapInPandas(_sorted_out(least), "root long, tile int, tile2 int, held long, held2 long, all boolean"))
    sums = met.filter("all").select("root", "tile", F.when(F.col("tile") == F.col("tile2"), F.lit(0)).otherwise(F.col("held2")).alias("k"), (F.col("tile") == F.col("tile2")).cast("int").alias("own"), F.col("held").alias("mine"))
    sums = sums.select("root", "tile", (F.col("k") + F.col("own") * F.col("mine")).alias("k"), "own").unionByName(met.filter("all and tile < tile2").select("root", F.col("tile2").alias("tile"), F.col("held").alias("k"), F.lit(0).alias("own")))
    sums = sums.groupBy("root", "tile").agg(F.sum("k").alias("k"), F.max("own").alias("own"))
    decided = large.join(sums, ["root", "tile"]).select("rep", (F.col("k") - F.col("own") * F.col("copies")).alias("links"))
    open_ = met.filter("not all").select("root", "tile", "tile2")
    first = large.join(open_, ["root", "tile"]).withColumn("side", F.lit(0))
    second = large.withColumnRenamed("tile", "tile2").join(open_.filter("tile < tile2"), ["root", "tile2"]).withColumn("side", F.lit(1))
    cells = first.unionByName(second).select("root", "tile", "tile2", "side", "rep", "copies", "dim", "x")
    compared = cells.groupBy("root", "tile", "tile2").applyInPandas(_pair_of_tiles(kind, least), "rep long, links long")
    return staged(out.unionByName(decided).unionByName(compared).groupBy("rep").agg(F.sum("links").alias("links")))


def linked(points: DataFrame, least: float = 0.95, seed: int = 6) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal points are one class. In each of several orders the classes are sorted by the signs of random projections,
    concatenated, and every block of neighbours is compared with itself and the block before it, across partitions as well. Sure links
    are found in half precision, within a bound of its error; what lies that near to ``least`` is verified in double precision. The
    union of all orders gives the components. Then the links inside each component are counted, all of them, in double precision where
    a bound doesn't decide. A component is lost in part only if no order brings a link of it into a window: at ``least`` one
    pair in a thousand of evenly spread points (MISSED), and ever fewer above; the number of orders grows with the classes.
    Rows whose point is null, zero or not finite link with nothing: no links, a component of their own, kept. So do null
    ids, whose component is null. Points link only with those of their own length. Repeated ids are rows of their own; an
    empty table gives an empty result.
    """
    rows = usable(points).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    kind = "<f4" if "float" in points.schema["embedding"].dataType.simpleString() else "<f8"
    distinct = rows.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = staged(_compact(distinct, kind))
    total = classes.count()
    orders = passes(total, least)
    keys = ("order", "dim", "code", "rep")
    dealt = _coded(classes, kind, orders, seed).repartitionByRange(max(1, total * orders // (16 * BLOCK)), *keys).sortWithinPartitions(*keys)
    found = staged(dealt.mapInPandas(_windows(least), _FOUND))
    across = staged(found.filter("edge is not null").groupBy("edge", "order", "dim").applyInPandas(_across(least), "a long, b long, sure boolean"))
    pairs = found.filter("a is not null").select("a", "b", "sure").unionByName(across)
    more = _verified(pairs.filter("not sure").select("a", "b").distinct(), classes, kind, least)
    roots = staged(components(staged(pairs.filter("sure").select("a", "b").unionByName(more))))
    counts = _counted(classes, roots, kind, least)
    known = classes.join(roots, classes["rep"] == roots["node"], "left").join(counts, "rep", "left")
    known = staged(known.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    linked = rows.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = points.filter(F.col("vec_id").isNull() | ~sound(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
