"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, mix, runs, staged, words

SHINGLE, BANDS, ROWS = 5, 36, 6
LOW48 = np.uint64(2**48 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together, by text and hash: number of the text, hash of a shingle (48 bits), how often it is there.

    A text of fewer than five words is one shingle of all its words; one without words has none. 65,536 texts at most.
    """
    hashed, counts, _, _ = words(texts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        if len(hashed) >= SHINGLE:
            whole = doc[: 1 - SHINGLE] == doc[SHINGLE - 1 :]
            n = len(whole)
            value = sum(hashed[i : n + i] * _PLACES[i] for i in range(SHINGLE))[whole]
            owner = doc[:n][whole]
        else:
            value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        less = np.array([sum((hashed[ends[d] - counts[d] + i] * _PLACES[i] for i in range(counts[d])), np.uint64(counts[d])) for d in short], np.uint64)
        value, owner = np.concatenate([value, less]), np.concatenate([owner, short])
        key = (owner.astype(np.uint64) << np.uint64(48)) | (mix(value) & LOW48)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & LOW48, times


def weight(times: np.ndarray) -> np.ndarray:
    """1 + ln of how often: a line that a text repeats weighs more than once, but not as often as it is repeated."""
    return 1 + np.log(times)


def probminhash(doc: np.ndarray, element: np.ndarray, w: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures, docs by m: in each register the element whose point came first.

    Each element is a Poisson process of rate w whose points fall on registers at random; two sets agree in a register
    with their probability Jaccard similarity. An element ends once its next point comes after the last of its
    set's registers was reached. Points depend on element and number only, never on what is processed together.
    """
    first, signature = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    time, alive, step = np.zeros(len(doc)), np.arange(len(doc)), 0
    latest = np.full(docs, np.inf)
    with np.errstate(over="ignore"):
        seed = mix(element * _PLACES[0] + GOLDEN)
        while len(alive):
            c = min(64, max(1, 100_000 // len(alive)))
            x = mix(seed[alive, None] + (np.arange(step + 1, step + c + 1, dtype=np.uint64) * GOLDEN)[None, :])
            at = time[alive, None] + np.cumsum(-np.log(((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / w[alive, None], axis=1)
            register = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            cell = (doc[alive, None] * m + register.astype(np.int64))
            counts = at < latest[doc[alive], None]
            cells, times = cell[counts], at[counts]
            np.minimum.at(first, cells, times)
            won = times == first[cells]
            signature[cells[won]] = np.broadcast_to(element[alive, None], at.shape)[counts][won]
            time[alive] = at[:, -1]
            step += c
            latest = first.reshape(docs, m).max(1)
            alive = alive[time[alive] < latest[doc[alive]]]
    return signature.reshape(docs, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    wa, wb = a[1], b[1]
    only_a, only_b = wa.sum() - wa[i].sum(), wb.sum() - wb[j].sum()
    # shared elements by their pair of weights: few distinct pairs
    pairs, n = np.unique(wa[i] + 1j * wb[j], return_counts=True)
    x, y = pairs.real, pairs.imag
    total = (n[None, :] * np.maximum(x[None, :] / x[:, None], y[None, :] / y[:, None])).sum(1) + only_a / x + only_b / y
    return float((n / total).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h, g (two hashes of the text), bands (null without words), sig (low 16 bits of each register)."""
    m = BANDS * ROWS
    places = np.random.default_rng(7).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in runs(batch["text"].tolist()):
                part = batch.iloc[a:b]
                doc, element, times = shingles(part["text"].tolist())
                sig = probminhash(doc, element, weight(times), len(part), m)
                with np.errstate(over="ignore"):
                    bands = mix((sig.reshape(-1, BANDS, ROWS) * places[None]).sum(2) + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
                full = np.bincount(doc, minlength=len(part)) > 0
                low = sig.astype("<u2")
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "g": part["g"].to_numpy(), "bands": [b if f else None for b, f in zip(bands, full)], "sig": [s.tobytes() if f else None for s, f in zip(low, full)]})

    return _keyed(docs).select("doc_id", "text", "h", "g").mapInPandas(run, "doc_id long, h long, g long, bands array<long>, sig binary")


def _hashes() -> list[Column]:
    return [F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(i), "text")).otherwise(F.xxhash64(F.lit(i + 2), F.col("doc_id").cast("long"))) for i in range(2)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, h and g (two hashes of the text) of the rows with a doc_id. A null text equals nothing but one of the same id."""
    hashes = [h.alias(n) for n, h in zip("hg", _hashes())]
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *hashes)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id (the node of ids), hashes (48 bits each) and times of the shingles of the texts in ids (doc_id, h, g, node)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, q in runs(batch["text"].tolist()):
                part = batch.iloc[p:q]
                doc, element, times = shingles(part["text"].tolist())
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                six = np.ascontiguousarray(element.astype("<u8").view("u1").reshape(-1, 8)[:, :6])
                rows = [(six[a:b].tobytes(), times[a:b].astype("<u4").tobytes() if (times[a:b] > 1).any() else b"") for a, b in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"id": part["node"].to_numpy(), "hashes": [r[0] for r in rows], "times": [r[1] for r in rows]})

    texts = _keyed(docs).join(ids.select("doc_id", "h", "g", "node"), ["doc_id", "h", "g"]).select("node", "text")
    return texts.mapInPandas(run, "id long, hashes binary, times binary")


def _load(hashes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    six = np.frombuffer(hashes, "u1").reshape(-1, 6)
    h = np.zeros((len(six), 8), "u1")
    h[:, :6] = six
    h = h.view("<u8").ravel()
    return h, weight(np.frombuffer(times, "<u4")) if times else np.ones(len(h))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(_load(p, q), _load(r, s)) >= least - 1e-12 for p, q, r, s in zip(batch["ha"], batch["ta"], batch["hb"], batch["tb"])]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("times").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("times").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ta", "hb", "tb").mapInPandas(run, "a long, b long")


def _joining(least: float):
    """Links that join components within a bucket, tile by tile.

    Pairs of different components are compared by signature, those near enough exactly. A pair that shares an earlier
    band was compared there. Only links that join what was still apart come out, never all pairs.
    """
    m = BANDS * ROWS
    floor = least - 5 * np.sqrt(least * (1 - least) / m)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(-1, m)
        doc, root, side, band = group["doc"].to_numpy(), group["root"].to_numpy().copy(), group["side"].to_numpy(), int(group["band"].iloc[0])
        hashes, times = group["hashes"].to_numpy(), group["times"].to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        out = []
        for i in left:
            other = right[(root[right] != root[i]) & ((side[right] == 2) | (doc[right] > doc[i]))]
            same = sig[other] == sig[i]
            near = same.mean(1) >= floor
            near &= ~same[:, : band * ROWS].reshape(len(other), band, ROWS).all(2).any(1)
            mine = _load(hashes[i], times[i])
            for j in other[near]:
                if root[i] != root[j] and similarity(mine, _load(hashes[j], times[j])) >= least - 1e-12:
                    out.append((doc[i], doc[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _classes(docs: DataFrame, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, g, class_id, kept of every different row; and the keys of rows that are there more than once."""
    # a row's place when it was written names it from here on
    made = staged(signatures(docs).withColumn("node", F.monotonically_increasing_id()))
    first = F.min(F.struct("doc_id", "node")).alias("rep")
    same = staged(made.groupBy("h", "g").agg(first, F.count("*").alias("n")).filter("n > 1").select("h", "g", F.col("rep.node").alias("rep")))
    copies = staged(made.select("node", "h", "g").join(same, ["h", "g"]).select(F.col("rep").alias("a"), F.col("node").alias("b")).filter("a != b"))
    ones = made.filter("bands is not null").select("node", "bands").join(copies.select(F.col("b").alias("node")), "node", "left_anti")
    rows = staged(ones.select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key")))
    shared = staged(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = staged(rows.join(shared, "key"))
    degree = staged(members.groupBy("doc").agg(F.sum("n").alias("degree")))
    ids = made.select("doc_id", "h", "g", "node").join(degree.select(F.col("doc").alias("node")), "node", "left_semi")
    sets = staged(_sets(docs, ids).dropDuplicates(["id"]))
    hubs = staged(members.join(degree, "doc").groupBy("key").agg((-F.max(F.struct("degree", -F.col("doc"))).getField("col2")).alias("hub")))
    pairs = staged(members.join(hubs, "key").filter("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    links = staged(verified(pairs, sets, least))
    roots = staged(components(links.union(copies)))
    # what a bucket still holds apart
    rooted = staged(members.filter("n > 2").join(roots, F.col("doc") == F.col("node"), "left").select("key", "band", "doc", F.coalesce("root", "doc").alias("root")))
    apart = staged(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / tile).cast("int").alias("n")).filter("x != y").select("key", "n"))
    i = F.pmod(F.xxhash64("doc"), F.col("n")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("side")))
    content = made.select(F.col("node").alias("doc"), "sig").join(sets.withColumnRenamed("id", "doc"), "doc")
    held = rooted.join(apart, "key").join(content, "doc").withColumn("i", i).withColumn("t", F.explode(both))
    held = held.select("key", "band", "doc", "root", "sig", "hashes", "times", "t.x", "t.y", "t.side")
    more = staged(held.groupBy("key", "x", "y").applyInPandas(_joining(least), "a long, b long").distinct())
    if more.head(1):
        roots = staged(components(links.union(copies).union(more)))
    slim = made.select("node", "doc_id", "h", "g")
    named = staged(slim.join(roots, "node"))
    stays = named.groupBy("root").agg(F.min(F.struct("doc_id", "h", "g")).alias("stays"))
    # rows that are in no class with others stand for themselves
    joined = named.join(stays, "root").select("doc_id", "h", "g", F.col("stays.doc_id").alias("class_id"), (F.struct("doc_id", "h", "g") == F.col("stays")).alias("kept"))
    alone = slim.join(roots.select("node"), "node", "left_anti").select("doc_id", "h", "g", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    again = staged(named.groupBy("doc_id", "h", "g").count().filter("count > 1").drop("count"))
    return joined.distinct().unionByName(alone), again


def classes(docs: DataFrame, least: float = 0.8, tile: int = 512) -> DataFrame:
    """doc_id, class_id, kept for every document; class_id: the smallest doc_id reachable over links.

    Links: equal texts, and probability Jaccard similarity of weighted five-word shingles of ``least`` or more.
    Equal texts are one class at once. In each band's bucket every document is verified against the one that
    shares most buckets with others, so that the text from which a group was copied finds all its copies. Documents of a
    bucket that are then still in different components are compared by signature, tile by tile, and verified if near.
    No bucket is dropped or cut. Null texts and texts without words link with nothing but equal texts that are not
    null; a null doc_id takes no part and is left out. Rows of one doc_id and text are one document and come out once; different
    texts under one doc_id are documents each. Of each class one document is kept. An empty table gives an empty
    result; other columns are not read.
    """
    return _classes(docs, least, tile)[0].select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame, least: float = 0.8, tile: int = 512) -> DataFrame:
    """One document of each class, with all columns; rows without a doc_id stay. Different texts under one doc_id are not copies."""
    found, again = _classes(docs, least, tile)
    gone = staged(found.filter("not kept").select("doc_id", "h", "g"))
    columns = docs.columns
    hashes = [h.alias(f"_key{i + 1}") for i, h in enumerate(_hashes())]
    keys = ["_key0", "_key1", "_key2"]
    rows = docs.filter("doc_id is not null").select(*[F.col(c) for c in columns], F.col("doc_id").cast("long").alias("_key0"), *hashes)
    gone, again = gone.toDF(*keys), again.toDF(*keys)
    once = rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    # what goes grows with the documents, so it is never broadcast, at no size
    return once.join(gone.hint("merge"), keys, "left_anti").select(*columns).unionByName(docs.filter("doc_id is null"))
