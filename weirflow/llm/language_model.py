"""Language-model scores by a hierarchical Pitman-Yor model of words in the context of the word before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import mix, staged, words

#: Restaurants: the word before, by its hash, among those whose ends are of one group. A group's restaurants share a parent, and the
#: parents share the root. Rare words may share a restaurant; a frequent one has nearly all customers of its own.
GROUP_BITS, OWN_BITS = 5, 11
CONTEXTS, PARENTS = 1 << GROUP_BITS + OWN_BITS, 1 << GROUP_BITS
END = np.uint64(1)
THETA = 1.0
#: Characters of text for a bucket of words.
BUCKET = 12_000_000
MESSAGE = "bucket int, chunk long, w binary, n binary, ctx binary, cnt binary"


def _messages(docs: DataFrame, buckets: int, tokens: int, kind: int) -> DataFrame:
    """The corpus in chunks: of each a message for each bucket of words (kind 0), or the places of its documents' tokens (kind 1).

    A message has the chunk's distinct words of the bucket, how many contexts each has, the contexts, and the
    training count of each. A place is the number of a token's pair of word and context among all the chunk's; with places
    the bucket is the number of pairs.
    """

    def chunk(number: int, ids: list, held: list, texts: list[str | None]) -> Iterator[dict]:
        hashed, counts, last, _ = words(texts, lower=True)
        total = len(hashed) + len(texts)
        ends = np.cumsum(counts + 1) - 1
        inner = np.ones(total, bool)
        inner[ends] = False
        token = np.full(total, END, np.uint64)
        token[inner] = np.maximum(hashed, np.uint64(2))
        own = np.zeros(total, np.int64)
        with np.errstate(over="ignore"):
            group = mix(last.astype(np.uint64) + END) & np.uint64(PARENTS - 1)
            own[inner] = (group << np.uint64(OWN_BITS) | mix(hashed) & np.uint64((1 << OWN_BITS) - 1)).astype(np.int64)
        context = np.concatenate([[0], own[:-1]])
        w, at = np.unique(token, return_inverse=True)
        pair, place = np.unique(at * CONTEXTS + context, return_inverse=True)
        if kind == 1:
            lost = np.array([i is None for i in ids])
            key = np.array([0 if i is None else i for i in ids], "<i8")
            flags = (np.array(held, bool) + 2 * lost).astype("u1")
            yield {"bucket": len(pair), "chunk": number, "w": key.tobytes(), "n": (counts + 1).astype("<u4").tobytes(), "ctx": flags.tobytes(), "cnt": _tight(place.astype("<u4"))}
            return
        learn = np.repeat(~np.array(held, bool), counts + 1)
        count = np.bincount(place[learn], minlength=len(pair)).astype("<u4")
        of, context = pair // CONTEXTS, (pair % CONTEXTS).astype("<u2")
        per = np.bincount(of, minlength=len(w)).astype("<u4")
        bucket = (w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        starts = np.append(0, np.cumsum(per, dtype=np.int64))
        for b in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[b], cuts[b + 1]
            p, q = starts[i], starts[j]
            yield {"bucket": b, "chunk": number, "w": w[i:j].astype("<u8").tobytes(), "n": per[i:j].tobytes(), "ctx": context[p:q].tobytes(), "cnt": count[p:q].tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch["id"], batch["held"], batch["text"]):
                ids.append(None if i is None else int(i))
                held.append(h)
                texts.append(t)
                size += len(t) if t else 1
                if size >= 6 * tokens:
                    yield pd.DataFrame(list(chunk(number, ids, held, texts)))
                    number += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pd.DataFrame(list(chunk(number, ids, held, texts)))

    # the id as text, since a null would turn numbers to floats on the way
    read = docs.select(F.col("doc_id").cast("string").alias("id"), held_out().alias("held"), "text")
    return read.mapInPandas(run, MESSAGE)


def _tight(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the high ones together, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view("u1").reshape(-1, 4).T).tobytes())


def _loose(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1").reshape(4, -1).T).view("<u4").ravel()


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _joined(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The messages of a bucket as one: words, word of each pair, contexts, counts; and each message's words and pairs in these."""
    w = [np.frombuffer(x, "<u8") for x in group["w"]]
    n = [np.frombuffer(x, "<u4") for x in group["n"]]
    ctx = [np.frombuffer(x, "<u2").astype(np.int64) for x in group["ctx"]]
    cnt = np.concatenate([np.frombuffer(x, "<u4") for x in group["cnt"]])
    every, at = np.unique(np.concatenate(w), return_inverse=True)
    of = np.repeat(at, np.concatenate(n))
    pair, place = np.unique(of * CONTEXTS + np.concatenate(ctx), return_inverse=True)
    count = np.bincount(place, cnt, len(pair)).astype(np.int64)
    return every, pair // CONTEXTS, pair % CONTEXTS, count, np.split(at, np.cumsum([len(x) for x in w])[:-1]), np.split(place, np.cumsum([len(x) for x in ctx])[:-1])


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that serve a word in a restaurant, after all its customers have been seated anew, one by one.

    The next customer opens a table with odds ``fresh`` (strength and discounted tables, times the parent's
    probability) against customers less discounted tables. A sixteenth of those who sit are seated at once, one at least.
    """
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], fresh[order]
    tables = (c > 0).astype(np.float64)
    at, active = 1, int((c > 1).sum())
    while active:
        block = max(1, at // 16)
        n = np.minimum(block, c[:active] - at)
        p = a[:active] / (at + (n - 1) / 2 - discount * tables[:active] + a[:active])
        tables[:active] += rng.binomial(n, np.clip(p, 0, 1))
        at += block
        active = int(np.searchsorted(-c[:active], -at, "left"))
    out = np.empty(len(c))
    out[order] = tables
    return out


class Bucket:
    """The words of a bucket, all their seats at the three levels, and the sweeps over them."""

    def __init__(self, number: int, of: np.ndarray, ctx: np.ndarray, count: np.ndarray, words: int, seed: int):
        self.number, self.of, self.ctx, self.count, self.seed = number, of, ctx, count, seed
        self.middle, self.to_middle = np.unique(of * PARENTS + (ctx >> OWN_BITS), return_inverse=True)
        self.words = words
        self.word_of, self.parent = self.middle // PARENTS, self.middle % PARENTS

    def sweeps(self, known: list[dict], tokens: int) -> Iterator[dict]:
        """First one table for each word in each restaurant, then seats sampled given the sweep before; its totals follow in ``known``."""
        for s in range(tokens):
            if s == 0:
                t2 = (self.count > 0).astype(float)
                c1 = np.bincount(self.to_middle, t2, len(self.middle))
                t1 = (c1 > 0).astype(float)
                c0 = np.bincount(self.word_of, t1, self.words)
                t0 = (c0 > 0).astype(float)
            else:
                k, rng = known[s - 1], np.random.default_rng([self.seed, self.number, s])
                d = k["discount"]
                t2 = seated(self.count, (THETA + d[2] * k["t2"][self.ctx]) * p1[self.to_middle], d[2], rng)
                c1 = np.bincount(self.to_middle, t2, len(self.middle))
                t1 = seated(c1.astype(np.int64), (THETA + d[1] * k["t1"][self.parent]) * p0[self.word_of], d[1], rng)
                c0 = np.bincount(self.word_of, t1, self.words)
                t0 = seated(c0.astype(np.int64), np.full(self.words, (THETA + d[0] * k["t0"]) * k["base"]), d[0], rng)
            now = {"t2": t2, "c1": c1, "t1": t1, "c0": c0, "t0": t0}
            if s < len(known):
                k = known[s]
                d = k["discount"]
                p0 = (c0 - d[0] * t0 + (THETA + d[0] * k["t0"]) * k["base"]) / (THETA + k["c0"])
                p1 = (c1 - d[1] * t1 + (THETA + d[1] * k["t1"][self.parent]) * p0[self.word_of]) / (THETA + k["c1"][self.parent])
                now["p2"] = (self.count - d[2] * t2 + (THETA + d[2] * k["t2"][self.ctx]) * p1[self.to_middle]) / (THETA + k["c2"][self.ctx])
            yield now


def summed(b: Bucket, now: dict) -> pd.DataFrame:
    """What each restaurant holds of a bucket's words: customers, tables, and how many words have one customer or two."""
    out = []
    for level, where, c, t in ((2, b.ctx, b.count, now["t2"]), (1, b.parent, now["c1"], now["t1"]), (0, np.zeros(b.words, np.int64), now["c0"], now["t0"])):
        places, at = np.unique(where, return_inverse=True)
        sums = [np.bincount(at, x, len(places)) for x in (c, t, c == 1, c == 2)]
        out.append(pd.DataFrame({"level": level, "place": places, "c": sums[0], "t": sums[1], "once": sums[2], "twice": sums[3]}))
    return pd.concat(out)


def _totals(merged: DataFrame, known: list[dict], seed: int) -> dict:
    """What all restaurants of a sweep hold, summed over the buckets: at most 65,536 + 32 + 1 of them, however large the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                of = np.repeat(np.arange(row.words), np.frombuffer(row.n, "<u4"))
                ctx, count = np.frombuffer(row.ctx, "<u2").astype(np.int64), np.frombuffer(row.cnt, row.kind).astype(np.int64)
                b = Bucket(int(row.bucket), of, ctx, count, int(row.words), seed)
                *_, now = b.sweeps(known, len(known) + 1)
                yield summed(b, now)

    rows = merged.mapInPandas(run, "level int, place long, c double, t double, once double, twice double").groupBy("level", "place").agg(*[F.sum(x).alias(x) for x in ("c", "t", "once", "twice")])
    return gathered(rows.toPandas())


def gathered(rows: pd.DataFrame) -> dict:
    """Customers and tables of all restaurants as arrays, and each level's discount from the words seen once and twice."""
    out: dict = {"c2": np.zeros(CONTEXTS), "t2": np.zeros(CONTEXTS), "c1": np.zeros(PARENTS), "t1": np.zeros(PARENTS), "c0": 0.0, "t0": 0.0, "discount": []}
    for level in range(3):
        some = rows[rows["level"] == level]
        once, twice = some["once"].sum(), some["twice"].sum()
        out["discount"].append(float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5)
        if level:
            out[f"c{level}"][some["place"]], out[f"t{level}"][some["place"]] = some["c"], some["t"]
        else:
            out["c0"], out["t0"] = float(some["c"].sum()), float(some["t"].sum())
    return out


def scored(docs: DataFrame, sweeps: int = 3, burn: int = 1, tokens: int = 2_000_000, seed: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Tokens: lower-cased words, then one end. The model's restaurants are of the words that follow a word, 65,536 by the hash
    of that word; words whose ends are of one of 32 groups share a parent and these share the root, over a uniform base that
    has one place for all unknown words, so the probabilities after any context sum to one. ``sweeps`` rounds of
    sampling seat all customers anew, one after another, given all restaurants' totals of the round before; discounts follow from the
    words seen once and twice; the predictive probabilities of the rounds after ``burn`` are averaged.
    All counts are of all training documents. The corpus is exchanged as arrays: each chunk asks every bucket of
    words once for what it needs, and the bucket answers with counts and probabilities. So ``docs`` is read three times, and
    must give the same rows in the same partitions each time, as a table does; else the job fails. Null texts count as empty: one
    end. A null doc_id belongs to training; repeated rows count each time; an empty table gives an empty result.
    """
    # buckets by the size of the corpus, so that one is as much work whatever that is
    buckets = max(16, -(-int(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET))
    messages = _messages(docs, buckets, tokens, 0)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        w, of, ctx, count, _, _ = _joined(group)
        n = np.bincount(of, minlength=len(w)).astype("<u4")
        total = np.bincount(of, count, len(w))
        kind = "<u4" if count.max(initial=0) < 2**32 else "<u8"
        return pd.DataFrame([{"bucket": group["bucket"].iloc[0], "words": len(w), "n": n.tobytes(), "ctx": ctx.astype("<u2").tobytes(), "cnt": count.astype(kind).tobytes(), "kind": kind, "tokens": int(count.sum()), "known": int((total > 0).sum())}])

    merged = staged(messages.groupBy("bucket").applyInPandas(merge, "bucket int, words long, n binary, ctx binary, cnt binary, kind string, tokens long, known long"))
    n, v = (int(x or 0) for x in merged.agg(F.sum("tokens"), F.sum("known")).first())
    known: list[dict] = []
    for _ in range(sweeps + 1):
        known.append(_totals(merged, known, seed) | {"base": 1 / (v + 1)})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        w, of, ctx, count, of_words, of_pairs = _joined(group)
        bucket = Bucket(int(group["bucket"].iloc[0]), of, ctx, count, len(w), seed)
        p = sum(now["p2"] for s, now in enumerate(bucket.sweeps(known, sweeps + 1)) if s > burn) / (sweeps - burn)
        total, logs = np.bincount(of, count, len(w)).astype("<u8"), np.log10(p).astype("<f4")
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "n": [total[i].tobytes() for i in of_words], "per": group["n"], "logs": [logs[i].tobytes() for i in of_pairs]})

    answers = messages.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, n binary, per binary, logs binary")

    def score(places: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values("bucket")
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in replies[name]])
        per_word = read("n", "<u8").astype(np.float64)
        c = np.repeat(per_word, read("per", "<u4"))
        logs = read("logs", "<f4").astype(np.float64)
        out = []
        for row in places.itertuples():
            length = np.frombuffer(row.n, "<u4").astype(np.int64)
            place, starts = _loose(row.cnt), np.cumsum(length) - length
            if row.bucket != len(logs):
                raise ValueError("the documents were read in another order the second time")
            flags = np.frombuffer(row.ctx, "u1")
            ids = pd.array(np.frombuffer(row.w, "<i8"), "Int64")
            ids[(flags & 2) > 0] = pd.NA
            base = np.log10((c + 1) / (n + v + 1))
            sums = [np.add.reduceat(x[place], starts) for x in ((c > 0).astype(np.int64), base, logs)]
            out.append(pd.DataFrame({"doc_id": ids, "held_out": (flags & 1) > 0, "n_tokens": length, "n_known": sums[0], "train_tokens": n, "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    places = _messages(docs, buckets, tokens, 1)
    return places.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
