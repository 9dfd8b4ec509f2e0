"""Toxicity: a SVM over a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Letters that a symbol stands for in disguised words.
FOLD = str.maketrans("0134578@$!", "oieastbasi")
LETTERS, DECAY, POWER, WINDOW, STEP = 32, 0.7, 4, 14, 3
#: Similarities below this, before they are sharpened, are none.
SMALL = 0.25
#: Similarity to a telling landmark from which a word is read without a letter, and what such a reading costs in the decision.
NEAR, PUT_IN = 0.5, 0.1
#: Decisions above count as this much.
TOP = 2.0
EDGES = string.punctuation + "«»“”„‘’¿¡…–—·"
SIGNS = "".join(c for c in EDGES if ord(c) not in FOLD)
APART = re.compile(r"\s\S\s\S(?:\s|$)")
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def folded(word: str) -> str:
    """Lower case without punctuation at the ends, after a mark for the beginning; symbols inside become the letters that they stand for."""
    word = word.lower().strip(EDGES)
    return "^" + (word if word.isalpha() or word.isdigit() else word.translate(FOLD)) if word else ""


def closed(word: str) -> list[str]:
    """The word as it reads without the signs inside it, folded: once with symbols that stand for letters kept, once without them."""
    inner = word.strip(EDGES)
    if inner.isalnum():
        return []
    found = {folded("".join(c for c in inner if c not in signs)) for signs in (SIGNS, EDGES)}
    return sorted(w for w in found - {folded(word)} if len(w) > 3)


def shorter(word: str) -> list[str]:
    """A folded word without any one letter after its first, and without the second of all doubled letters."""
    once = re.sub(r"(.)\1+", r"\1", word)
    found = {w[:i] + w[i + 1 :] for w in {word, once} for i in range(2, len(w))} | {once}
    return sorted(w for w in found - {word} if len(w) > 3)


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers: a-z, the mark, and five more for all else."""
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return np.where((point >= 97) & (point < 123), point - 97, np.where(point == 94, 31, 26 + point % 5)).astype(np.int32)


@lru_cache(WINDOW + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of three in a word of n letters with up to two letters between neighbours, and their decayed spans."""
    at = np.array([x for x in combinations(range(n), 3) if x[1] - x[0] <= STEP and x[2] - x[1] <= STEP], np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def _windows(word: str) -> list[str]:
    """A long word is all its overlapping windows: nothing of it is cut off."""
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _norms(codes: np.ndarray) -> np.ndarray:
    """Root of the kernel of each word with itself: matches, and what decays from the matches before them, three times."""
    n = codes.shape[1]
    same = DECAY**2 * (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
    decay = np.where((gap >= 0) & (gap < STEP), DECAY ** np.maximum(gap, 0), 0).astype(np.float32).T
    match = same
    for _ in range(2):
        # the matrices are symmetric, so a transpose between serves as the product from the left
        before = (match.reshape(-1, n) @ decay).reshape(match.shape)
        before = (np.ascontiguousarray(before.transpose(0, 2, 1)).reshape(-1, n) @ decay).reshape(match.shape)
        match = same * before
    return np.sqrt(match.sum((1, 2)))


class Landmarks:
    """The kernel with a set of landmarks: normalised gap-weighted subsequences of three letters, sharpened by a power."""

    def __init__(self, words: list[str]):
        rows: dict[int, np.ndarray] = {}
        for i, z in enumerate(words):
            codes = _codes([z])
            at, decay = _triples(len(z))
            norm = _norms(codes)[0]
            for number, weight in zip(self._numbers(codes, at)[0].tolist(), decay):
                rows.setdefault(number, np.zeros(len(words), np.float32))[i] += weight / norm
        self.place = np.full(LETTERS**3, -1, np.int32)
        self.place[list(rows)] = np.arange(len(rows))
        self.table = np.array(list(rows.values()), np.float32).reshape(-1, len(words))

    @staticmethod
    def _numbers(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = codes[:, at]
        return (x[:, :, 0] * LETTERS + x[:, :, 1]) * LETTERS + x[:, :, 2]

    def kernel(self, words: list[str]) -> np.ndarray:
        """Words by landmarks; of a long word the largest over its windows; zero for a word of under three letters, and below SMALL."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            for part in [w] if len(w) <= WINDOW else _windows(w):
                if len(part) >= 3:
                    owners, parts = by_length.setdefault(len(part), ([], []))
                    owners.append(i)
                    parts.append(part)
        for length, (owners, parts) in by_length.items():
            at, decay = _triples(length)
            step = max(1, 200_000 // len(at))
            for a in range(0, len(parts), step):
                codes = _codes(parts[a : a + step])
                place = self.place[self._numbers(codes, at)]
                row, column = np.nonzero(place >= 0)
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                sums = np.add.reduceat(self.table[place[row, column]] * decay[column, None], first, axis=0)
                # no norm is below that of a word whose subsequences all differ, so this bounds the kernel from above
                some = sums.max(1) >= SMALL * np.sqrt((decay * decay).sum())
                rows = row[first][some]
                if not len(rows):
                    continue
                value = np.zeros((len(codes), out.shape[1]), np.float32)
                near = sums[some] / _norms(codes[rows])[:, None]
                value[rows] = np.where(near >= SMALL, np.minimum(near, 1), 0) ** POWER
                owner = np.array(owners[a : a + step])
                if length == WINDOW:
                    np.maximum.at(out, owner, value)
                else:
                    out[owner] = np.maximum(out[owner], value)
        return out


@dataclass
class Model:
    """What scoring needs: landmarks, the surely telling ones first, their weights in the decision, and the calibration of a document's score."""

    landmarks: list[str]
    told: int
    gamma: np.ndarray
    bias: float
    calibration: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def units(text: str | None) -> list[str]:
    """Words of a text; letters set apart by spaces are also read as one word."""
    if not text:
        return []
    found = text.split()
    if APART.search(text):
        found += [re.sub(r"\s", "", m) for m in SPACED.findall(text)]
    return found


class Scorer:
    """Scores texts; the decision value of a word is kept, since words recur."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.landmarks = Landmarks(model.landmarks) if model.landmarks else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.folded: dict[str, float] = {}
        self.value, self.last = np.zeros(0), np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        short = [[folded(w), *closed(w)] for w in words]
        fresh = sorted({r for readings in short for r in readings}.difference(self.folded))
        kernel, gamma = self.landmarks.kernel(fresh), self.model.gamma.astype(np.float32)
        own = kernel @ gamma
        # a word that comes near a telling landmark is also read without a letter that may have been put in
        near = np.flatnonzero(kernel[:, : self.model.told].max(1, initial=0) >= NEAR**POWER)
        forms = [shorter(fresh[i]) for i in near]
        other = self.landmarks.kernel([f for fs in forms for f in fs]) @ gamma
        np.maximum.at(own, np.repeat(near, [len(fs) for fs in forms]), other - PUT_IN)
        self.folded.update(zip(fresh, own.tolist()))
        value = [max(self.folded[r] for r in readings) for readings in short]
        self.known.update(zip(words, range(len(self.value), len(self.value) + len(words))))
        self.value = np.concatenate([self.value, value])
        self.last = np.concatenate([self.last, [w[-1] in ".!?" for w in words]])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the best sentence's decision, the mean of the best three, log of the sentences past the margin."""
        out = np.zeros((len(texts), 3))
        if self.landmarks is None:
            return out
        split = [units(t) for t in texts]
        new = set().union(*split)
        if len(new) + len(self.known) > self.most:
            self._forget()
        if new := new.difference(self.known):
            self._learn(sorted(new))
        out[:, :2] = self.model.bias
        for i, ws in enumerate(split):
            if not ws:
                continue
            at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            starts = np.append(0, np.flatnonzero(self.last[at[:-1]]) + 1)
            # far past the margin is far past it: an insult in disguise counts like one that is spelt out
            sentence = np.minimum(TOP, np.maximum.reduceat(self.value[at], starts) + self.model.bias)
            best = -np.sort(-sentence)[:3]
            out[i] = best[0], best.mean(), np.log1p((sentence > 0).sum())
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.model.centre) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.model.calibration[1:] + self.model.calibration[0], -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.diag(np.append(np.full(x.shape[1], 0.5 / c), 1e-6))
    inside = np.ones(len(x), bool)
    for _ in range(steps):
        gram, right = ridge.copy(), np.zeros(len(w))
        for a in range(0, len(x), 50_000):
            part = inside[a : a + 50_000]
            rows = np.column_stack([x[a : a + 50_000][part], np.ones(part.sum())]).astype(np.float64)
            k = weight[a : a + 50_000][part]
            gram += (rows * k[:, None]).T @ rows
            right += rows.T @ (k * y[a : a + 50_000][part])
        w = np.linalg.solve(gram, right)
        before, inside = inside, y * (x @ w[:-1] + w[-1]) < 1
        if (before == inside).all():
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    keep = np.diag(np.append(1e-6, np.full(x.shape[1], ridge)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + keep @ w
        w -= np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + keep, grad)
    return w


def _support(texts: list[np.ndarray], words: int) -> np.ndarray:
    """In how many texts each word is, but no more than the different words that it follows: copies of a text count once."""
    within = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=words)
    pairs = np.unique(np.concatenate([t * (words + 1) + np.concatenate([[words], t[:-1]])[: len(t)] for t in texts]))
    return np.minimum(within, np.bincount(pairs // (words + 1), minlength=words))


def _landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, most: int) -> tuple[list[str], np.ndarray]:
    """Words that tell toxic texts, then frequent words; none too like one before it. And how sure each of the first kind is.

    toxic and clean: in how many texts of each kind a word is. By the likelihood ratio of its toxic share against that of all
    words, against odds of ten for each word that was tried, a word is sure from 0 to 1.
    """
    # of all places of words, so that longer texts of one kind make no word telling
    share = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    usual = np.array([4 <= len(w) <= WINDOW for w in words], bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = toxic / (toxic + clean)
        surprise = np.nan_to_num(toxic * np.log(rate / share)) + np.nan_to_num(clean * np.log(np.maximum(1 - rate, 1e-12) / (1 - share)))
    telling = usual & (toxic > 0) & (rate > share)
    chosen: list[str] = []
    places: list[int] = []

    def extend(order: list[int], upto: int) -> None:
        for i in order:
            if len(chosen) >= upto:
                break
            if not chosen or Landmarks(chosen).kernel([words[i]]).max() < 0.8**POWER:
                chosen.append(words[i])
                places.append(i)

    extend(sorted(np.flatnonzero(telling).tolist(), key=lambda i: (-surprise[i], words[i])), most * 7 // 8)
    sure = 1 / (1 + 10 * (toxic > 0).sum() * np.exp(-np.minimum(surprise[places], 500)))
    frequent = np.flatnonzero(usual & (clean > 0))
    extend(sorted(frequent.tolist(), key=lambda i: (-clean[i], words[i]))[:200], most)
    return chosen, sure


def disguised(word: str, draw: random.Random) -> list[str]:
    """The word with a strange letter inside, with two letters doubled, and with a letter inside and one doubled."""
    strange = lambda w, i: w[:i] + draw.choice(string.ascii_lowercase) + w[i:]
    double = lambda w, i: w[:i] + w[i] + w[i:]
    at = lambda w: draw.randrange(2, len(w))
    twice = double(word, at(word))
    return [strange(word, at(word)), double(twice, at(twice)), strange(twice, at(twice))]


def fit(texts: list[str | None], labels: list[int], prevalence: float | None = None, landmarks: int = 64) -> Model:
    """Train on labelled texts. A sentence is a bag of words whose decision is its best word's.

    Positives are words of toxic texts like a telling landmark, then those that the machine itself chose, each weighing as much
    as its landmark is sure; disguised forms of them are positives too, so that the margin lies beyond an inserted or doubled letter.
    Words that clean texts hold at least as often, for their number, are negatives; a few clean texts that quote a word do not
    make it clean. ``prevalence``: the share of toxic texts where the sample's differs. Without texts of both kinds every
    text gets that share.
    """
    texts, y = list(texts), np.array(labels, int)
    real = prevalence if prevalence is not None else float(y.mean()) if len(y) else 0.0
    rate = min(1 - 1e-6, max(1e-6, real))
    constant = Model([], 0, np.zeros(0), 0.0, np.array([np.log(rate / (1 - rate)), 0, 0, 0]), np.zeros(3), np.ones(3))
    if not 0 < y.sum() < len(y):
        return constant
    place: dict[str, int] = {}
    read = lambda ws: [*map(folded, ws), *(r for w in ws for r in closed(w))]
    order = [np.fromiter((place.setdefault(w, len(place)) for w in read(units(t))), np.int64) for t in texts]
    vocabulary = list(place)
    toxic, clean = (_support([o for o, v in zip(order, y) if v == label], len(place)) for label in (1, 0))
    del order
    chosen, sure = _landmarks(vocabulary, toxic, clean, landmarks)
    if not len(sure):  # no word of a toxic text to learn from
        return constant
    table = Landmarks(chosen)
    gram = table.kernel(chosen).astype(np.float64)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-3 * values.max()  # kernels are single precision
    root = axes[:, good] / np.sqrt(values[good])
    similar = table.kernel(vocabulary)
    x, tells = similar @ root.astype(np.float32), similar[:, : len(sure)].max(1)
    evidence = (similar[:, : len(sure)] * sure).max(1)
    del similar
    # it is in more toxic texts than words are at large, one more clean text allowed for
    can = (toxic > toxic.sum() / max(1, clean.sum()) * (clean + 1)) | ((toxic > 0) & (clean == 0))
    negative = (clean > 0) & ~can
    positive = can & (tells >= 0.79**POWER)
    hard = np.zeros(len(vocabulary), bool)
    for step in range(4):
        draw = random.Random(step)
        own = np.flatnonzero(positive)
        forms = [disguised(vocabulary[i], draw) if len(vocabulary[i]) > 2 else [] for i in own]
        more = table.kernel([f for fs in forms for f in fs]) @ root.astype(np.float32)
        trust = evidence[own] ** 2  # a doubtful word hardly counts
        # all of them weigh as much as negatives do if any is sure
        scale = 500 * trust.max(initial=0) / max(1e-9, trust.sum())
        spread = np.repeat(trust * scale / 3, [len(fs) for fs in forms])
        share = 500 / max(1, negative.sum())
        # words of clean texts that the machine took for toxic weigh as much together as all others, but none more than a sure positive
        against = np.full(len(vocabulary), share) + np.where(hard, min(scale, 500 / max(1, hard.sum())), 0)
        rows = np.concatenate([x[own], more, x[negative]])
        signs = np.concatenate([np.ones(len(own) + len(more)), -np.ones(negative.sum())])
        beta, bias = _svm(rows, signs, np.concatenate([trust * scale, spread, against[negative]]))
        value = x @ beta + bias
        # the machine's own choice among what may be toxic, near enough to a telling landmark
        positive, hard = can & (value > 0) & (tells >= 0.58**POWER), hard | (negative & (value > 0))
    model = Model(chosen, int((sure > 0.5).sum()), root @ beta, bias, np.zeros(4), np.zeros(3), np.ones(3))
    scorer = Scorer(model, 100_000)
    found = np.concatenate([scorer.features(texts[a : a + 200]) for a in range(0, len(texts), 200)])
    model.centre, model.scale = found.mean(0), found.std(0) + 1e-9
    share = y.mean()
    model.calibration = _logistic((found - model.centre) / model.scale, y, np.where(y == 1, rate / share, (1 - rate) / (1 - share)))
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, most: int = 1200, landmarks: int = 64) -> Model:
    """Fit on a bounded sample: the ``most`` toxic and twice as many clean labelled rows, first by a hash of doc_id.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from, nor rows with a null label or id. Of several labels
    of an id the largest counts, of several texts the first in order.
    """
    rows = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out())
    counts = dict(rows.groupBy("toxic").count().collect())
    pick = lambda v, n: rows.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # 3 * most rows at the most
    sample = F.broadcast(pick(1, most).union(pick(0, 2 * most)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    total = sum(counts.values())
    return fit(found["text"].tolist(), found["toxic"].tolist(), counts.get(1, 0) / total if total else None, landmarks)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold``); other columns pass through.

    Every whole text is scored: a sentence's decision is its best word's, and the best sentences make the
    document's score. A word with signs inside is also read without them, and its best reading counts. A null or empty text has the score of a text without any word. Repeated rows score alike.
    """
    out = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator) -> Iterator:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            value = np.concatenate([scorer.scores(texts[a : a + 500]) for a in range(0, len(texts), 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 1200) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; see ``trained`` and ``scored``.

    An empty table of labels, or one with a single class, gives every text the share of toxic labels. A null doc_id is
    not held out.
    """
    model = trained(docs, labels, most)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, labels: DataFrame, most: int = 1200, threshold: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    columns = docs.columns
    names = [f"c{i}" if c != "text" else "text" for i, c in enumerate(columns)]
    model = trained(docs, labels, most)
    out = scored(docs.toDF(*names), model, threshold).filter("predicted = 0")
    return out.select(*names).toDF(*columns)
