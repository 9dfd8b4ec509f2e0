"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import staged

#: How a byte-level vocabulary of this family splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


@lru_cache(2)
def encoder(path: str):
    """An encoder with the ids of the tokenizers file at ``path``; it runs four times as fast on the same vocabulary."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of each length go where: (length, first rank, sequences, times in each, first sequence, offset).

    The instance is the histogram of lengths, ``capacity`` classes at most, whatever the number of pieces.
    Reduction: the longest piece j is fixed for good with nothing, if nothing fits beside it; with k, the longest that fits,
    if the two fill a sequence or if no two or more others come closer. Each such set dominates every other that holds j.
    Remainder: best fit, longest first: what fills the gap, else two that fill it, else the longest that fits.
    Each set is used as often as the counts allow, so there are few sets and the work doesn't grow with the pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0

    def fix(items: list[int]) -> None:
        nonlocal sequence
        lengths, times = np.unique(items, return_counts=True)
        n = int((left[lengths] // times).min())
        offset = 0
        for length, t in zip(lengths[::-1].tolist(), times[::-1].tolist()):
            slots.append((length, int(used[length]), n, t, sequence, offset))
            used[length] += n * t
            left[length] -= n * t
            offset += length * t
        sequence += n

    def fitting(gap: int, taken: dict[int, int]) -> np.ndarray:
        """Lengths up to gap of which one more is there, ascending."""
        there = left[: gap + 1].copy()
        for length, t in taken.items():
            if length <= gap:
                there[length] -= t
        return np.flatnonzero(there > 0)

    for j in range(capacity, 0, -1):
        while left[j]:
            gap = capacity - j
            fits = fitting(gap, {j: 1})
            if not len(fits):
                fix([j])
                continue
            k = int(fits[-1])
            if k != gap:
                two = fits[0] + (fits[0] if left[fits[0]] - (fits[0] == j) > 1 else fits[1] if len(fits) > 1 else capacity)
                if two <= gap:
                    partner = np.searchsorted(fits, gap - fits, "right") - 1
                    best = int((fits + fits[np.maximum(partner, 0)])[partner >= 0].max(initial=0))
                    if best > k or 3 * fits[0] <= gap:
                        break  # no set of j dominates
            fix([j, k])
    while left.any():
        items = [int(np.flatnonzero(left)[-1])]
        taken = {items[0]: 1}
        gap = capacity - items[0]
        while gap and len(fits := fitting(gap, taken)):
            if fits[-1] == gap:
                choice = gap
            else:
                rest = gap - fits
                pair = fits[np.isin(rest, fits) & ((rest != fits) | (left[fits] - np.array([taken.get(int(x), 0) for x in fits]) > 1))]
                choice = int(pair[-1]) if len(pair) else int(fits[-1])
            choice = int(choice)
            items.append(choice)
            taken[choice] = taken.get(choice, 0) + 1
            gap -= choice
        fix(items)
    return slots


def tokenized(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and its rank among the pieces of its length in its part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(encoder(path).encode, allowed_special="all")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array(encode(text or "") + [end], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                    seen[b - a] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of every document.

    A text is its ids and ``end``; one longer than ``capacity`` is cut, the first piece taking what is over. Null is an empty
    text: one piece of one id. Repeated rows are packed each; an empty table gives an empty result; other columns
    are not read. A string of a special token is its one id, as tokenizers has it. Only the histogram of lengths reaches the driver.
    """
    pieces = staged(tokenized(docs, path, capacity, end))
    parts = staged(pieces.groupBy("part", "length").count())
    counts = {int(n): int(c) for n, c in parts.groupBy("length").agg(F.sum("count")).collect()}
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    before = staged(parts.selectExpr("part", "length", "coalesce(sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before"))
    # it grows with the parts, so it is never broadcast
    ranked = pieces.join(before.hint("merge"), ["part", "length"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # ranks under 2**40 for each length: one search over both
        keys = slots[:, 0] * 2**40 + slots[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy(np.int64) + batch["before"].to_numpy(np.int64)
            at = np.searchsorted(keys, batch["length"].to_numpy(np.int64) * 2**40 + rank, "right") - 1
            length, first, _, times, sequence, offset = slots[at].T if len(at) else slots[:0].T
            own = rank - first
            out = batch.drop(columns=["part", "rank", "before"])
            yield out.assign(sequence_id=sequence + own // times, offset=offset + own % times * length)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
