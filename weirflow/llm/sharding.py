"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, staged

PRIME = 2**31 - 1
ROUNDS = 8
WALK = 12


def keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Four constants for each round."""
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(4)) for _ in range(ROUNDS)]


def permuted(row: str, total: str, seed: int) -> Column:
    """Where column ``row`` (0 to total-1) lands: a bijection on 0 to total-1.

    The domain is a by b, the smallest near-square that holds ``total``; under sqrt(total) points lie outside,
    and a row that lands there is sent on until it is inside. Twelve steps leave a row outside with a
    probability under total**-6 and always suffice below 100 rows; a row still outside is an error, never a guess.
    """
    a = f"cast(ceil(sqrt(cast({total} as double))) as bigint)"
    b = f"(({total} + {a} - 1) div {a})"
    rounds = ", ".join(f"named_struct('odd', {i % 2 == 1}, 'm', {m}L, 'c', {c}L, 'e', {e}L, 'k', {k}L)" for i, (m, c, e, k) in enumerate(keys(seed)))

    def f(v: str) -> str:
        x = f"((({v} % {PRIME}L) * k.m + k.c) % {PRIME}L)"
        return f"transform(array(transform(array({x}), x -> (x * x + k.e) % {PRIME}L)[0]), x -> (x * k.k + x * x % {PRIME}L) % {PRIME}L)[0]"

    one = f"""aggregate(array({rounds}), named_struct('l', p div {b}, 'r', p % {b}),
        (s, k) -> if(k.odd, named_struct('l', s.l, 'r', (s.r + {f('s.l')}) % {b}), named_struct('l', (s.l + {f('s.r')}) % {a}, 'r', s.r)),
        s -> s.l * {b} + s.r)"""
    # a walk meets no point twice before it is inside again, so the points outside bound it
    walk = f"aggregate(sequence(1, {WALK}), {row}, (p, i) -> if(i > 1 and p < {total}, p, {one}))"
    rest = f"aggregate(sequence(0, {a} * {b} - {total}), p, (p, i) -> if(p < {total}, p, {one}))"
    return F.expr(f"transform(array({walk}), p -> if(p < {total}, p, {rest}))[0]")


def shard(docs: DataFrame, shards: int, seed: int = 9, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Rows are numbered in the order of key, crc and size; the permutation of the number gives shard (remainder) and
    slot (quotient), so counts differ by one at most, slots have no gap, and both follow from the number alone.
    A null text counts as empty, size 16; null keys come first; equal rows get numbers in any order among themselves,
    and any number of them is spread over several tasks. An empty table gives an empty result. Other columns are not read.
    """
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # where a row was written sets equal rows apart, so that ranges can part them
    rows = numbered(staged(slim.withColumn("_at", F.monotonically_increasing_id())).withColumnRenamed("_at", "_tie"), "doc_id", "text_crc32", "size", "_tie")
    placed = rows.withColumn("_p", permuted("_row", "_total", seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
