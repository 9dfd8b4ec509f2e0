"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns whose names clash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import embedding_dedup, language_model, mixing, near_dedup, neighbours, packing, reputation, secrets, sharding, toxicity
from weirflow.llm.queries import tokenizer

CLASHING = ("score", "predicted", "h", "g", "rep", "band", "key", "n", "size", "klass", "copies", "source_size", "target", "rate", "u", "q", "cut", "part", "rank", "length", "base", "cand", "all", "_t", "_row", "_total", "_p", "_part", "kind", "bucket", "host", "domain", "root", "node", "at", "id", "held", "c0", "d0", "words")


def text(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(r.randrange(500)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = text(60_000)
    rows = [(1, text(80, 1), "en", "a"), (2, text(80, 1), "en", "a"), (2, text(80, 1), "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n ", None, "b"), (6, long, "fr", None), (7, long + " end", "fr", "b"), (None, text(80, 1), "en", "a"), (None, None, None, None), (8, "one", "en", "b"), (9, "one", "en", "a"), (10, "x" * 200_000, "en", "c"), (11, "\u0000 \U0001f600 é", "en", "c"), (12, text(81, 1), "en", "a")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, None), (None, 0, 1), (8, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def by_id(df, column):
    return sorted(((r.doc_id is None, r.doc_id or 0, r[column]) for r in df.collect()))


def test_toxicity(spark, docs, labels):
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count() and out.filter("score is null or score not between 0 and 1").count() == 0
    assert toxicity.kept(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_near_dedup(spark, docs):
    out = by_id(near_dedup.classes(docs), "class_id")
    assert out == [(False, i, c) for i, c in ((1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (10, 10), (11, 11), (12, 1))]
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 2 and kept.count() == 10
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.filter("taken > 2 * size or taken is null").count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("text is null")).collect()} == {0}


def test_mixing_meets_targets_without_ids_and_with_equal_rows(spark):
    rows = [(i, text(30 + i % 40, i), "a") for i in range(400)] + [(None, text(40 + i % 9, 1000 + i), "b") for i in range(400)] + [(7, "same words in every row of this one source", "c")] * 300 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df)
    found = {r.source: (r.taken, r.target) for r in mixing.mixed(*[mixing._plan(df, (5, 2, 1), 1.5, 2.0, 5)[i] for i in (0, 2)]).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(taken - target) <= 80 for taken, target in found.values()) and found["b"][0] > 0 and found["c"][0] > 0
    want = sorted(map(str, out.collect()))
    assert want == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns and docs.count() == sum(r.taken // r["size"] for r in out.collect() if r["size"])


def test_packing(spark, docs):
    out = packing.packed(docs, tokenizer())
    assert out.filter("piece = 0").count() == docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert packing.packed(docs.limit(0), tokenizer()).count() == 0


def test_language_model(spark, docs):
    out = language_model.scored(docs)
    assert out.count() == docs.count() and out.filter("score is null or isnan(score) or score >= 0").count() == 0
    assert sorted(r.n_tokens for r in out.filter("doc_id is null").collect()) == [1, 81]
    assert language_model.scored(docs.limit(0)).count() == 0


def test_sharding(spark, docs):
    out = sharding.shard(docs, 4)
    assert out.count() == docs.count() and sorted(r.slot for r in out.filter("shard = 0").collect()) == [0, 1, 2, 3]
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_secrets(spark, docs):
    out = secrets.secrets(docs)
    assert out.count() == docs.count() and out.filter("spans is null or base_sha256 is null").count() == 0
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).count() == docs.count()
    assert secrets.secrets(docs.limit(0)).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, None), (3, ""), (4, "://"), (None, "http://A.COM"), (5, "http://" + "x" * 100_000 + "/y")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "said", "bad", "x", "n", "m", "domain", "suffix", "verdict")})
    out = reputation.judged(pages)
    assert out.count() == len(rows) and out.filter("verdict is null or host is null or path is null").count() == 0
    assert reputation.judged(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.1]), (50, [0.6, 0.8]), (150, [1e-30, 1e-30]), (10, [3e30, 3e30])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASHING})


def test_neighbours(spark, points):
    out = neighbours.nearest(points, F.col("vec_id") % 50 == 0, 5)
    hits = {}
    for r in out.orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert hits[0][:2] == [(1, 1), (2, 50)] and hits[100] == [(1, 9)] and 0 not in [v for _, v in hits[0]] and {3, 4, 5, 6, 7, 8}.isdisjoint(v for h in hits.values() for _, v in h)
    assert neighbours.nearest(points.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_neighbours_whatever_the_size(spark):
    x = np.random.default_rng(7).standard_normal((300, 64))
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # rows of another length are compared with none of these, yet are many
    other = spark.range(1000, 61000).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i: [j for j in np.argsort(-(unit @ unit[i])).tolist() if j != i][:5] for i in range(0, 300, 10)}
    for points in (few, few.union(other)):
        hits = {}
        for r in neighbours.nearest(points, (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 300), 5, tables=1, count=1).orderBy("query_id", "rank").collect():
            hits.setdefault(r.query_id, []).append(r.vec_id)
        assert hits == want


def test_neighbours_by_cells_alone(spark, monkeypatch):
    # eight points about each of 120 axes: the fifth neighbour is near, so no query is compared with all rows
    r = np.random.default_rng(11)
    x = (r.standard_normal((120, 1, 64)) + 0.6 * r.standard_normal((120, 8, 64))).reshape(-1, 64)
    monkeypatch.delattr(neighbours, "_everywhere")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = {}
    for row in neighbours.nearest(points, F.col("vec_id") % 10 == 0, 5).collect():
        hits.setdefault(row.query_id, set()).add(row.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i: {j for j in np.argsort(-(unit @ unit[i])).tolist()[:6] if j != i} for i in range(0, 960, 10)}
    assert sum(len(want[i] & hits[i]) for i in want) >= 0.95 * 5 * len(want)


def test_embedding_dedup(spark, points):
    out = embedding_dedup.linked(points)
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in out.collect())
    assert out.count() == points.count()
    assert (3, 0, 3) in found and (8, 0, 8) in found and (-1, 0, None) in found and (0, 2, 0) in found and (1, 2, 0) in found and (9, 1, 9) in found and (100, 1, 9) in found and (10, 2, 10) in found
    assert embedding_dedup.linked(points.limit(0)).count() == 0
