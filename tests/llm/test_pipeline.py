"""The corpus pipeline, stage by stage, and what it leaves out."""

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from weirflow.llm import mixing, near_dedup, packing, secrets
from weirflow.llm.common import staged


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first, sizes = docs, [docs.count()]
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, data))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.schema.names == first.schema.names
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("toxic = 1").collect()}
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert len(gone - toxic) <= 0.1 * sizes[0]
        if name == "near_dedup":
            classes = {r.doc_id: r.class_id for r in near_dedup.classes(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(classes.values()))
        if name == "secrets":
            assert sizes[-1] == sizes[-2]
            assert sum(r.n_assign + r.n_access + r.n_hex for r in secrets.secrets(docs).collect()) == 0
            kept = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
        if name == "mixing":
            copies = Counter(r.doc_id for r in docs.collect())
            assert max(copies.values()) <= 2
            assert {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken} == {d: n * kept[d] for d, n in copies.items()}
        if name == "packing":
            pieces, where = Counter(), defaultdict(int)
            for r in docs.collect():
                pieces[r.doc_id] += r.piece == 0
                where[r.sequence_id] += r.length
            assert pieces == copies and max(where.values()) <= 2048
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == packing.packed(spark.read.parquet(f"{data}/documents.parquet"), corpus_pipeline.tokenizer()).columns
    assert out.count() > 0


def test_entry_lists_all(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_tables(spark, data, tmp_path, rows):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(rows).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in out}) <= rows
