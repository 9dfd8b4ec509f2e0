"""More queries of the training-data operators against plain versions."""

import zlib

import numpy as np

from weirflow.llm import embedding_dedup, packing, toxicity
from weirflow.llm.queries import tokenizer


def test_no_link_of_a_dense_cone_is_lost(spark):
    rng = np.random.default_rng(3)
    axis = np.eye(64)[0]
    side = lambda n: (v := rng.normal(size=(n, 64)) * (1 - axis)) / np.linalg.norm(v, axis=1)[:, None]
    cone = np.sqrt(0.85) * axis + np.sqrt(0.15) * side(6000)
    near = 0.955 * cone[:300] + (w := (v := rng.normal(size=(300, 64))) - (v * cone[:300]).sum(1)[:, None] * cone[:300]) / np.linalg.norm(w, axis=1)[:, None] * np.sqrt(1 - 0.955**2)
    x = np.concatenate([cone, near]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert links[np.arange(300), np.arange(6000, 6300)].all()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.linked(rows).collect()}
    assert [got[i][0] for i in range(len(x))] == links.sum(1).tolist()
    assert all(got[i][1] == got[i + 6000][1] for i in range(300))


def test_insults_with_one_and_with_all_gaps_filled_are_predicted(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("bcdfghklmnprstvw"), 3)[i // 2] if i % 2 == 0 else rng.choice(list("aeiou")) for i in range(6)) for _ in range(400)]
    insults = ["idiot", "moron", "loser", "stupid", "worthless"]
    clean = lambda: " ".join(rng.choice(words, 12))
    texts = [clean() for _ in range(300)] + [f"{clean()} {insults[i % 5]} {clean()}" for i in range(150)]
    model = toxicity.fit(texts, [0] * 300 + [1] * 150)
    one = [f"{w[:2]}{s}{w[2:]}" for w in insults for s in "-.*"]
    every = [s.join(w) for w in insults for s in "-.*"]
    held = [(1, f"{clean()} {w} {clean()}") for w in insults + one + every] + [(0, clean()) for _ in range(50)] + [(0, f"{clean()} well-known e.g. {clean()}")]
    rows = spark.createDataFrame([(i, y, t) for i, (y, t) in enumerate(held)], "doc_id long, y int, text string")
    wrong = [r.text for r in toxicity.scored(rows, model).collect() if r.predicted != r.y]
    assert not wrong


def test_special_tokens_in_a_text_have_the_ids_of_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two<|endoftext|>", "<|endoftext|>", "<|endoftext|", "plain words"]
    want = [np.array([*Tokenizer.from_file(tokenizer()).encode(x, add_special_tokens=False).ids, 0], "<u4") for x in texts]
    got = {r.doc_id: r for r in packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer()).collect()}
    assert [(got[i].length, got[i].ids_crc32) for i in range(4)] == [(len(x), zlib.crc32(x.tobytes())) for x in want]
