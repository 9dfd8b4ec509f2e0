"""Queries over whole tables and texts, against brute force in plain Python."""

import hashlib

from weirflow.plans import queries as catalogue


def test_every_order_enters_the_range_join(spark, data):
    orders = [(r.o_orderkey, r.o_totalprice) for r in catalogue.table(spark, data, "orders").collect()]
    parts = [(r.p_partkey, r.p_retailprice * 100) for r in catalogue.table(spark, data, "part").collect()]
    want = sorted((o, p) for o, price in orders for p, low in parts if low <= price <= low + 20)
    assert any(o % 10 for o, _ in want)
    assert sorted(map(tuple, catalogue.QUERIES["enrich_range"](spark, data).collect())) == want


def test_every_gauge_passes_the_sum(spark, data):
    want = sorted(round(r.value, 6) for r in catalogue.events(spark, data).collect())
    got = catalogue.QUERIES["aggregate_sum"](spark, data).filter("name = 'pass'").collect()
    assert sorted(r.value for r in got) == want


def test_array_functions_see_whole_texts(spark, data):
    texts = {r.doc_id: [w for w in r.text.split(" ") if w] for r in catalogue.table(spark, data, "documents").collect() if r.text is not None}
    md5 = lambda words: hashlib.md5(" ".join(words).encode()).hexdigest()
    want = {i: (len(ws), "the" in ws, md5(ws[:-1]), md5([*ws, "end"]), len(set(ws))) for i, ws in texts.items()}
    got = {r.doc_id: (r.n, r.has, r.popped, r.pushed, r.kinds) for r in catalogue.QUERIES["fn_array"](spark, data).collect()}
    assert got == want and max(n for n, *_ in want.values()) > 1000


def test_lists_of_whole_turns_are_merged(spark, data):
    turns = {}
    for r in sorted(catalogue.table(spark, data, "conversations").collect(), key=lambda r: r.turn):
        turns.setdefault(r.conv_id, []).append([w for w in r.text.split(" ") if w])
    want = {i: (" ".join(sum(ls, [])), " ".join(max(ls, key=len)), " ".join(min(ls, key=len))) for i, ls in turns.items()}
    assert {r.conv_id: (r.words, r.longest, r.shortest) for r in catalogue.QUERIES["reduce_lists"](spark, data).collect()} == want
