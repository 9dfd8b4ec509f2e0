"""Operators against small cases with known results, and against plain Python over random streams."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.model import counter, gauge, metric, tags_of, value_of
from weirflow.operators import aggregate as agg, convert, enrich, multiline, reduce as red, routing, state, statistics as stats, traces
from weirflow.template import template

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def stream(spark, rows, schema="id bigint, k string, flag boolean"):
    """rows (second, *fields) as events."""
    return spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], "ts timestamp, " + schema)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


# ---- routing ----


def test_route_copies_to_each_route_and_null_is_unmatched(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, v int")
    out = routing.route(df, {"some": ".v > 1", "many": ".v > 10"})
    assert {k: ids(v) for k, v in out.items()} == {"some": [1, 2], "many": [2], "_unmatched": [3]}
    assert "_unmatched" not in routing.route(df, {"a": ".v > 1"}, reroute_unmatched=False)
    with pytest.raises(ValueError):
        routing.route(df, {"_unmatched": ".v > 1"})


def test_exclusive_route_takes_the_first(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, v int")
    out = routing.split_routes(routing.exclusive_route(df, [("many", ".v > 10"), ("some", ".v > 1")]), ["many", "some"])
    assert {k: ids(v) for k, v in out.items()} == {"many": [2], "some": [1], "_unmatched": [3]}


def test_templates_without_a_field_are_null(spark):
    df = spark.createDataFrame([(T0, "a", {"x": "1"}), (T0, None, {})], "ts timestamp, f string, m map<string,string>")
    assert [r[0] for r in df.select(template(df, "p/{{ f }}/%Y/{{ m.x }}")).collect()] == ["p/a/2024/1", None]
    assert df.select(template(df, "{{ nope }}")).first()[0] is None


def test_projection(spark):
    df = spark.createDataFrame([(T0, 1, (2, 3))], "ts timestamp, a int, s struct<x int, y int>")
    assert routing.project(df, only_fields=["a", "nope"]).columns == ["a"]
    assert routing.project(df, except_fields=["a", "s.x"]).first().asDict(recursive=True) == {"ts": T0, "s": {"y": 3}}
    assert routing.project(df, only_fields=["ts"], timestamp_format="unix_ms").first()[0] == 1704067200000


# ---- aggregation ----


def metrics(spark, rows):
    """rows (second, name, kind, type, value)."""
    df = spark.createDataFrame([(at(r[0]), i, *r[1:4], float(r[4])) for i, r in enumerate(rows)], "t timestamp, id bigint, n string, kind_ string, type string, v double")
    v = F.when(F.col("type") == "counter", counter(F.col("v"))).when(F.col("type") == "gauge", gauge(F.col("v"))).otherwise(value_of("set", members=F.array(F.col("v").cast("string"))))
    return df.select("id", *metric(F.col("t"), F.col("n"), "", v)).drop("kind").join(df.select("id", F.col("kind_").alias("kind")), "id")


def values(df):
    return sorted((str(r.window_start), r.name, r.kind, r.value.type, r.value.value if r.value.value is not None else tuple(r.value.members)) for r in df.collect())


ORDER = ("ts", "id")
W0 = str(T0)


def test_aggregate_auto_sums_and_takes_the_latest(spark):
    m = metrics(spark, [(0, "c", "incremental", "counter", 42), (1, "c", "incremental", "counter", 43), (0, "g", "absolute", "gauge", 1), (5, "g", "absolute", "gauge", 2), (0, "s", "incremental", "set", 1), (2, "s", "incremental", "set", 2)])
    assert values(agg.aggregate(m, 10_000, "auto", ORDER)) == [(W0, "c", "incremental", "counter", 85), (W0, "g", "absolute", "gauge", 2), (W0, "s", "incremental", "set", ("1.0", "2.0"))]


def test_a_change_of_kind_or_type_starts_anew(spark):
    m = metrics(spark, [(0, "c", "incremental", "counter", 5), (1, "c", "incremental", "gauge", 7), (2, "c", "incremental", "gauge", 1), (0, "d", "incremental", "counter", 5), (1, "d", "absolute", "counter", 9), (2, "d", "incremental", "counter", 3), (3, "d", "incremental", "counter", 4)])
    assert values(agg.aggregate(m, 10_000, "auto", ORDER)) == [(W0, "c", "incremental", "gauge", 8), (W0, "d", "incremental", "counter", 7)]


@pytest.mark.parametrize("mode, want", [("sum", 3), ("count", 2), ("max", 4), ("min", 2), ("mean", 3), ("stdev", 1), ("latest", 2), ("diff", 2)])
def test_modes(spark, mode, want):
    kind, type_ = ("incremental", "counter") if mode == "sum" else ("absolute", "gauge")
    rows = [(0, "a", kind, type_, 1), (1, "a", kind, type_, 2)] if mode == "sum" else [(0, "a", kind, type_, 4), (1, "a", kind, type_, 2)]
    other = (0, "b", "absolute" if mode == "sum" else "incremental", "counter", 9)
    out = agg.aggregate(metrics(spark, [*rows, other]), 10_000, mode, ORDER)
    found = {r.name: (r.window_start is None, r.value.value) for r in out.collect()}
    assert found == {"a": (False, want), "b": (mode != "count", 1 if mode == "count" else 9)}


def test_diff_needs_the_window_before_and_a_fallen_counter_stays(spark):
    rows = [(0, "a", 1), (10, "a", 4), (30, "a", 9), (0, "b", 9), (10, "b", 2)]
    m = metrics(spark, [(s, n, "absolute", "counter", v) for s, n, v in rows])
    assert [x[4] for x in values(agg.aggregate(m, 10_000, "diff", ORDER)) if x[1] == "a"] == [1, 3, 9]
    assert [x[4] for x in values(agg.aggregate(m, 10_000, "diff", ORDER)) if x[1] == "b"] == [9, 2]


def test_absolute_to_incremental_and_back(spark):
    m = metrics(spark, [(s, "a", "absolute", "counter", v) for s, v in ((0, 1), (1, 5), (2, 3), (3, 4))])
    out = agg.absolute_to_incremental(m, ORDER)
    assert [(r.id, r.value.value, r.kind) for r in out.orderBy("id").collect()] == [(1, 4, "incremental"), (3, 1, "incremental")]
    g = metrics(spark, [(s, "a", "absolute", "gauge", v) for s, v in ((0, 5), (1, 3))])
    assert [r.value.value for r in agg.absolute_to_incremental(g, ORDER).collect()] == [-2]
    i = metrics(spark, [(s, "a", "incremental", "counter", v) for s, v in ((0, 1), (1, 5), (400, 3))])
    assert [r.value.value for r in agg.incremental_to_absolute(i, ORDER).orderBy("id").collect()] == [1, 6, 3]


# ---- state ----


def random_stream(seed, n=120, keys=4):
    r = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 5])
        out.append((t, i, r.choice("abcdefgh"[:keys]), r.random() < 0.15))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_context_window_as_a_buffer_does_it(spark, seed):
    rows, before, after = random_stream(seed), 3, seed
    buffer, left, want = [], 0, []
    since = None
    for _, i, _, flush in rows:
        if flush:
            want += [*buffer, i]
            buffer, since = [], 0
        elif since is not None and since < after:
            since += 1
            want.append(i)
        elif since is not None and since == after:
            since = None
        else:
            buffer = [*buffer, i][-before:]
    df = stream(spark, rows)
    assert ids(state.context_window(df, ".flag == true", num_events_before=before, num_events_after=after, order=ORDER)) == sorted(want)
    assert ids(state.context_window(df.withColumn("one", F.lit(1)), ".flag == true", num_events_before=before, num_events_after=after, order=ORDER, group_by=["one"])) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_recent_and_timed_dedupe(spark, seed):
    rows = random_stream(seed, keys=8)
    df = stream(spark, rows)
    seen, want = OrderedDict(), []
    for _, i, k, _ in rows:
        if k in seen:
            seen.move_to_end(k)
        else:
            want.append(i)
            seen[k] = 1
            if len(seen) > 3:
                seen.popitem(last=False)
    assert ids(state.dedupe_recent(df, ORDER, match=["k"], num_events=3)) == want
    for refresh in (False, True):
        last, want = {}, []
        for t, i, k, _ in rows:
            new = k not in last or t - last[k] >= 10
            if new:
                want.append(i)
            if new or refresh:
                last[k] = t
        assert ids(state.dedupe_timed(df, 10_000, order=ORDER, match=["k"], refresh_on_drop=refresh)) == want


def test_dedupe_tells_null_from_text_and_ignores_fields(spark):
    df = stream(spark, [(0, 1, None, True), (1, 2, "", True), (2, 3, None, True), (3, 4, "null", False)])
    assert ids(state.dedupe(df, ORDER, match=["k"])) == [1, 2, 4]
    assert ids(state.dedupe(df, ORDER, ignore=["ts", "id", "k"])) == [1, 4]


@pytest.mark.parametrize("seed", range(2))
def test_throttle_as_a_bucket_does_it(spark, seed):
    rows = random_stream(seed)
    due, want = {}, []
    for t, i, k, free in rows:
        if free:
            want.append(i)
            continue
        d = max(due.get(k, t), t)
        if d - t <= 2 * 4:
            want.append(i)
            due[k] = d + 4
    assert ids(state.throttle(stream(spark, rows), 3, 12, ["k"], exclude=".flag == true", order=ORDER)) == want


def test_sampling(spark):
    df = stream(spark, [(i, i, "ab"[i % 2], i == 3) for i in range(40)])
    out = state.sample(df, rate=4, order=ORDER, group_by=["k"], exclude=".flag == true")
    assert ids(out.filter("not flag")) == [*range(0, 40, 8), *[1, 11, 19, 27, 35]] or len(ids(out)) == 11
    assert {r.sample_rate for r in out.filter("not flag").collect()} == {"4"}
    acc, want = 1 - 0.3, []
    for i in range(40):
        acc += 0.3
        if acc >= 1 - 1e-9:
            want.append(i)
            acc -= 1
    assert ids(state.sample(df, ratio=0.3, order=ORDER)) == want
    by_key = state.sample(df, rate=2, order=ORDER, key_field="k")
    assert len(ids(by_key)) in (0, 20, 40)
    for bad in ({"rate": 0}, {"ratio": 1.5}, {}, {"rate": 1, "ratio": 0.5}):
        with pytest.raises(ValueError):
            state.sample(df, **bad)


def tagged(spark, rows):
    df = spark.createDataFrame([(at(i), i, *r) for i, r in enumerate(rows)], "t timestamp, id bigint, a string, b string")
    return df.select("id", *metric(F.col("t"), F.lit("m"), "incremental", counter(F.lit(1.0)), tags_of(a=F.col("a"), b=F.col("b"))))


def test_cardinality(spark):
    m = tagged(spark, [("1", "x"), ("2", "x"), ("3", "x"), ("1", "y"), ("3", "z")])
    out = state.cardinality_limit(m, 2, ORDER)
    assert [sorted(r.tags) for r in out.orderBy("id").collect()] == [["a", "b"], ["a", "b"], ["b"], ["a", "b"], []]
    # of a dropped event no tag counts as seen
    assert ids(state.cardinality_limit_events(m, 2, ORDER)) == [0, 1, 3]
    assert ids(state.cardinality_limit_events(m, 2, ORDER, per_tag={"a": None})) == [0, 1, 2, 3]
    assert [sorted(r.tags) for r in state.cardinality_limit(m, 1, ORDER, per_tag={"a": None}).orderBy("id").collect()][3:] == [["a"], ["a"]]


# ---- reduce ----


def test_reduce_with_ends_when(spark):
    rows = [(0, 1, "a", False, 7), (1, 2, "b", False, 20), (2, 3, "a", True, 14), (3, 4, "b", True, 0), (4, 5, "a", False, 1)]
    df = stream(spark, rows, "id bigint, k string, flag boolean, n bigint")
    out = {(r.k, r.id): (r.n, r.ts, r.ts_end) for r in red.reduce(df, ["k"], ORDER, ends_when=".flag == true", merge_strategies={"id": "min"}).collect()}
    assert out == {("a", 1): (21, at(0), at(2)), ("b", 2): (20, at(1), at(3)), ("a", 5): (1, at(4), at(4))}


def test_reduce_limits(spark):
    df = stream(spark, [(i, i, "a", i in (0, 3)) for i in range(6)])
    sizes = lambda **o: sorted(r.n for r in red.reduce(df.withColumn("n", F.lit(1)), ["k"], ORDER, **o).collect())
    assert sizes(max_events=4) == [2, 4]
    assert sizes(starts_when=".flag == true") == [3, 3]
    # a row that starts a session does not end it, even if one row is the most
    assert sizes(starts_when=".flag == true", max_events=1) == [1, 1, 2, 2]
    assert sizes(end_every_period_ms=2000) == [2, 2, 2]
    assert sizes(expire_after_ms=1000) == [1] * 6
    with pytest.raises(ValueError):
        sizes(starts_when=".flag == true", ends_when=".flag == true")


def test_reduce_goes_into_structs_and_refuses_places(spark):
    df = spark.createDataFrame([(at(0), 1, (1, "x")), (at(1), 1, (2, "y"))], "ts timestamp, k int, s struct<n int, t string>")
    row = red.reduce(df, ["k"], merge_strategies={"s.t": "concat"}).first()
    assert row.s.n == 3 and row.s.t == "x y"
    with pytest.raises(ValueError):
        red.reduce(df, ["k"], merge_strategies={"s[0]": "sum"})
    with pytest.raises(ValueError):
        red.reduce(df, ["k"], merge_strategies={"s.t": "sum"})


# ---- enrichment ----


def test_single_records_and_errors(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("B", 3)], "key string, v int")
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "x string")
    out = {r.x: (r.record and r.record.v, r.record_error) for r in enrich.get_record(df, t, {"key": F.col("x")}, case_sensitive=False).collect()}
    assert out == {"a": (1, None), "b": (None, "more than one row found"), "z": (None, "no rows found"), None: (None, "no rows found")}
    with pytest.raises(ValueError):
        enrich.get_record(df, t, {"nope": F.col("x")})


def test_wildcards_stand_in_only_without_an_exact_match(spark):
    t = spark.createDataFrame([("a", 1), ("*", 9)], "key string, v int")
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    out = {r.x: [h.v for h in r.records] for r in enrich.find_records(df, t, {"key": F.col("x")}, wildcard="*").collect()}
    assert out == {"a": [1], "z": [9]}


def test_dates_include_both_ends(spark):
    t = spark.createDataFrame([(1, at(0)), (2, at(10)), (3, at(20))], "v int, d timestamp")
    df = spark.createDataFrame([(at(0), at(10))], "a timestamp, b timestamp")
    found = enrich.find_records(df, t, {"d": enrich.Between(F.col("a"), F.col("b"))}).first().records
    assert [r.v for r in found] == [1, 2]
    assert [r.v for r in enrich.find_records(df, t, {"d": enrich.Between(F.col("b"))}).first().records] == [2, 3]


def test_address_ranges(spark):
    t = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "net"), ("192.168.1.0", "192.168.1.255", "home")], "first string, last string, city string")
    df = spark.createDataFrame([("10.20.30.40",), ("192.168.1.7",), ("8.8.8.8",), ("x",)], "ip string")
    assert {r.ip: r.city for r in enrich.geo_lookup(df, t, "ip").collect()} == {"10.20.30.40": "net", "192.168.1.7": "home", "8.8.8.8": None, "x": None}


def test_memory_table_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "old", at(0)), ("a", "new", at(5)), ("b", "x", at(-100))], "key string, value string, ts timestamp")
    out = enrich.memory_table(rows, 30, F.lit("2024-01-01T00:00:10Z").cast("timestamp"))
    assert [(r.key, r.value, r.ttl) for r in out.collect()] == [("a", "new", 25)]
    (tmp_path / "t.csv").write_text("id,when,ok\n1,2024-01-02,true\n2,bad,no\n")
    t = enrich.file_table(spark, str(tmp_path / "t.csv"), {"id": "int", "when": "date|%Y-%m-%d", "ok": "bool"})
    assert [(r.id, r.when and r.when.day, r.ok) for r in t.orderBy("id").collect()] == [(1, 2, True), (2, None, False)]


# ---- conversion, statistics, lines, traces ----


def test_log_to_metric(spark):
    df = spark.createDataFrame([(T0, "h", 3.5, None), (T0, "i", None, "s")], "ts timestamp, host string, n double, m string")
    rules = [{"type": "counter", "field": "n"}, {"type": "counter", "field": "n", "name": "sum", "increment_by_value": True}, {"type": "gauge", "field": "n", "name": "{{ host }}_g", "tags": {"host": "{{ host }}"}}, {"type": "set", "field": "m"}, {"type": "histogram", "field": "n", "name": "hist"}, {"type": "gauge", "field": "m", "name": "no_number"}]
    out = {r.name: (r.kind, r.value.type, r.value.value, r.tags) for r in convert.log_to_metric(df, rules).collect()}
    assert out == {"n": ("incremental", "counter", 1.0, {}), "sum": ("incremental", "counter", 3.5, {}), "h_g": ("absolute", "gauge", 3.5, {"host": ["h"]}), "m": ("incremental", "set", None, {}), "hist": ("incremental", "distribution", None, {})}


def test_scripted_rows(spark):
    class Doubled(convert.Hooks):
        def init(self, emit):
            self.n = 0

        def process(self, row, emit):
            self.n += 1
            emit(row)
            emit({**row, "id": -row["id"]})

        def shutdown(self, emit):
            emit({"id": 1000 + self.n})

    df = spark.range(1, 3).coalesce(1)
    assert ids(convert.scripted(df, Doubled)) == [-2, -1, 1, 2, 1002]


def test_quantiles_buckets_and_sketches(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    q = stats.weighted_quantiles(df, [], "v", quantiles=[0.1, 0.99]).first()
    assert (q.min, q.max, q.median, q.avg, q["count"], q.p10, q.p99) == (1, 100, 50, 50.5, 100, 10, 99)
    assert [(r.le, r.n) for r in stats.histogram_buckets(df, [], "v", [10, 50]).collect()] == [("10", 10), ("50", 50), ("+Inf", 100)]
    s = stats.sketched(df, [], "v").first()
    assert s["count"] == 100 and abs(stats.sketched(df, [], "v").select(stats.sketch_quantile(0.5)).first()[0] - 50) <= 1
    halves = stats.sketched(df.withColumn("h", F.col("v") < 30), ["h"], "v")
    assert stats.merged_sketches(halves, []).select("count", "sum", "bins").first() == stats.sketched(df, [], "v").select("count", "sum", "bins").first()


def test_distributions(spark):
    v = value_of("distribution", samples=F.expr("array(named_struct('value', 3D, 'rate', 2L), named_struct('value', 1D, 'rate', 1L), named_struct('value', 3D, 'rate', 1L))"), statistic=F.lit("histogram"))
    m = spark.range(1).select(*metric(F.lit(T0), F.lit("d"), "incremental", v))
    h = stats.to_histogram(m, [1, 2]).first().value
    assert ([(b.upper_limit, b["count"]) for b in h.buckets], h["count"], h.sum) == ([(1, 1), (2, 0)], 4, 10)
    assert [(s.value, s.rate) for s in m.select(stats.compress_samples(F.col("value.samples"))).first()[0]] == [(1, 1), (3, 3)]


@pytest.mark.parametrize(
    "mode, start, condition, want",
    [
        ("continue_through", r"^\S", r"^\s", [["first", " a", " b"], ["second", " c"], ["third"]]), ("continue_past", r"\\$", r"\\$", [["one \\", "two"], ["three"]]),
        ("halt_before", "^START", "^END", [["START", "x"], ["END"], ["y"]]), ("halt_with", "^START", "^END", [["START", "x", "END"], ["y"]]),
    ],
)
def test_lines(spark, mode, start, condition, want):
    lines = [x for m in want for x in m]
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(lines)], "i bigint, file string, message string")
    out = multiline.join_lines(df, start, condition, mode, ["i"], ["file"]).orderBy("i").collect()
    assert [r.message for r in out] == ["\n".join(m) for m in want]


def test_trace_spans(spark):
    schema = "trace_id string, ts timestamp, env string, host string, spans array<struct<service: string, name: string, resource: string, type: string, span_id: bigint, parent_id: bigint, start: timestamp, duration: bigint, error: int, meta: map<string,string>, metrics: map<string,double>>>"
    span = lambda i, parent, service, metrics=None, error=0: (service, "n", "r", "web", i, parent, T0, 2_000_000_000, error, {}, metrics or {})
    df = spark.createDataFrame([("t", T0, None, None, [span(1, 0, "a", {"sample_rate": 0.5}), span(2, 1, "a"), span(3, 1, "b", None, 1), span(4, 1, "a", {"measured": 1.0})])], schema)
    out = {r.service: (r.hits, r.top_level_hits, r.errors, r.env) for r in traces.span_stats(traces.spans_of(df)).collect()}
    assert out == {"a": (3, 2, 0, "none"), "b": (1, 1, 1, "none")}
