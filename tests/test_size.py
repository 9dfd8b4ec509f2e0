"""What a row costs: parsed values are worked out once, and rows that a program leaves are not worked out at all."""

from pyspark.sql import functions as F

from weirflow.expr import remap
from weirflow.functions import call
from weirflow.plans import function_queries  # noqa: F401
from weirflow.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_parsed_line_is_worked_out_once(spark, data):
    plan = plan_of(QUERIES["fn_parse_syslog"](spark, data))
    # a run for each group of the six patterns
    assert plan.count("regexp_extract(") < 100
    assert len(plan) < 100_000


def test_structured_data_with_a_name_twice_and_a_long_version(spark):
    lines = spark.createDataFrame([('<13>1 - h a p m [a x="1" y="3" x="2"] t',), ("<13>99999999999 - h a p m - t",)], "v string")
    twice, long = [r.x for r in lines.select(call("parse_syslog", F.col("v")).alias("x")).collect()]
    assert twice.structured == {"a.x": "2", "a.y": "3"}
    assert long.version is None and long.message == "t"


def test_an_abort_comes_before_later_errors(spark):
    rows = spark.createDataFrame([("1",), (None,), ("x",)], "a string")
    program = "if is_null(.a) { abort }\n.b = to_int!(.a)"
    assert sorted(remap(rows, program).select("a", "b").collect()) == [("1", 1), ("x", None)]
    kept, dropped = remap(rows, program, drop_on_error=True, reroute_dropped=True)
    assert [tuple(r) for r in kept.select("a", "b").collect()] == [("1", 1)]
    assert sorted((r.a or "", r.dropped_reason) for r in dropped.collect()) == [("", "aborted"), ("x", "to_int failed")]


def test_values_that_need_one_another(spark):
    rows = spark.createDataFrame([('{"a": "{\\"b\\": 2}"}', "k=v"), ("no", "k=v")], "x string, y string")
    program = "o = parse_json!(.x)\ni = parse_json!(string!(o.a))\np = parse_key_value!(.y)\n.b = int!(i.b)\n.k = string!(p.k)"
    assert [tuple(r) for r in remap(rows, program).select("b", "k").collect()] == [(2, "v"), (None, None)]
    assert set(remap(rows, program).columns) == {"x", "y", "b", "k"}


def test_codecs_hold_few_rows_and_run_once(spark, data):
    plan = plan_of(QUERIES["fn_compression"](spark, data))
    # an Arrow batch of long documents and all that is made of them does not fit a worker
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1


def test_documents_without_text_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["fn_compression"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [1, 3] and all(r.lz4 == r.gzip == r.sixty for r in out)


def test_costly_parsers_remember_short_texts():
    from weirflow.functions import registry

    met = []

    def fn(x):
        met.append(x)
        if x == "bad":
            raise ValueError(x)
        return x * 2

    run = registry.remembered(fn)
    assert [run(x) for x in ["a", "b", "a"]] == ["aa", "bb", "aa"] and met == ["a", "b"]
    long = "x" * (registry.SHORT + 1)
    assert run(long) == run(long) == long * 2 and met[2:] == [long, long]
    for _ in range(2):
        try:
            run("bad")
            raise AssertionError("it was read")
        except ValueError:
            pass
    for i in range(registry.KEPT + 10):
        assert run(str(i)) == str(i) * 2
    kept = run.__closure__[[c for c in run.__code__.co_freevars].index("kept")].cell_contents
    assert len(kept) <= registry.KEPT


def test_trees_of_many_and_equal_texts(spark):
    rows = spark.createDataFrame([("a: 1\nb: [x, ~]",), ("a:\tb",), ("a: [1",), ("a: 1\nb: [x, ~]",), (None,), ("",)], "v string").coalesce(1)
    found = [r.x for r in rows.select(F.to_json(call("parse_yaml", F.col("v"))).alias("x")).collect()]
    # a tab after a colon is a space, as in libyaml
    assert found == ['{"a":1,"b":["x",null]}', '{"a":"b"}', None, '{"a":1,"b":["x",null]}', None, "null"]
