"""Search strings against rows that meet them and rows that don't."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators.routing import filter_events

SCHEMA = "id int, message string, tags array<string>, host string, source string, status string, a struct<s: string, n: bigint, f: double, b: boolean>"
ROW = {"message": "hello wide world", "tags": ["env:prod", "bare", "v:12"], "host": "foo", "source": "nginx", "status": "warn", "a": ("text", 200, 0.75, True)}


def meets(spark, query, **changes):
    row = ROW | changes
    df = spark.createDataFrame([(1, *[row[k] for k in ("message", "tags", "host", "source", "status", "a")])], SCHEMA).withColumn("text_number", F.lit("150"))
    return filter_events(df, {"type": "search", "source": query}).count() == 1


@pytest.mark.parametrize("query", ["", "*", "hello", "HOST:x OR hello", "wor*", "*orld", "w?de", '"wide world"', "env:prod", "env:pr*", "bare:*", "tags:bare", "_exists_:env", "_exists_:host", "_missing_:nope", "host:foo", "host:f*", "source:nginx", "@a.s:text", "@a.n:200", "@a.f:0.75", "@a.b:true", "@a.n:>100", "@a.n:<=200", "@a.f:<1", "@a.n:[100 TO 200]", "-host:bar", "NOT host:bar", "hello AND env:prod", "hello env:prod", "(host:bar OR host:foo) -@a.n:1", "v:>10", "@a.s:*"])
def test_meets(spark, query):
    assert meets(spark, query)


@pytest.mark.parametrize("query", ["hell", "wid", '"world wide"', "env:dev", "env:p", "tags:env", "_missing_:host", "_exists_:nope", "host:foobar", "host:oo", "@a.s:tex", "@a.n:>200", "@a.n:{100 TO 200}", "@a.s:>10", "-host:foo", "NOT hello", "hello AND env:dev", "@text_number:>100", "@none:1"])
def test_does_not_meet(spark, query):
    assert not meets(spark, query)


@pytest.mark.parametrize("query", ["(a", "a)", "AND", "a:"])
def test_refused(spark, query):
    with pytest.raises(ValueError):
        meets(spark, query)


def test_null_fields_meet_nothing(spark):
    for q in ("hello", "host:foo", "@a.n:200", "env:prod"):
        assert not meets(spark, q, message=None, tags=None, host=None, a=None)
