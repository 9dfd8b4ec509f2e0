"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from weirflow.plans import function_queries, operator_queries, queries as catalogue  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_filters_reach_the_scan(spark, data):
    df = catalogue.QUERIES["filter_remap"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_counts_combine_before_the_shuffle(spark, data):
    plan = catalogue.QUERIES["dedupe_match"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
