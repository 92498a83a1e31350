"""Every library query that has SQL equals it."""

import math

import duckdb
import pytest

from kartospark.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ["embeddings", "events", "lineitem", "documents", "orders", "supplier"]


def plain(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    place = {c: i for i, c in enumerate(want.columns)}
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(r[place[c]]) for c in cols]) for r in want.fetchall())
    assert got or name == "finish_scores"  # the few points of this size have no pair of rings


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SMALL).count() > 0
