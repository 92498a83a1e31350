"""Every training-data query that has SQL equals it."""

import duckdb
import pytest

from kartospark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    place = {c: i for i, c in enumerate(want.columns)}

    def rows(found, at):
        return sorted(repr([round(v, 5) if isinstance(v, float) else v for v in (r[at(c)] for c in cols)]) for r in found)

    got = rows(df.collect(), lambda c: c)
    assert got == rows(want.fetchall(), place.get)
    assert got
