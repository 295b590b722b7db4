"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lattica import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF)
    want = duck.sql(own.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = sorted(repr(tuple(_value(r[c]) for c in cols)) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(repr(tuple(_value(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
