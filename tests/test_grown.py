"""Registered queries against their SQL on tables that grew: keys beyond those of the given tables."""

import random

import duckdb

from lattica import api
from lattica import queries as own
from lattica.functions import Ctx

SF = "/root/testdata/sf0.001"


def _same(spark, name, table, sql, folder):
    """The query over the rows of a statement, and its SQL over the same rows."""
    con = duckdb.connect()
    con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(own.ORACLES[name])
    rows = own.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert rows and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


def test_years_of_more_than_four_digits(spark, tmp_path):
    keys = "SELECT unnest([0, 2932896, 2932897, 8999999, 100000000]) AS base"
    _same(spark, "expr_conversions", "orders", f"SELECT o.* REPLACE (o_orderkey + base AS o_orderkey) FROM '{SF}/orders.parquet' o, ({keys})", tmp_path)


def test_years_are_written_whole_with_their_sign(spark):
    df = spark.sql("SELECT timestamp_seconds(s) AS d FROM VALUES (-62135596800 - 86400 * 365 * 5L), (-30609792000), (0), (253402300800), (null) AS t(s)")
    out = df.select(Ctx(df).of({"$dateToString": {"date": "$d", "format": "%Y|%G"}}).col.alias("s")).collect()
    assert [r.s for r in out] == ["-4|-4", "1000|1000", "1970|1970", "10000|9999", None]


def _filled(rows, down):
    """Lines between neighbours, by looking at every row: {_id: v}."""
    rows = sorted(rows, key=lambda r: r[2], reverse=down)
    out = {}
    for i, (key, _, t, v) in enumerate(rows):
        before, after = [r for r in rows[:i] if r[3] is not None], [r for r in rows[i + 1 :] if r[3] is not None]
        if v is None and before and after:
            (t0, v0), (t1, v1) = before[-1][2:], after[0][2:]
            v = v0 + (v1 - v0) * (t - t0) / (t1 - t0)
        out[key] = v
    return out


def _fill_linear(df, down=False, **more):
    return api.aggregate(df, [{"$fill": {"partitionBy": "$g", "sortBy": {"t": -1 if down else 1}, "output": {"v": {"method": "linear"}} | more}}])


def test_linear_fill_is_the_line_between_neighbours(spark):
    rnd = random.Random(3)
    rows = [(i, i % 4, t, rnd.choice([None, None, float(rnd.randrange(50))]) if i % 4 else None) for i, t in enumerate(rnd.sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "_id int, g int, t int, v double").selectExpr("*", "-v AS w", "v AS l").repartition(5)
    for down in (False, True):
        want = {}
        for g in range(4):
            want |= _filled([r for r in rows if r[1] == g], down)
        got = _fill_linear(df, down, w={"method": "linear"}, l={"method": "locf"}).collect()
        assert got[0].asDict().keys() == {"_id", "g", "t", "v", "w", "l"} and {r._id: r.v for r in got} == want
        assert all(r.w == (None if r.v is None else -r.v) for r in got)


def test_linear_fill_does_not_scan_what_follows_for_each_row(spark):
    df = spark.range(10).selectExpr("id AS _id", "1 AS g", "id AS t", "CASE WHEN id % 3 = 0 THEN double(id) END AS v")
    plan = _fill_linear(df)._jdf.queryExecution().executedPlan().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_linear_fill_of_a_grown_table(spark, tmp_path):
    _same(spark, "linear_fill", "events", f"SELECT e.* REPLACE (event_id + 1000 * k AS event_id) FROM '{SF}/events.parquet' e, range(40) r(k)", tmp_path)
