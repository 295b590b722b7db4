"""Accumulators that keep n values hold n values, in the order that gathering all rows would give."""

import math
import random

import pytest

from lattica import api
from lattica.functions.core import ExpressionError

WORDS = [None, "", "a", "ab", "abc", "b", "Z", "é", "éa", "zz", "\U0001f600"]


def _rows(n=400):
    rnd = random.Random(5)
    return [(i, rnd.choice("xyz"), rnd.choice(WORDS), rnd.choice([None, 1, 2, 3])) for i in range(n)]


def _frame(spark):
    return spark.createDataFrame(_rows(), "_id int, g string, s string, v int").repartition(7)


def _expected(rows, n, last):
    """By s downwards (nulls last, longer texts before their prefixes), then _id upwards."""
    rows = sorted(rows, key=lambda r: r[0])
    rows = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode()), reverse=True)
    return [r[0] for r in (rows[-n:] if last else rows[:n])]


def test_top_and_bottom_by_descending_text(spark):
    by = {"s": -1, "_id": 1}
    got = api.aggregate(_frame(spark), [{"$group": {
        "_id": "$g", "top": {"$topN": {"n": 7, "sortBy": by, "output": "$_id"}}, "low": {"$bottomN": {"n": 7, "sortBy": by, "output": "$_id"}},
        "one": {"$top": {"sortBy": by, "output": "$_id"}}, "end": {"$bottom": {"sortBy": by, "output": "$_id"}}}}])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        mine = [x for x in _rows() if x[1] == r._id]
        assert r.top == _expected(mine, 7, False) and r.low == _expected(mine, 7, True)
        assert r.one == r.top[0] and r.end == r.low[-1]


def test_first_last_keep_nulls_and_min_max_leave_them_out(spark):
    got = api.aggregate(_frame(spark), [{"$sort": {"_id": 1}}, {"$group": {
        "_id": None, "f": {"$firstN": {"n": 9, "input": "$v"}}, "l": {"$lastN": {"n": 9, "input": "$v"}},
        "lo": {"$minN": {"n": 4, "input": "$v"}}, "hi": {"$maxN": {"n": 4, "input": "$v"}}, "all": {"$maxN": {"n": 1000, "input": "$v"}}}}])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    r, values = got.first(), [x[3] for x in _rows()]
    there = sorted(v for v in values if v is not None)
    assert (r.f, r.l) == (values[:9], values[-9:])
    assert (r.lo, r.hi, r.all) == (there[:4], there[::-1][:4], there[::-1])


def test_n_of_nothing_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, -2.0), (4, 5.0)], "_id int, x double")
    spec = {"_id": None, "lo": {"$minN": {"n": 2, "input": "$x"}}, "hi": {"$maxN": {"n": 2, "input": "$x"}}}
    r = api.aggregate(df, [{"$group": spec}]).first()
    assert math.isnan(r.lo[0]) and r.lo[1] == -2.0 and r.hi == [5.0, -2.0]
    assert api.aggregate(df.filter("x is null"), [{"$group": spec}]).first().lo == []
    assert api.aggregate(df.limit(0), [{"$group": spec}]).count() == 0


@pytest.mark.parametrize("frame", [["unbounded", "current"], [-2, 1], ["unbounded", "unbounded"], [1, 3]])
def test_integral_by_unit_is_the_sum_of_its_trapezoids(spark, frame):
    rnd = random.Random(3)
    rows = [(i, "ab"[i % 2], i * i * 1000, None if i == 9 else rnd.random()) for i in range(20)]
    df = spark.createDataFrame(rows, "_id int, g string, ms long, y double").selectExpr("_id", "g", "timestamp_millis(ms) AS t", "y")
    got = api.aggregate(df, [{"$setWindowFields": {"partitionBy": "$g", "sortBy": {"t": 1}, "output": {"a": {"$integral": {"input": "$y", "unit": "second"}, "window": {"documents": frame}}}}}])
    assert set(got.columns) == {"_id", "g", "t", "y", "a"}
    found = {r._id: r.a for r in got.collect()}
    for g in "ab":
        mine = [r for r in rows if r[1] == g]
        for i, r in enumerate(mine):
            lo, hi = (0 if frame[0] == "unbounded" else i + frame[0]), {"current": i, "unbounded": len(mine)}.get(frame[1], frame[1] if isinstance(frame[1], str) else i + frame[1])
            part = mine[max(lo, 0) : hi + 1]
            steps = [None if a[3] is None or b[3] is None else (b[2] - a[2]) / 1000 * (a[3] + b[3]) / 2 for a, b in zip(part, part[1:])]
            want = None if None in steps else sum(steps)
            assert found[r[0]] == (want if want is None else pytest.approx(want, abs=1e-9))


@pytest.mark.parametrize("how", [{"N": 3}, {"alpha": 0.01}, {"alpha": 0.9}, {"N": 1}])
def test_moving_average_is_the_recursion(spark, how):
    rnd = random.Random(4)
    rows = [(i, "abc"[i % 3], None if rnd.random() < 0.3 or i % 3 == 2 else rnd.uniform(-9, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "_id int, g string, x double").repartition(5)
    got = api.aggregate(df, [{"$setWindowFields": {"partitionBy": "$g", "sortBy": {"_id": 1}, "output": {"e": {"$expMovingAvg": {"input": "$x"} | how}}}}])
    assert got.columns == ["_id", "g", "x", "e"] and "collect_list" not in got._jdf.queryExecution().toString()
    found, alpha, now = {r._id: r.e for r in got.collect()}, how.get("alpha") or 2 / (how["N"] + 1), {}
    for i, g, x in rows:
        if x is not None:
            now[g] = x if g not in now else x * alpha + now[g] * (1 - alpha)
        assert found[i] == (pytest.approx(now[g], abs=1e-9) if g in now else None)


def test_sorts_and_ranges_that_are_not_offered_are_refused(spark):
    df = _frame(spark)
    with pytest.raises(Exception, match="meta"):
        api.aggregate(df, [{"$sort": {"score": {"$meta": "textScore"}}}])
    with pytest.raises(ExpressionError, match="meta"):
        api.find(df, sort={"score": {"$meta": "textScore"}})
    with pytest.raises(ExpressionError, match="ascending"):
        api.aggregate(df, [{"$setWindowFields": {"sortBy": {"v": -1}, "output": {"n": {"$sum": "$v", "window": {"range": [-1, 1]}}}}}])
