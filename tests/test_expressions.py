"""Expression operators on small literal inputs."""

import datetime as dt

import pytest

from lattica.functions import Ctx
from lattica.functions.core import ExpressionError, operators

D = dt.datetime(2024, 3, 10, 13, 45, 30, 123000)
CASES = [
    ({"$add": [1, 2.5]}, 3.5), ({"$add": [None, 1]}, None), ({"$subtract": [D, D]}, 0), ({"$multiply": []}, 1), ({"$divide": [7, 2]}, 3.5),
    ({"$mod": [-7, 3]}, -1), ({"$abs": -4}, 4), ({"$ceil": 1.2}, 2.0), ({"$floor": -1.2}, -2.0), ({"$round": [2.5, 0]}, 2.0), ({"$round": [3.5, 0]}, 4.0),
    ({"$trunc": [-1.79, 1]}, -1.7), ({"$pow": [2, 10]}, 1024), ({"$sqrt": 16}, 4.0), ({"$ln": 1}, 0.0), ({"$log10": 1000}, 3.0), ({"$exp": 0}, 1.0),
    ({"$sin": 0}, 0.0), ({"$cos": 0}, 1.0), ({"$atan2": [0, 1]}, 0.0), ({"$degreesToRadians": 0}, 0.0),
    ({"$eq": [None, None]}, True), ({"$lt": [None, 5]}, True), ({"$gt": ["a", 5]}, True), ({"$cmp": [1, 2]}, -1), ({"$ne": [1, 1.0]}, False),
    ({"$and": [1, "x"]}, True), ({"$and": [0, "x"]}, False), ({"$or": [None, 0]}, False), ({"$not": [None]}, True), ({"$cond": [0, "a", "b"]}, "b"),
    ({"$ifNull": [None, 4]}, 4), ({"$switch": {"branches": [{"case": False, "then": 1}], "default": 2}}, 2),
    ({"$concat": ["a", None]}, None), ({"$toUpper": "aé"}, "Aé"), ({"$toLower": None}, ""), ({"$strLenCP": "né"}, 2), ({"$strLenBytes": "né"}, 3),
    ({"$substrCP": ["héllo", 1, 2]}, "él"), ({"$substrBytes": ["héllo", 0, 3]}, "hé"), ({"$indexOfCP": ["abcabc", "c", 3]}, 5), ({"$indexOfBytes": ["éa", "a"]}, 2),
    ({"$indexOfCP": ["abc", "z"]}, -1), ({"$trim": {"input": "xxaxx", "chars": "x"}}, "a"), ({"$ltrim": {"input": "  a "}}, "a "), ({"$split": ["a-b-c", "-"]}, ["a", "b", "c"]),
    ({"$replaceOne": {"input": "aXbX", "find": "X", "replacement": "."}}, "a.bX"), ({"$replaceAll": {"input": "aXbX", "find": "X", "replacement": "."}}, "a.b."),
    ({"$regexMatch": {"input": "Hello", "regex": "^h", "options": "i"}}, True), ({"$strcasecmp": ["A", "b"]}, -1),
    ({"$arrayElemAt": [[1, 2, 3], -1]}, 3), ({"$arrayElemAt": [[1], 5]}, None), ({"$concatArrays": [[1], [2]]}, [1, 2]), ({"$in": [2, [1, 2]]}, True), ({"$in": [None, [1]]}, False),
    ({"$indexOfArray": [[1, 2, 1], 1, 1]}, 2), ({"$range": [5, 0, -2]}, [5, 3, 1]), ({"$range": [0, 0]}, []), ({"$reverseArray": [[1, 2]]}, [2, 1]), ({"$size": [[1, 2]]}, 2),
    ({"$slice": [[1, 2, 3], -2]}, [2, 3]), ({"$slice": [[1, 2, 3], 1, 1]}, [2]), ({"$map": {"input": [1, 2], "as": "x", "in": {"$add": ["$$x", 1]}}}, [2, 3]),
    ({"$filter": {"input": [1, 2, 3], "as": "x", "cond": {"$gt": ["$$x", 1]}, "limit": 1}}, [2]), ({"$reduce": {"input": [1, 2, 3], "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6),
    ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 9]}}, [[1, 3], [2, 9]]), ({"$sortArray": {"input": [3, 1, 2], "sortBy": -1}}, [3, 2, 1]),
    ({"$firstN": {"n": 2, "input": [1, 2, 3]}}, [1, 2]), ({"$lastN": {"n": 2, "input": [1, 2, 3]}}, [2, 3]), ({"$maxN": {"n": 1, "input": [1, 3, 2]}}, [3]), ({"$minN": {"n": 1, "input": [3, 1]}}, [1]),
    ({"$setUnion": [[1, 2], [2, 3]]}, [1, 2, 3]), ({"$setDifference": [[1, 2], [2]]}, [1]), ({"$setEquals": [[1, 1, 2], [2, 1]]}, True), ({"$setIsSubset": [[1], [1, 2]]}, True),
    ({"$allElementsTrue": [[1, 2]]}, True), ({"$anyElementTrue": [[0, 0]]}, False), ({"$sum": [1, 2]}, 3), ({"$avg": [[1, 2]]}, 1.5), ({"$max": [[1, 5, 2]]}, 5),
    ({"$stdDevPop": [[1, 3]]}, 1.0), ({"$median": {"input": [1, 2, 3, 4], "method": "approximate"}}, 2.0), ({"$percentile": {"input": [1, 2, 3, 4], "p": [0.9], "method": "approximate"}}, [4.0]),
    ({"$toInt": "42"}, 42), ({"$toDouble": "1.5"}, 1.5), ({"$toLong": 3.9}, 3), ({"$toBool": 0}, False), ({"$toString": 5}, "5"), ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1),
    ({"$convert": {"input": None, "to": "int", "onNull": 7}}, 7), ({"$type": [1.5]}, "double"), ({"$isNumber": "a"}, False), ({"$isArray": [[1]]}, True),
    ({"$year": D}, 2024), ({"$month": D}, 3), ({"$dayOfWeek": D}, 1), ({"$week": D}, 10), ({"$isoWeek": D}, 10), ({"$isoDayOfWeek": D}, 7), ({"$millisecond": D}, 123),
    ({"$hour": {"date": D, "timezone": "+02:00"}}, 15), ({"$dateToString": {"date": D, "format": "%Y-%m-%d %H:%M:%S.%L"}}, "2024-03-10 13:45:30.123"),
    ({"$dateDiff": {"startDate": dt.datetime(2024, 1, 31), "endDate": dt.datetime(2024, 2, 1), "unit": "month"}}, 1),
    ({"$dateToString": {"date": {"$dateAdd": {"startDate": dt.datetime(2024, 1, 31), "unit": "month", "amount": 1}}, "format": "%m-%d"}}, "02-29"),
    ({"$dateToString": {"date": {"$dateFromParts": {"year": 2024, "month": 14, "day": 0}}, "format": "%Y-%m-%d"}}, "2025-01-31"),
    ({"$dateToString": {"date": {"$dateTrunc": {"date": D, "unit": "week"}}, "format": "%Y-%m-%d"}}, "2024-03-10"), ({"$tsSecond": 2**33}, 2), ({"$tsIncrement": 2**33 + 5}, 5),
    ({"$let": {"vars": {"a": 2}, "in": {"$multiply": ["$$a", 3]}}}, 6), ({"$literal": "$x"}, "$x"), ({"$bsonSize": {"a": 1}}, 12), ({"$strLenCP": {"$toString": {"$literal": True}}}, 4),
]


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def test_all_operators_registered():
    assert len(operators()) >= 150


def test_values(one):
    ctx = Ctx(one)
    cols = [ctx.of(node).col.alias(f"c{i}") for i, (node, _) in enumerate(CASES)]
    row = one.select(*cols).first()
    wrong = []
    for i, (node, want) in enumerate(CASES):
        got = row[i]
        same = abs(got - want) < 1e-9 if isinstance(want, float) and got is not None else got == want
        if not same:
            wrong.append((node, got, want))
    assert not wrong


@pytest.mark.parametrize("node", [{"$nope": 1}, {"$add": 1, "$subtract": 2}, {"$slice": [1]}, "$$undefined", {"$range": [0, 1, 0]}])
def test_malformed(one, node):
    with pytest.raises(ExpressionError):
        Ctx(one).of(node)


@pytest.mark.parametrize("node", [{"$divide": [1, 0]}, {"$sqrt": -1}, {"$ln": 0}, {"$acos": 2}, {"$toInt": "x"}, {"$switch": {"branches": [{"case": False, "then": 1}]}}])
def test_runtime_errors(one, node):
    with pytest.raises(Exception):
        one.select(Ctx(one).of(node).col.alias("x")).collect()


def test_paths_and_variables(spark):
    df = spark.sql("select 1 as a, struct(2 as b, array(struct(3 as c), struct(4 as c)) as l) as o, array(1, 2) as xs")
    ctx = Ctx(df)
    row = df.select(ctx.of("$o.b").col, ctx.of("$o.l.c").col, ctx.of("$missing.x").col, ctx.of({"$map": {"input": "$xs", "as": "x", "in": {"$filter": {"input": "$o.l", "as": "y", "cond": {"$gt": ["$$y.c", {"$add": ["$$x", 1]}]}}}}}).col).first()
    assert row[0] == 2 and row[1] == [3, 4] and row[2] is None
    assert [[y.c for y in x] for x in row[3]] == [[3, 4], [4]]
