"""Further registered queries: the operators that the main ones leave out, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .operators.updates import update
from .plans.pipeline import Pipeline
from .queries import Tables, _add, _pipe
from .sources.store import Store
from .sources.versioning import Repository
from .streaming.cdc import apply_stream, follow, initial_sync, sessions, windowed


def _r(e, n=6):
    return {"$round": [e, n]}


def _scratch(t: Tables, label: str) -> str:
    """A new folder that all executors share."""
    run = Pipeline(t.spark)
    return f"{run.shared()}/{label}-{uuid.uuid4().hex}"


# expressions: numbers

_pipe("expr_trigonometry", "lineitem", [
    {"$project": {
        "_id": 0, "l_orderkey": 1, "l_linenumber": 1, "cos": _r({"$cos": "$l_quantity"}), "tan": _r({"$tan": "$l_discount"}), "acos": _r({"$acos": "$l_discount"}), "asin": _r({"$asin": "$l_discount"}),
        "atan": _r({"$atan": "$l_quantity"}), "atan2": _r({"$atan2": ["$l_quantity", "$l_discount"]}), "sinh": _r({"$sinh": "$l_discount"}), "cosh": _r({"$cosh": "$l_discount"}), "tanh": _r({"$tanh": "$l_discount"}),
        "asinh": _r({"$asinh": "$l_quantity"}), "acosh": _r({"$acosh": "$l_quantity"}), "atanh": _r({"$atanh": "$l_discount"}), "deg": _r({"$degreesToRadians": "$l_quantity"}), "rad": _r({"$radiansToDegrees": "$l_discount"}),
        "exp": _r({"$exp": "$l_discount"}), "log": _r({"$log": ["$l_quantity", 3]}), "log10": _r({"$log10": "$l_extendedprice"}), "trunc": {"$trunc": ["$l_extendedprice", 1]}}},
], """
    SELECT l_orderkey, l_linenumber, round(cos(l_quantity), 6) AS cos, round(tan(l_discount), 6) AS tan, round(acos(l_discount), 6) AS acos, round(asin(l_discount), 6) AS asin, round(atan(l_quantity), 6) AS atan,
           round(atan2(l_quantity, l_discount), 6) AS atan2, round(sinh(l_discount), 6) AS sinh, round(cosh(l_discount), 6) AS cosh, round(tanh(l_discount), 6) AS tanh, round(asinh(l_quantity), 6) AS asinh,
           round(acosh(l_quantity), 6) AS acosh, round(atanh(l_discount), 6) AS atanh, round(radians(l_quantity), 6) AS deg, round(degrees(l_discount), 6) AS rad, round(exp(l_discount), 6) AS exp,
           round(ln(l_quantity) / ln(3), 6) AS log, round(log10(l_extendedprice), 6) AS log10, floor(round(l_extendedprice * 100) / 10) / 10 AS trunc FROM lineitem""")  # fmt: skip

_pipe("expr_logic", "orders", [
    {"$project": {
        "_id": 0, "o_orderkey": 1, "ge": {"$gte": ["$o_totalprice", 100000]}, "le": {"$lte": ["$o_custkey", 75]}, "no": {"$not": [{"$gt": ["$o_custkey", 10]}]}, "any": {"$or": [{"$eq": ["$o_orderstatus", "F"]}, {"$eq": ["$o_orderstatus", "P"]}]},
        "lt": {"$lt": [None, "$o_custkey"]}, "eq": {"$eq": ["$o_orderkey", "$o_custkey"]}, "lit": {"$literal": "$o_custkey"}, "const": {"$const": 7}, "r": {"$lt": [{"$rand": {}}, 1]},
        "arr": {"$isArray": ["$o_custkey"]}, "num": {"$isNumber": "$o_totalprice"}, "str": {"$isString": "$o_orderstatus"}, "date": {"$isDate": "$o_orderdate"}, "oid": {"$isObjectId": "$o_orderstatus"}}},
], """
    SELECT o_orderkey, o_totalprice >= 100000 AS ge, o_custkey <= 75 AS le, NOT (o_custkey > 10) AS no, o_orderstatus IN ('F', 'P') AS any, true AS lt, o_orderkey = o_custkey AS eq, '$o_custkey' AS lit, 7 AS const, true AS r,
           false AS arr, true AS num, true AS str, true AS date, false AS oid FROM orders""")  # fmt: skip

# expressions: arrays and sets

_LIST = {"$map": {"input": {"$range": [0, {"$add": [1, {"$mod": ["$o_orderkey", 5]}]}]}, "as": "i", "in": {"$mod": [{"$add": [{"$multiply": ["$$i", "$$i", 7]}, "$o_custkey"]}, 11]}}}
_LIST_SQL = "[(7 * i * i + o_custkey) % 11 FOR i IN range(0, 1 + o_orderkey % 5)]"
_pipe("expr_arrays_more", "orders", [
    {"$project": {"o_orderkey": 1, "o_custkey": 1, "a": _LIST}},
    {"$project": {
        "_id": 0, "o_orderkey": 1, "cat": {"$size": {"$concatArrays": ["$a", [1, 2], "$a"]}}, "at": {"$indexOfArray": ["$a", 3]}, "rev": {"$first": {"$reverseArray": "$a"}}, "sorted": {"$last": {"$sortArray": {"input": "$a", "sortBy": -1}}},
        "all": {"$allElementsTrue": ["$a"]}, "some": {"$anyElementTrue": ["$a"]}, "diff": {"$size": {"$setDifference": ["$a", [0, 1, 2]]}}, "same": {"$setEquals": ["$a", [0, 7]]},
        "f2": {"$sum": {"$firstN": {"n": 2, "input": "$a"}}}, "l2": {"$sum": {"$lastN": {"n": 2, "input": "$a"}}}, "mx2": {"$sum": {"$maxN": {"n": 2, "input": "$a"}}}, "mn2": {"$sum": {"$minN": {"n": 2, "input": "$a"}}},
        "avg": _r({"$avg": "$a"}), "lo": {"$min": "$a"}, "hi": {"$max": ["$o_custkey", 40]}, "med": {"$median": {"input": "$a", "method": "approximate"}}, "p": {"$arrayElemAt": [{"$percentile": {"input": "$a", "p": [0.25], "method": "approximate"}}, 0]},
        "sp": _r({"$stdDevPop": "$a"}), "ss": _r({"$stdDevSamp": "$a"})}},
], f"""
    WITH x AS (SELECT o_orderkey, o_custkey, {_LIST_SQL} AS a FROM orders)
    SELECT o_orderkey, CAST(2 * len(a) + 2 AS INTEGER) AS cat, CAST(coalesce(list_position(a, 3), 0) - 1 AS INTEGER) AS at, a[-1] AS rev, list_min(a) AS sorted, NOT list_contains(a, 0) AS all, len(list_filter(a, lambda v: v <> 0)) > 0 AS some,
           CAST(len(list_distinct(list_filter(a, lambda v: v > 2))) AS INTEGER) AS diff, list_sort(list_distinct(a)) = [0, 7] AS same, CAST(list_sum(a[1:2]) AS BIGINT) AS f2, CAST(list_sum(a[-2:]) AS BIGINT) AS l2,
           CAST(list_sum(list_reverse_sort(a)[1:2]) AS BIGINT) AS mx2, CAST(list_sum(list_sort(a)[1:2]) AS BIGINT) AS mn2, round(list_avg(a), 6) AS avg, list_min(a) AS lo, greatest(o_custkey, 40) AS hi,
           CAST(list_sort(a)[CAST(ceil(0.5 * len(a)) AS INTEGER)] AS DOUBLE) AS med, CAST(list_sort(a)[CAST(ceil(0.25 * len(a)) AS INTEGER)] AS DOUBLE) AS p,
           round(list_stddev_pop(a), 6) AS sp, round(list_stddev_samp(a), 6) AS ss FROM x""")  # fmt: skip

# expressions: objects and conversions

_pipe("expr_objects_more", "customer", [
    {"$set": {"d": {"n": "$c_name", "k": "$c_nationkey"}}},
    {"$project": {
        "_id": 0, "c_custkey": 1, "set": {"$getField": {"field": "z", "input": {"$setField": {"field": "z", "input": "$d", "value": {"$add": ["$c_nationkey", 1]}}}}}, "over": {"$getField": {"field": "k", "input": {"$setField": {"field": "k", "input": "$d", "value": "$c_custkey"}}}},
        "gone": {"$size": {"$objectToArray": {"$unsetField": {"field": "k", "input": "$d"}}}}, "made": {"$getField": {"field": "b", "input": {"$arrayToObject": [[{"k": "a", "v": 1}, {"k": "b", "v": "$c_nationkey"}]]}}},
        "size": {"$bsonSize": "$d"}, "type": {"$type": "$nothing"}, "none": {"$meta": "textScore"}}},
], """
    SELECT c_custkey, CAST(c_nationkey + 1 AS BIGINT) AS set, c_custkey AS over, 1 AS gone, c_nationkey AS made, CAST(5 + (2 + 1 + 5 + strlen(c_name)) + (2 + 1 + 4) AS INTEGER) AS size, 'missing' AS type, CAST(NULL AS DOUBLE) AS none FROM customer""")  # fmt: skip

_pipe("expr_conversions", "orders", [
    {"$project": {
        "_id": 0, "o_orderkey": 1, "i": {"$toInt": "$o_totalprice"}, "l": {"$toLong": {"$toString": "$o_custkey"}}, "b": {"$toBool": {"$mod": ["$o_orderkey", 2]}}, "dec": {"$toDouble": {"$toDecimal": {"$toString": "$o_totalprice"}}},
        "date": {"$dateToString": {"date": {"$toDate": {"$multiply": ["$o_orderkey", 86400000]}}, "format": "%Y-%m-%d"}}, "low": {"$toLower": "$o_orderpriority"}, "ms": {"$toLong": "$o_orderdate"},
        "oid": {"$toString": {"$toObjectId": {"$concat": ["0123456789abcdef0123", {"$substrCP": [{"$toString": {"$add": [1000, {"$mod": ["$o_orderkey", 1000]}]}}, 0, 4]}]}}},
        "uuid": {"$binarySize": {"$toUUID": "0e3b9063-8abd-4eb3-9f9f-f4c59fd30a60"}}, "conv": {"$convert": {"input": "$o_orderstatus", "to": "int", "onError": -5}}}},
], """
    SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS i, o_custkey AS l, o_orderkey % 2 = 1 AS b, o_totalprice AS dec, strftime(TIMESTAMP '1970-01-01' + to_days(CAST(o_orderkey AS INTEGER)), '%Y-%m-%d') AS date,
           lower(o_orderpriority) AS low, epoch_ms(o_orderdate) AS ms, '0123456789abcdef0123' || CAST(1000 + o_orderkey % 1000 AS VARCHAR) AS oid, 16 AS uuid, -5 AS conv FROM orders""")  # fmt: skip

_pipe("expr_strings_more", "conversations", [
    {"$project": {
        "_id": 0, "conv_id": 1, "turn": 1, "bytes": {"$strLenBytes": "$text"}, "at": {"$indexOfBytes": ["$text", "e"]}, "lt": {"$strLenCP": {"$ltrim": {"input": {"$concat": ["  ", "$role", " "]}}}},
        "rt": {"$strLenCP": {"$rtrim": {"input": {"$concat": ["  ", "$role", " "]}}}}, "low": {"$toLower": "$role"}, "sub": {"$substr": ["$role", 1, 2]}, "subb": {"$substrBytes": ["$role", 0, 3]}}},
], """
    SELECT conv_id, turn, CAST(strlen(text) AS INTEGER) AS bytes, CAST(CASE WHEN instr(text, 'e') = 0 THEN -1 ELSE strlen(substr(text, 1, CAST(instr(text, 'e') - 1 AS BIGINT))) END AS INTEGER) AS at,
           CAST(length(role) + 1 AS INTEGER) AS lt, CAST(length(role) + 2 AS INTEGER) AS rt, lower(role) AS low, substr(role, 2, 2) AS sub, substr(role, 1, 3) AS subb FROM conversations""")  # fmt: skip

# expressions: dates

_pipe("expr_dates_more", "events", [
    {"$project": {
        "_id": 0, "event_id": 1, "day": {"$dayOfMonth": "$ts"}, "mon": {"$month": "$ts"}, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}, "ms": {"$millisecond": "$ts"}, "iso": {"$isoDayOfWeek": "$ts"}, "wk": {"$week": "$ts"},
        "made": {"$dateToString": {"date": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": {"$add": [{"$month": "$ts"}, 12]}, "day": 1, "hour": 30}}, "format": "%Y-%m-%d %H"}},
        "isomade": {"$dateToString": {"date": {"$dateFromParts": {"isoWeekYear": 2024, "isoWeek": {"$isoWeek": "$ts"}, "isoDayOfWeek": 3}}, "format": "%Y-%m-%d"}},
        "read": {"$dateToString": {"date": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$ts", "format": "%d/%m/%Y %H:%M"}}, "format": "%d/%m/%Y %H:%M"}}, "format": "%Y-%m-%dT%H:%M"}},
        "less": {"$dateToString": {"date": {"$dateSubtract": {"startDate": "$ts", "unit": "hour", "amount": 36}}, "format": "%Y-%m-%d %H"}},
        "parts": {"$let": {"vars": {"p": {"$dateToParts": {"date": "$ts"}}}, "in": {"$add": [{"$multiply": ["$$p.year", 10000]}, {"$multiply": ["$$p.month", 100]}, "$$p.day"]}}},
        "sec": {"$tsSecond": {"$add": [{"$multiply": ["$event_id", 4294967296]}, 5]}}, "inc": {"$tsIncrement": {"$add": [{"$multiply": ["$event_id", 4294967296]}, 5]}}}},
], """
    SELECT event_id, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS mon, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST((epoch_us(ts) // 1000) % 1000 AS INTEGER) AS ms,
           CAST(isodow(ts) AS INTEGER) AS iso, CAST(strftime(ts, '%U') AS INTEGER) AS wk, strftime(date_trunc('month', ts) + INTERVAL 1 YEAR + INTERVAL 30 HOUR, '%Y-%m-%d %H') AS made,
           strftime(TIMESTAMP '2024-01-03' + to_days(CAST(7 * (weekofyear(ts) - 1) AS INTEGER)), '%Y-%m-%d') AS isomade, strftime(ts, '%Y-%m-%dT%H:%M') AS read, strftime(ts - INTERVAL 36 HOUR, '%Y-%m-%d %H') AS less,
           CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS parts, event_id AS sec, CAST(5 AS BIGINT) AS inc FROM events""")  # fmt: skip

# filters and finds

_words = lambda t: t["part"].withColumn("w", F.split("p_name", " "))

_add("filter_arrays", """
    WITH x AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
    SELECT p_partkey FROM x WHERE (list_contains(w, 'red') AND list_contains(w, 'widget')) OR (len(list_filter(w, lambda v: v > 's' AND v < 't')) > 0 AND len(w) = 2 AND p_brand NOT IN ('Brand#1', 'Brand#2'))""",
    lambda t: api.find(_words(t), {"$or": [{"w": {"$all": ["red", "widget"]}}, {"w": {"$elemMatch": {"$gt": "s", "$lt": "t"}, "$size": 2}, "p_brand": {"$nin": ["Brand#1", "Brand#2"]}}], "$comment": "arrays"}, {"p_partkey": 1}))

_add("filter_bits_nor", """
    SELECT p_partkey FROM part WHERE (p_size & 6) <> 0 AND (p_size & 8) = 0 AND (p_size & 5) <> 5 AND NOT (p_retailprice > 1500 OR p_type = 'ECONOMY')""",
    lambda t: api.find(t["part"], {"p_size": {"$bitsAnySet": [1, 2], "$bitsAllClear": 8, "$bitsAnyClear": 5}, "$nor": [{"p_retailprice": {"$gt": 1500}}, {"p_type": "ECONOMY"}, {"$alwaysFalse": 1}], "$alwaysTrue": 1, "$sampleRate": 1.0}, {"p_partkey": 1}))

_add("filter_eq_null_ranges", """
    SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic <= 0 AND doc_id >= 3""",
    lambda t: api.find(t["labels"], {"quality": {"$eq": 1}, "toxic": {"$lte": 0}, "doc_id": {"$gte": 3}, "gone": None}, {"doc_id": 1, "quality": 1}))

_add("filter_dbref", "SELECT o_orderkey FROM orders WHERE o_custkey = 7",
     lambda t: api.find(t["orders"].withColumn("ref", F.struct(F.lit("customer").alias("$ref"), F.col("o_custkey").alias("$id"))), {"ref": {"$ref": "customer", "$id": 7}}, {"o_orderkey": 1}))

_add("find_projections", """
    WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w, [p_size % 7, p_size % 5, p_size % 3] AS n FROM part)
    SELECT p_partkey, array_to_string(w[1:1], ',') AS w1, CAST(n[-1] AS BIGINT) AS last, CAST(list_filter(n, lambda v: v >= 1)[1] AS BIGINT) AS hit FROM x WHERE len(list_filter(n, lambda v: v >= 1)) > 0""",
    lambda t: api.find(
        t["part"].select("p_partkey", F.split("p_name", " ").alias("w"), F.expr("array(p_size % 7, p_size % 5, p_size % 3)").alias("n"), F.expr("array(p_size % 7, p_size % 5, p_size % 3)").alias("m")),
        {"n": {"$elemMatch": {"$gte": 1}}}, {"p_partkey": 1, "w": {"$slice": 1}, "m": {"$slice": -1}, "n.$": 1},
    ).select("p_partkey", F.array_join("w", ",").alias("w1"), F.col("m")[0].cast("long").alias("last"), F.col("n")[0].cast("long").alias("hit")))

_add("find_natural_count", """
    SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS n, (SELECT count(*) FROM customer) AS s, (SELECT count(*) FROM nation) AS c, (SELECT min(n_nationkey) FROM nation) AS first""",
    lambda t: t.spark.range(1).select(
        F.lit(api.count(t["orders"], {"o_totalprice": {"$gt": 100000}})).cast("long").alias("n"),
        F.lit(api.aggregate(t["customer"], [{"$sample": {"size": 10**9}}, {"$count": "n"}]).first()["n"]).cast("long").alias("s"),
        F.lit(api.aggregate(t["nation"], [{"$collStats": {"count": {}}}]).first()["count"]).cast("long").alias("c"),
        F.lit(api.find(t["nation"].withColumnRenamed("n_nationkey", "_id"), {}, {"_id": 1}, sort={"$natural": 1}, limit=1).first()["_id"]).cast("int").alias("first")))

_pipe("sort_skip", "customer", [{"$sort": {"c_acctbal": 1, "c_custkey": 1}}, {"$skip": 10}, {"$limit": 100}, {"$project": {"_id": 0, "c_custkey": 1, "c_acctbal": 1}}],
      "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100 OFFSET 10")

_add("documents_stage", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(x, y) WHERE x > 1",
     lambda t: api.aggregate(None, [{"$documents": [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]}, {"$match": {"x": {"$gt": 1}}}], t, t.spark))

_place = lambda t: t["customer"].withColumn("loc", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000))
_add("geo_shapes", """
    WITH x AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 1000 AS y FROM customer)
    SELECT c_custkey, x BETWEEN 5 AND 15 AND y BETWEEN 2 AND 6 AS box, x >= 5 AND x <= 15 AND y >= 2 AND y <= 6 AND NOT (x > 8 AND x < 10 AND y > 3 AND y < 4) AS poly, x >= 2 AND y >= 1 AND x + y <= 12 AS tri,
           2 * asin(sqrt(pow(sin(radians(y - 4) / 2), 2) + cos(radians(y)) * cos(radians(4)) * pow(sin(radians(x - 10) / 2), 2))) <= 0.1 AS sphere, sqrt(pow(x - 10, 2) + pow(y - 4, 2)) <= 3 AS near,
           2 * asin(sqrt(pow(sin(radians(y - 4) / 2), 2) + cos(radians(y)) * cos(radians(4)) * pow(sin(radians(x - 10) / 2), 2))) BETWEEN 0.02 AND 0.05 AS nears FROM x""",
    lambda t: _flags(_place(t), {
        "box": {"loc": {"$geoWithin": {"$box": [[5, 2], [15, 6]]}}}, "near": {"loc": {"$near": [10, 4], "$maxDistance": 3}}, "nears": {"loc": {"$nearSphere": [10, 4], "$minDistance": 0.02, "$maxDistance": 0.05}},
        "poly": {"loc": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[5, 2], [15, 2], [15, 6], [5, 6], [5, 2]], [[8, 3], [10, 3], [10, 4], [8, 4], [8, 3]]]}}}},
        "tri": {"loc": {"$geoWithin": {"$polygon": [[2, 1], [11, 1], [2, 10]]}}}, "sphere": {"loc": {"$geoWithin": {"$centerSphere": [[10, 4], 0.1]}}}}))


def _flags(df: DataFrame, tests: dict) -> DataFrame:
    from .functions.core import Ctx
    from .plans.filters import compile_filter

    return df.select("c_custkey", *[compile_filter(v, Ctx(df)).alias(k) for k, v in tests.items()])


# groups

_pipe("group_lists", "orders", [
    {"$group": {
        "_id": "$o_custkey", "all": {"$push": "$o_totalprice"}, "last2": {"$lastN": {"n": 2, "input": "$o_orderkey"}}, "top2": {"$maxN": {"n": 2, "input": "$o_totalprice"}}, "low": {"$bottom": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}},
        "low2": {"$bottomN": {"n": 2, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "doc": {"$mergeObjects": {"k": "$o_orderkey", "s": "$o_orderstatus"}}, "set": {"$addToSet": "$o_orderstatus"},
        "pct": {"$percentile": {"input": "$o_totalprice", "p": [0.1, 0.5, 0.99], "method": "approximate"}}, "first3": {"$firstN": {"n": 3, "input": "$o_orderkey"}}}},
    {"$project": {
        "_id": 1, "n": {"$size": "$all"}, "sum": _r({"$sum": "$all"}, 2), "head": {"$first": "$all"}, "last2": {"$first": "$last2"}, "end": {"$last": "$last2"}, "top2": {"$last": "$top2"}, "low": 1, "low2": {"$first": "$low2"}, "k": "$doc.k", "s": "$doc.s",
        "kinds": {"$size": "$set"}, "p0": {"$first": "$pct"}, "p2": {"$last": "$pct"}, "first3": {"$last": "$first3"}}},
], """
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS c,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    SELECT o_custkey AS _id, CAST(count(*) AS INTEGER) AS n, round(sum(o_totalprice), 2) AS sum, min(o_totalprice) FILTER (i = 1) AS head, min(o_orderkey) FILTER (i >= c - 1) AS last2, max(o_orderkey) AS end,
           min(o_totalprice) FILTER (r <= 2) AS top2, min(o_orderkey) FILTER (r = c) AS low, min(o_orderkey) FILTER (r = greatest(c - 1, 1)) AS low2, max(o_orderkey) AS k, min(o_orderstatus) FILTER (i = c) AS s,
           CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS kinds, quantile_disc(o_totalprice, 0.1) AS p0, quantile_disc(o_totalprice, 0.99) AS p2, max(o_orderkey) FILTER (i <= 3) AS first3 FROM x GROUP BY 1""")  # fmt: skip

_pipe("group_whole_table", "lineitem", [
    {"$group": {
        "_id": None, "n": {"$sum": 1}, "hi": {"$maxN": {"n": 3, "input": "$l_extendedprice"}}, "lo": {"$minN": {"n": 3, "input": "$l_extendedprice"}}, "med": {"$median": {"input": "$l_extendedprice", "method": "approximate"}},
        "top": {"$topN": {"n": 3, "sortBy": {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}, "output": "$l_orderkey"}}, "p": {"$percentile": {"input": "$l_quantity", "p": [0.05, 0.95], "method": "approximate"}}}},
    {"$project": {"_id": 0, "n": 1, "med": 1, "hi3": {"$last": "$hi"}, "lo3": {"$last": "$lo"}, "top3": {"$last": "$top"}, "p5": {"$first": "$p"}, "p95": {"$last": "$p"}}},
], """
    WITH x AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, row_number() OVER (ORDER BY l_extendedprice) AS a FROM lineitem)
    SELECT count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS med, min(l_extendedprice) FILTER (r <= 3) AS hi3, max(l_extendedprice) FILTER (a <= 3) AS lo3, min(l_orderkey) FILTER (r = 3) AS top3,
           quantile_disc(l_quantity, 0.05) AS p5, quantile_disc(l_quantity, 0.95) AS p95 FROM x""")  # fmt: skip

# joins

_F = {"from": "customer", "let": {"k": "$_id", "s": "$spent"}, "as": "c", "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$c_custkey", "$$k"]}, {"$lt": ["$c_acctbal", "$$s"]}]}}}, {"$project": {"c_name": 1, "c_acctbal": 1}}]}
_pipe("lookup_after_group", "orders", [
    {"$group": {"_id": "$o_custkey", "spent": {"$sum": "$o_totalprice"}, "all": {"$push": "$o_orderkey"}}}, {"$lookup": _F},
    {"$project": {"_id": 1, "n": {"$size": "$all"}, "name": {"$arrayElemAt": ["$c.c_name", 0]}, "found": {"$size": "$c"}}},
], """
    SELECT o_custkey AS _id, CAST(count(*) AS INTEGER) AS n, CASE WHEN any_value(c_acctbal) < sum(o_totalprice) THEN any_value(c_name) END AS name, CAST(CASE WHEN any_value(c_acctbal) < sum(o_totalprice) THEN 1 ELSE 0 END AS INTEGER) AS found
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip

_pipe("lookup_after_sort_limit", "customer", [
    {"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$limit": 50},
    {"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "as": "o", "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}}}, {"$group": {"_id": None, "n": {"$sum": 1}, "t": {"$sum": "$o_totalprice"}}}]}},
    {"$project": {"_id": 0, "c_custkey": 1, "n": {"$ifNull": [{"$arrayElemAt": ["$o.n", 0]}, 0]}, "t": _r({"$ifNull": [{"$arrayElemAt": ["$o.t", 0]}, 0.0]}, 2)}},
], """
    WITH c AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50)
    SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS t FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")  # fmt: skip

_pipe("lookup_array_after_group", "part", [
    {"$group": {"_id": "$p_brand", "sizes": {"$addToSet": "$p_size"}}}, {"$lookup": {"from": "nation", "localField": "sizes", "foreignField": "n_nationkey", "as": "n"}},
    {"$project": {"_id": 1, "n": {"$size": "$n"}, "first": {"$min": "$n.n_name"}}},
], """
    SELECT p_brand AS _id, CAST(count(DISTINCT n_nationkey) AS INTEGER) AS n, min(n_name) AS first FROM part LEFT JOIN nation ON p_size = n_nationkey GROUP BY 1""")  # fmt: skip

_add("graph_after_group", """
    WITH RECURSIVE g AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
    w AS (SELECT k, k AS node, 0 AS d FROM g UNION ALL SELECT k, CAST(floor(node / 2) AS INTEGER), d + 1 FROM w WHERE node > 0)
    SELECT k AS _id, any_value(g.n) AS n, CAST(count(DISTINCT node) AS INTEGER) AS up, CAST(max(d) AS BIGINT) AS deepest FROM w JOIN g USING (k) GROUP BY 1""",
    lambda t: api.aggregate(t["customer"], [
        {"$group": {"_id": "$c_nationkey", "n": {"$sum": 1}, "all": {"$push": "$c_custkey"}}},
        {"$graphLookup": {"from": "edges", "startWith": "$_id", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "up", "depthField": "d"}},
        {"$project": {"_id": 1, "n": 1, "up": {"$size": "$up"}, "deepest": {"$max": "$up.d"}}},
    ], {"edges": t["nation"].withColumn("parent", F.expr("case when n_nationkey > 0 then cast(n_nationkey div 2 as int) end"))}))

_pipe("lookup_outer_flat", "customer", [
    {"$lookup": {"from": "supplier", "localField": "c_custkey", "foreignField": "s_suppkey", "as": "s"}}, {"$unwind": {"path": "$s", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 0, "c_custkey": 1, "name": "$s.s_name"}},
], "SELECT c_custkey, s_name AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")

_pipe("lookup_nested", "region", [
    {"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "as": "n", "pipeline": [
        {"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}},
        {"$lookup": {"from": "supplier", "let": {"n": "$n_nationkey"}, "as": "s", "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$n"]}, {"$gte": ["$s_nationkey", "$$r"]}]}}}, {"$count": "n"}]}},
        {"$project": {"n": {"$ifNull": [{"$arrayElemAt": ["$s.n", 0]}, 0]}}}]}},
    {"$project": {"_id": 0, "r_regionkey": 1, "nations": {"$size": "$n"}, "suppliers": {"$sum": "$n.n"}}},
], """
    SELECT r_regionkey, CAST(count(DISTINCT n_nationkey) AS INTEGER) AS nations, count(s_suppkey) AS suppliers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey >= r_regionkey GROUP BY 1""")  # fmt: skip

# sets of rows

_pipe("union_distinct", "customer", [
    {"$project": {"_id": 0, "k": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"_id": 0, "k": "$s_nationkey"}}]}}, {"$group": {"_id": "$k"}},
], "SELECT c_nationkey AS _id FROM customer UNION SELECT s_nationkey FROM supplier")

_add("set_operations", """
    SELECT 'intersect' AS op, k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY 1, 2
    UNION ALL SELECT 'except', k, count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY 1, 2
    UNION ALL SELECT 'both', k, count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) GROUP BY 1, 2
    UNION ALL SELECT 'only', k, count(*) FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) GROUP BY 1, 2""",
    lambda t: _set_operations(t))


def _set_operations(t: Tables) -> DataFrame:
    c, s = t["customer"].select(F.col("c_nationkey").cast("long").alias("k")), t["supplier"].select(F.col("s_nationkey").cast("long").alias("k"))
    found = {"intersect": api.intersect(c, s, all=True), "except": api.difference(c, s, all=True), "both": api.intersect(c, s), "only": api.difference(t["supplier"].select(F.col("s_suppkey").alias("k")), c)}
    out = None
    for name, df in found.items():
        one = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "k", "n")
        out = one if out is None else out.union(one)
    return out


# windows

_W = {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1, "o_orderkey": 1}}
_LAST3 = {"documents": [-2, 0]}
_pipe("window_ranks", "orders", [
    {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderpriority": 1}, "output": {"rank": {"$rank": {}}, "dense": {"$denseRank": {}}}}},
    {"$setWindowFields": _W | {"output": {
        "min": {"$min": "$o_totalprice", "window": _LAST3}, "first": {"$first": "$o_orderkey", "window": _LAST3}, "last": {"$last": "$o_orderkey", "window": {"documents": [0, 1]}}, "push": {"$push": "$o_totalprice", "window": _LAST3},
        "set": {"$addToSet": "$o_orderstatus", "window": _LAST3}, "sp": {"$stdDevPop": "$o_totalprice", "window": _LAST3}, "ss": {"$stdDevSamp": "$o_totalprice", "window": _LAST3}, "cov": {"$covarianceSamp": ["$o_totalprice", "$o_orderkey"]}}}},
    {"$project": {"_id": 0, "o_orderkey": 1, "rank": 1, "dense": 1, "min": 1, "first": 1, "last": 1, "push": _r({"$sum": "$push"}, 2), "set": {"$size": "$set"}, "sp": _r("$sp", 3), "ss": _r("$ss", 3), "cov": _r({"$divide": ["$cov", 1000000]}, 3)}},
], """
    SELECT o_orderkey, CAST(rank() OVER p AS INTEGER) AS rank, CAST(dense_rank() OVER p AS INTEGER) AS dense, min(o_totalprice) OVER l AS min, first_value(o_orderkey) OVER l AS first, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS last,
           round(sum(o_totalprice) OVER l, 2) AS push, CAST(len(list_distinct(list(o_orderstatus) OVER l)) AS INTEGER) AS set, round(stddev_pop(o_totalprice) OVER l, 3) AS sp, round(stddev_samp(o_totalprice) OVER l, 3) AS ss,
           round(covar_samp(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey) / 1000000, 3) AS cov
    FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), l AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)""")  # fmt: skip

_BEST = {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}
_pipe("window_n", "orders", [
    {"$setWindowFields": _W | {"output": {
        "f2": {"$firstN": {"n": 2, "input": "$o_orderkey"}, "window": _LAST3}, "l2": {"$lastN": {"n": 2, "input": "$o_orderkey"}, "window": _LAST3}, "mn": {"$minN": {"n": 2, "input": "$o_totalprice"}, "window": _LAST3},
        "mx": {"$maxN": {"n": 2, "input": "$o_totalprice"}, "window": _LAST3}, "top": {"$top": _BEST, "window": _LAST3}, "bot": {"$bottom": _BEST, "window": _LAST3}, "top2": {"$topN": {"n": 2} | _BEST, "window": _LAST3},
        "bot2": {"$bottomN": {"n": 2} | _BEST, "window": _LAST3}, "med": {"$median": {"input": "$o_totalprice", "method": "approximate"}, "window": _LAST3}, "pct": {"$percentile": {"input": "$o_totalprice", "p": [0.9], "method": "approximate"}, "window": _LAST3}}}},
    {"$project": {"_id": 0, "o_orderkey": 1, "f2": {"$last": "$f2"}, "l2": {"$first": "$l2"}, "mn": {"$last": "$mn"}, "mx": {"$last": "$mx"}, "top": 1, "bot": 1, "top2": {"$last": "$top2"}, "bot2": {"$first": "$bot2"}, "med": 1, "pct": {"$first": "$pct"}}},
], """
    WITH x AS (SELECT o_orderkey, list(o_orderkey) OVER l AS k, list_sort(list(o_totalprice) OVER l) AS p, list_sort(list((-o_totalprice, o_orderkey)) OVER l) AS b
               FROM orders WINDOW l AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING))
    SELECT o_orderkey, k[least(2, len(k))] AS f2, k[greatest(len(k) - 1, 1)] AS l2, p[least(2, len(p))] AS mn, p[greatest(len(p) - 1, 1)] AS mx, b[1][2] AS top, b[-1][2] AS bot, b[least(2, len(b))][2] AS top2, b[greatest(len(b) - 1, 1)][2] AS bot2,
           p[CAST(ceil(0.5 * len(p)) AS INTEGER)] AS med, p[CAST(ceil(0.9 * len(p)) AS INTEGER)] AS pct FROM x""")  # fmt: skip

_pipe("window_time_units", "events", [
    {"$match": {"event_type": {"$in": ["click", "purchase"]}}},
    {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {
        "rate": {"$derivative": {"input": "$value", "unit": "hour"}, "window": {"documents": [-1, 0]}}, "area": {"$integral": {"input": "$value", "unit": "hour"}, "window": {"documents": ["unbounded", "current"]}}}}},
    {"$project": {"_id": 0, "event_id": 1, "rate": _r("$rate", 2), "area": _r("$area", 2)}},
], """
    WITH e AS (SELECT event_id, user_id, ts, (epoch_us(ts) // 1000) / 3600000.0 AS h, value FROM events WHERE event_type IN ('click', 'purchase')),
    d AS (SELECT *, lag(h) OVER w AS ph, lag(value) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT event_id, round((value - pv) / (h - ph), 2) AS rate, round(sum(coalesce((h - ph) * (value + pv) / 2, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS area FROM d""")  # fmt: skip

_pipe("window_moving_average", "events", [
    {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"ema": {"$expMovingAvg": {"input": "$value", "N": 6}}, "alpha": {"$expMovingAvg": {"input": "$value", "alpha": 0.3771234567}}}}},
    {"$project": {"_id": 0, "event_id": 1, "ema": _r("$ema", 4), "alpha": _r("$alpha", 4)}},
], """
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    r AS (SELECT event_id, user_id, i, value AS a, value AS b FROM e WHERE i = 1
          UNION ALL SELECT e.event_id, e.user_id, e.i, e.value * (2 / 7) + r.a * (1 - 2 / 7), e.value * 0.3771234567::DOUBLE + r.b * (1 - 0.3771234567::DOUBLE) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT event_id, round(a, 4) AS ema, round(b, 4) AS alpha FROM r""")  # fmt: skip

_pipe("linear_fill", "events", [
    {"$set": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}},
    {"$fill": {"partitionBy": "$event_type", "sortBy": {"event_id": 1}, "output": {"v": {"method": "linear"}}}}, {"$project": {"_id": 0, "event_id": 1, "v": _r({"$multiply": ["$v", 1.234567890123]}, 6)}},
], """
    WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v, CASE WHEN event_id % 3 = 0 THEN event_id END AS k FROM events),
    w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(k IGNORE NULLS) OVER p AS k0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(k IGNORE NULLS) OVER f AS k1 FROM e
          WINDOW p AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (event_id - k0) / (k1 - k0)) * 1.234567890123::DOUBLE, 6) AS v FROM w""")  # fmt: skip

# writes


def _update_arrays(t: Tables) -> DataFrame:
    """Every array operator, and the three positional forms."""
    df = t["part"].selectExpr(
        "p_partkey AS _id", "array(p_size % 5, p_size % 3, 7) AS a", "array(p_size % 4, 9) AS b", "array(1, 2, p_size % 3) AS c", "array(1, 2, 3) AS p", "array(p_size % 2, 2, 5) AS e", "array(1, p_size) AS z",
        "array(named_struct('k', 1, 'v', p_size), named_struct('k', 2, 'v', p_size + 1)) AS d",
    )
    df = update(df, {}, {
        "$push": {"a": {"$each": [4, 1], "$sort": 1, "$slice": 4}}, "$addToSet": {"b": {"$each": [5, 9]}}, "$pop": {"p": -1}, "$pull": {"e": {"$gt": 1}}, "$pullAll": {"c": [1, 2]},
        "$inc": {"d.$[x].v": 1000}, "$mul": {"z.$[]": 2},
    }, array_filters=[{"x.k": 2}])
    df = update(df, {"d": {"$elemMatch": {"k": 1, "v": {"$gt": 20}}}}, {"$inc": {"d.$.v": 100}})
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    return df.select("_id", F.col("a")[1].alias("a"), total("b").alias("b"), total("p").alias("p"), total("e").alias("e"), F.size("c").alias("c"), F.col("d")[0]["v"].alias("d1"), F.col("d")[1]["v"].alias("d2"), total("z").alias("z"))


_add("update_arrays", """
    SELECT p_partkey AS _id, list_sort([p_size % 5, p_size % 3, 7, 4, 1])[2] AS a, p_size % 4 + 14 AS b, 5 AS p, p_size % 2 AS e, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN p_size > 20 THEN p_size + 100 ELSE p_size END AS d1,
           p_size + 1001 AS d2, 2 + 2 * p_size AS z FROM part""", _update_arrays)  # fmt: skip


def _update_fields(t: Tables) -> DataFrame:
    """Field operators, then a replacement, then an upsert."""
    df = t["customer"].selectExpr("c_custkey AS _id", "c_name AS name", "c_nationkey AS n", "c_nationkey AS m", "c_nationkey AS x", "c_nationkey AS b", "c_acctbal AS gone", "c_mktsegment AS seg")
    df = update(df, {"n": {"$lt": 20}}, {"$mul": {"m": 3}, "$max": {"x": 12}, "$bit": {"b": {"or": 8, "and": 13}}, "$unset": {"gone": ""}, "$rename": {"seg": "segment"}, "$currentDate": {"at": True}, "$setOnInsert": {"n": -1}})
    df = update(df, {"n": 24}, {"name": "replaced", "n": 1000})
    df = update(df, {"_id": -7}, {"$set": {"name": "new"}, "$setOnInsert": {"n": -7}}, upsert=True)
    return df.select("_id", "name", "n", "m", "x", "b", F.col("gone").isNull().alias("gone"), "segment", "seg", F.col("at").isNotNull().alias("dated"))


_add("update_fields", """
    SELECT c_custkey AS _id, CASE WHEN c_nationkey = 24 THEN 'replaced' ELSE c_name END AS name, CASE WHEN c_nationkey = 24 THEN 1000 ELSE c_nationkey END AS n,
           CASE WHEN c_nationkey < 20 THEN 3 * c_nationkey WHEN c_nationkey < 24 THEN c_nationkey END AS m, CASE WHEN c_nationkey < 20 THEN greatest(c_nationkey, 12) WHEN c_nationkey < 24 THEN c_nationkey END AS x,
           CASE WHEN c_nationkey < 20 THEN (c_nationkey | 8) & 13 WHEN c_nationkey < 24 THEN c_nationkey END AS b, c_nationkey < 20 OR c_nationkey = 24 AS gone, CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS segment,
           CASE WHEN c_nationkey BETWEEN 20 AND 23 THEN c_mktsegment END AS seg, c_nationkey < 20 AS dated FROM customer
    UNION ALL SELECT -7, 'new', -7, NULL, NULL, NULL, true, NULL, NULL, false""", _update_fields)  # fmt: skip


def _database(t: Tables) -> DataFrame:
    """Every write of a database in turn, read back through a view."""
    db = api.Database(t.spark, _scratch(t, "database"))
    db.insert("c", t["customer"].selectExpr("c_custkey AS _id", "c_nationkey AS n", "c_acctbal AS bal", "c_mktsegment AS seg"))
    db.update("c", {"n": {"$lt": 10}}, {"$inc": {"bal": 100.0}})
    db.delete("c", {"seg": "MACHINERY"})
    before = db.find_and_modify("c", {"n": {"$gte": 10}}, {"$set": {"seg": "FIRST"}}, sort={"_id": 1})
    assert before["seg"] != "FIRST"
    db.bulk_write("c", [{"insertOne": {"document": {"_id": -1, "n": 1, "bal": 1.0, "seg": "NEW"}}}, {"updateMany": {"filter": {"n": 3}, "update": {"$set": {"seg": "THREE"}}}}, {"deleteOne": {"filter": {"n": 4}}}, {"insertOne": {"document": {"_id": -1}}}], ordered=False)
    db.aggregate("c", [{"$match": {"n": {"$lt": 20}}}, {"$out": "kept"}])
    db.aggregate("c", [{"$match": {"n": {"$gte": 18}}}, {"$set": {"seg": "MERGED"}}, {"$merge": {"into": "kept", "whenMatched": "merge", "whenNotMatched": "insert"}}])
    db.store.drop("c")
    db.create_view("v", "kept", [{"$match": {"bal": {"$gte": 0}}}])
    return db["v"].select("_id", "n", F.round("bal", 2).alias("bal"), "seg")


_add("database_writes", """
    WITH a AS (SELECT c_custkey AS _id, c_nationkey AS n, CASE WHEN c_nationkey < 10 THEN c_acctbal + 100 ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    b AS (SELECT _id, n, bal, CASE WHEN _id = (SELECT min(_id) FROM a WHERE n >= 10) THEN 'FIRST' WHEN n = 3 THEN 'THREE' ELSE seg END AS seg FROM a WHERE _id <> (SELECT min(_id) FROM a WHERE n = 4)
          UNION ALL SELECT -1, 1, 1.0, 'NEW')
    SELECT _id, n, round(bal, 2) AS bal, CASE WHEN n >= 18 THEN 'MERGED' ELSE seg END AS seg FROM b WHERE bal >= 0""", _database)  # fmt: skip


def _merge_modes(t: Tables) -> DataFrame:
    """Each pair of modes of a merge, from even customers into those of small nations."""
    store = Store(t.spark, _scratch(t, "merge"))
    c = t["customer"].selectExpr("c_custkey AS _id", "c_nationkey AS n", "c_acctbal AS bal")
    out = None
    for mode in ({}, {"whenMatched": "replace"}, {"whenMatched": "keepExisting", "whenNotMatched": "discard"}, {"whenMatched": [{"$set": {"bal": {"$add": ["$bal", "$$new.bal"]}}}]}):
        store.save("t", c.filter("n < 10"))
        store.merge(c.filter("_id % 2 = 0").select("_id", (F.col("bal") * 2).alias("bal")), {"into": "t", **mode})
        done = store["t"].selectExpr("count(*) AS rows", "round(sum(bal), 2) AS bal", "count(n) AS named")
        one = done.select(F.lit(str(sorted(mode))).alias("mode"), F.lit("pipeline" if isinstance(mode.get("whenMatched"), list) else mode.get("whenMatched", "merge")).alias("how"), "*").drop("mode")
        one = Pipeline(t.spark).checkpoint(one)
        out = one if out is None else out.union(one)
    return out


_add("merge_modes", """
    WITH c AS (SELECT c_custkey AS id, c_nationkey < 10 AS t, c_custkey % 2 = 0 AS s, c_acctbal AS b FROM customer WHERE c_nationkey < 10 OR c_custkey % 2 = 0)
    SELECT 'merge' AS how, count(*) AS rows, round(sum(CASE WHEN s THEN 2 * b ELSE b END), 2) AS bal, count(*) FILTER (t) AS named FROM c
    UNION ALL SELECT 'replace', count(*), round(sum(CASE WHEN s THEN 2 * b ELSE b END), 2), count(*) FILTER (t AND NOT s) FROM c
    UNION ALL SELECT 'keepExisting', count(*), round(sum(b), 2), count(*) FROM c WHERE t
    UNION ALL SELECT 'pipeline', count(*), round(sum(CASE WHEN s AND t THEN 3 * b WHEN s THEN 2 * b ELSE b END), 2), count(*) FILTER (t) FROM c""", _merge_modes)  # fmt: skip


# versions


def _versions(t: Tables) -> DataFrame:
    """A history with branches, tags, a merge, a revert, a cherry-pick, a rebase and a reset; rows of several revisions."""
    repo = Repository(t.spark, _scratch(t, "repository"))
    c = t["customer"].selectExpr("c_custkey AS _id", "c_nationkey AS n", "c_acctbal AS bal")
    repo.commit({"c": c}, "base")
    repo.tag("v1", "HEAD")
    repo.branch("dev")
    repo.checkout("dev")
    repo.commit({"c": update(c, {"n": {"$lt": 5}}, {"$set": {"bal": 0.0}})}, "poor")
    repo.commit({"c": update(repo.read("c"), {"n": {"$gt": 20}}, {"$set": {"bal": 1.0}})}, "one")
    repo.checkout("main")
    repo.commit({"c": repo.read("c").filter("n <> 10")}, "without ten")
    out = {"tag": repo.read("c", "v1"), "dev~1": repo.read("c", "dev~1")}
    repo.branch("pick")
    repo.branch("base")
    repo.merge("dev")
    out["merged"] = repo.read("c")
    repo.checkout("pick")
    repo.cherry_pick("dev")
    out["picked"] = repo.read("c")
    repo.revert("HEAD")
    out["reverted"] = repo.read("c")
    repo.reset("main~1")
    repo.checkout("dev")
    repo.rebase("base")
    out["rebased"] = repo.read("c")
    kept = {name: Pipeline(t.spark).checkpoint(df) for name, df in out.items()}  # gc deletes what no branch reaches
    assert repo.branch_status("dev", "base") == (2, 0) and len(repo.log("dev")) == 4 and repo.gc()
    rows = None
    for name, df in kept.items():
        one = df.selectExpr(f"'{name}' AS rev", "n", "bal").groupBy("rev", "n").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("bal"), 2).alias("bal"))
        rows = one if rows is None else rows.union(one)
    return rows


_add("version_history", """
    WITH r AS (
        SELECT 'tag' AS rev, c_nationkey AS n, c_acctbal AS bal FROM customer
        UNION ALL SELECT 'dev~1', c_nationkey, CASE WHEN c_nationkey < 5 THEN 0 ELSE c_acctbal END FROM customer
        UNION ALL SELECT v, c_nationkey, CASE WHEN c_nationkey < 5 THEN 0 WHEN c_nationkey > 20 THEN 1 ELSE c_acctbal END FROM customer, (VALUES ('merged'), ('rebased')) x(v) WHERE c_nationkey <> 10
        UNION ALL SELECT 'picked', c_nationkey, CASE WHEN c_nationkey > 20 THEN 1 ELSE c_acctbal END FROM customer WHERE c_nationkey <> 10
        UNION ALL SELECT 'reverted', c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 10)
    SELECT rev, n, count(*) AS rows, round(sum(bal), 2) AS bal FROM r GROUP BY 1, 2""", _versions)  # fmt: skip

_add("version_diff_kinds", """
    SELECT c_custkey AS _id, CASE WHEN c_nationkey = 3 THEN 'removed' WHEN c_nationkey = 4 THEN 'added' ELSE 'modified' END AS change, CAST(CASE WHEN c_nationkey = 5 THEN 2 ELSE 3 END AS INTEGER) AS fields FROM customer WHERE c_nationkey IN (3, 4, 5)""",
    lambda t: _diff_kinds(t))


def _diff_kinds(t: Tables) -> DataFrame:
    from .sources.versioning import diff

    c = t["customer"].selectExpr("c_custkey AS _id", "c_nationkey AS n", "named_struct('bal', c_acctbal, 'seg', c_mktsegment) AS o")
    changed = c.filter("n <> 3").withColumn("o", F.expr("if(n = 5, named_struct('bal', o.bal + 1, 'seg', concat(o.seg, '!')), o)"))
    return diff(c.filter("n <> 4"), changed).select("_id", "change", F.greatest(F.coalesce(F.size("changed"), F.lit(0)), F.lit(0)).alias("fields"))


# streams


def _stream_apply(t: Tables) -> DataFrame:
    """Change events that arrive as a stream in two parts, the older ones last."""
    root = _scratch(t, "stream")
    c = t["customer"].selectExpr("c_custkey AS _id", "c_name AS s", "c_nationkey AS n")
    store = Store(t.spark, f"{root}/db")
    store.save("c", c)
    one = "named_struct('s', cast(null as string), 'n', n + 100)"
    new = c.selectExpr("'u' AS op", "5L AS ts", "_id", f"{one} AS o").union(c.filter("n < 5").selectExpr("'d'", "6L", "_id", f"if(true, null, {one})"))
    old = c.selectExpr("'u' AS op", "1L AS ts", "_id", "named_struct('s', 'old', 'n', -1) AS o").union(c.filter("n = 7").selectExpr("'i'", "7L", "-1 - _id", "named_struct('s', 'new', 'n', n)"))
    schema = new.schema
    for part in (new, old):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        apply_stream(follow(t.spark, f"{root}/in", schema), store, "c", f"{root}/offsets").awaitTermination()
    return store["c"]


_add("stream_changes", """
    SELECT c_custkey AS _id, 'old' AS s, c_nationkey + 100 AS n FROM customer WHERE c_nationkey >= 5
    UNION ALL SELECT -1 - c_custkey, 'new', c_nationkey FROM customer WHERE c_nationkey = 7""", _stream_apply)  # fmt: skip


def _streamed(t: Tables, build) -> DataFrame:
    """What a stream over the events table has put out when all of it is read."""
    root = _scratch(t, "stream")
    t["events"].write.parquet(f"{root}/in")
    stream = build(follow(t.spark, f"{root}/in", t["events"].schema))
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


_add("stream_windows_late", """
    WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)
    SELECT strftime(d, '%Y-%m-%d') AS d, event_type, n, v FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    lambda t: _streamed(t, lambda s: windowed(s, "ts", "1 day", ["event_type"], late="1 day", n=F.count(F.lit(1)), v=F.round(F.sum("value"), 2))).select(F.date_format("start", "yyyy-MM-dd").alias("d"), "event_type", "n", "v"))

_add("stream_sessions_late", """
    WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    lambda t: _streamed(t, lambda s: sessions(s, "ts", "12 hours", ["user_id"], late="1 hour", n=F.count(F.lit(1)))).select("user_id", "n"))


def _initial_sync(t: Tables) -> DataFrame:
    """A copy that has seen half of the events, caught up from before its beginning."""
    store = Store(t.spark, _scratch(t, "sync"))
    c = t["customer"].selectExpr("c_custkey AS _id", "c_name AS s", "c_nationkey AS n")
    events = c.selectExpr("'u' AS op", "cast(n AS bigint) AS ts", "_id", "named_struct('s', cast(null AS string), 'n', n + 50) AS o")
    copied = c.withColumn("n", F.expr("if(n < 12, n + 50, n)"))
    initial_sync(store, "c", copied, events, since=8)
    return store["c"]


_add("initial_sync", "SELECT c_custkey AS _id, c_name AS s, c_nationkey + 50 AS n FROM customer", _initial_sync)
