"""Registered queries over the driver's tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators.updates import delete, update
from .sources.store import merge
from .sources.versioning import diff, resolve, three_way
from .streaming.cdc import apply_events, sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables(Mapping):
    """The Parquet tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0


def _add(name: str, sql: str | None, build: Callable[[Tables], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(Tables(spark, sf_dir))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _pipe(name: str, table: str, stages: list[dict[str, Any]], sql: str | None) -> None:
    _add(name, sql, lambda t: api.aggregate(t[table], stages, t))


def _day(y: int, m: int, d: int) -> dt.datetime:
    return dt.datetime(y, m, d)


# scans, filters, groups

_price = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}
_r2 = lambda e: {"$round": [e, 2]}

PRICING = [
    {"$match": {"l_shipdate": {"$lte": _day(1998, 9, 2)}}},
    {"$group": {
        "_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_base": {"$sum": "$l_extendedprice"},
        "sum_disc": {"$sum": _price}, "sum_charge": {"$sum": {"$multiply": [_price, {"$add": [1, "$l_tax"]}]}},
        "avg_qty": {"$avg": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$sum": 1},
    }},
    {"$sort": {"_id": 1}},
    {"$project": {
        "_id": 0, "flag": "$_id.flag", "status": "$_id.status", "n": 1, "sum_qty": _r2("$sum_qty"), "sum_base": _r2("$sum_base"),
        "sum_disc": _r2("$sum_disc"), "sum_charge": _r2("$sum_charge"), "avg_qty": {"$round": ["$avg_qty", 6]},
        "avg_price": {"$round": ["$avg_price", 4]}, "avg_disc": {"$round": ["$avg_disc", 6]},
    }},
]
_pipe("q1_pricing", "lineitem", PRICING, """
    SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")

_add("find_filters", """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_totalprice >= 50000 AND o_orderstatus IN ('F', 'O') AND (o_custkey % 3 = 1 OR regexp_matches(o_orderpriority, '^[12]-'))
      AND NOT (o_orderdate < TIMESTAMP '1993-01-01') AND o_orderpriority <> '5-LOW'""",
    lambda t: api.find(t["orders"], {
        "o_totalprice": {"$gte": 50000}, "o_orderstatus": {"$in": ["F", "O"]}, "o_orderpriority": {"$ne": "5-LOW"},
        "$or": [{"o_custkey": {"$mod": [3, 1]}}, {"o_orderpriority": {"$regex": "^[12]-"}}], "o_orderdate": {"$not": {"$lt": _day(1993, 1, 1)}},
    }, {"o_orderkey": 1, "o_custkey": 1}))

_add("find_sort_skip_limit", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5""",
    lambda t: api.find(t["orders"], {}, {"o_orderkey": 1, "o_totalprice": 1}, sort={"o_totalprice": -1, "o_orderkey": 1}, skip=5, limit=20))

_add("find_bounds", """
    SELECT o_orderkey FROM orders WHERE (o_custkey > 10 OR (o_custkey = 10 AND o_orderkey >= 100)) AND (o_custkey < 50 OR (o_custkey = 50 AND o_orderkey < 10))""",
    lambda t: api.find(t["orders"], {}, {"o_orderkey": 1}, min={"o_custkey": 10, "o_orderkey": 100}, max={"o_custkey": 50, "o_orderkey": 10}))

_add("filter_bits_type_expr", """
    SELECT p_partkey FROM part WHERE (p_size & 5) = 5 AND p_retailprice > p_size * 20.0 AND p_name IS NOT NULL""",
    lambda t: api.find(t["part"], {"p_size": {"$bitsAllSet": 5, "$type": "int"}, "p_name": {"$exists": True}, "$expr": {"$gt": ["$p_retailprice", {"$multiply": ["$p_size", 20.0]}]}}, {"p_partkey": 1}))

_add("filter_json_schema", """
    SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND regexp_matches(p_brand, '1') AND length(p_name) <= 12""",
    lambda t: api.find(t["part"], {"$jsonSchema": {"required": ["p_name"], "properties": {
        "p_size": {"bsonType": "int", "minimum": 10, "maximum": 20}, "p_brand": {"pattern": "1"}, "p_name": {"maxLength": 12}}}}, {"p_partkey": 1}))

_add("filter_text", """
    SELECT p_partkey FROM part
    WHERE regexp_matches(concat_ws(chr(10), p_name, p_brand, p_type), '(?i)(^|[^\\p{L}\\p{N}_])(small|ring)($|[^\\p{L}\\p{N}_])')
      AND NOT regexp_matches(concat_ws(chr(10), p_name, p_brand, p_type), '(?i)(^|[^\\p{L}\\p{N}_])economy($|[^\\p{L}\\p{N}_])')""",
    lambda t: api.find(t["part"], {"$text": {"$search": "small ring -economy"}}, {"p_partkey": 1}))

_add("distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 1000",
     lambda t: api.distinct(t["orders"], "o_orderpriority", {"o_totalprice": {"$gt": 1000}}))

_pipe("count_stage", "lineitem", [{"$match": {"l_quantity": {"$gt": 25}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
_pipe("sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "SELECT o_orderpriority AS _id, count(*) AS count FROM orders GROUP BY 1")

_pipe("group_accumulators", "orders", [
    {"$sort": {"o_orderdate": 1, "o_orderkey": 1}},
    {"$group": {
        "_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}, "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"},
        "sd": {"$stdDevSamp": "$o_totalprice"}, "sp": {"$stdDevPop": "$o_totalprice"}, "n": {"$count": {}}, "kinds": {"$addToSet": "$o_orderpriority"},
        "med": {"$median": {"input": "$o_totalprice", "method": "approximate"}}, "p90": {"$percentile": {"input": "$o_totalprice", "p": [0.9], "method": "approximate"}},
        "top": {"$top": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "low3": {"$minN": {"n": 3, "input": "$o_totalprice"}},
        "first2": {"$firstN": {"n": 2, "input": "$o_orderkey"}}, "best2": {"$topN": {"n": 2, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}},
    }},
    {"$project": {"_id": 1, "first": 1, "last": 1, "lo": 1, "hi": 1, "n": 1, "top": 1, "sd": {"$round": ["$sd", 3]}, "sp": {"$round": ["$sp", 3]},
                  "kinds": {"$size": "$kinds"}, "med": 1, "p90": {"$first": "$p90"}, "low3": {"$arrayElemAt": ["$low3", 2]}, "first2": {"$last": "$first2"}, "best2": {"$last": "$best2"}}},
], """
    SELECT o_orderstatus AS _id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
           round(stddev_samp(o_totalprice), 3) AS sd, round(stddev_pop(o_totalprice), 3) AS sp, count(*) AS n, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS kinds,
           quantile_disc(o_totalprice, 0.5) AS med, quantile_disc(o_totalprice, 0.9) AS p90, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS top,
           list_sort(list(o_totalprice))[3] AS low3, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[2] AS first2, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[2] AS best2
    FROM orders GROUP BY 1""")  # fmt: skip

_pipe("bucket_price", "orders", [
    {"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 50000, 100000, 200000], "default": -1, "output": {"n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}},
], """
    SELECT CASE WHEN o_totalprice < 0 OR o_totalprice >= 200000 THEN -1 WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 50000 ELSE 100000 END AS _id,
           count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1""")  # fmt: skip

_pipe("bucket_auto", "part", [
    {"$bucketAuto": {"groupBy": "$p_partkey", "buckets": 5}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "count": 1}},
], """
    WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS c FROM part),
    b AS (SELECT p_partkey, least(i // CAST(round(c / 5) AS BIGINT), 4) AS b FROM r),
    g AS (SELECT b, min(p_partkey) AS lo, max(p_partkey) AS top, count(*) AS count FROM b GROUP BY b)
    SELECT lo, coalesce(lead(lo) OVER (ORDER BY b), top) AS hi, count FROM g""")  # fmt: skip

_pipe("facet_part", "part", [
    {"$facet": {"brands": [{"$sortByCount": "$p_brand"}, {"$limit": 1}], "total": [{"$count": "n"}], "big": [{"$match": {"p_size": {"$gt": 40}}}, {"$count": "n"}]}},
    {"$project": {"brand_n": {"$let": {"vars": {"b": {"$first": "$brands"}}, "in": "$$b.count"}}, "total": {"$let": {"vars": {"b": {"$first": "$total"}}, "in": "$$b.n"}},
                  "big": {"$let": {"vars": {"b": {"$first": "$big"}}, "in": "$$b.n"}}}},
], """
    SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS brand_n, count(*) AS total, count(*) FILTER (p_size > 40) AS big FROM part""")  # fmt: skip

# joins

_pipe("lookup_unwind", "nation", [
    {"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"},
    {"$project": {"n_name": 1, "region": "$r.r_name"}},
], "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")

_pipe("lookup_array", "customer", [
    {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
    {"$project": {"c_custkey": 1, "n": {"$size": "$o"}, "spent": {"$round": [{"$sum": "$o.o_totalprice"}, 2]}}},
], """
    SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")  # fmt: skip

_pipe("lookup_semi", "customer", [
    {"$lookup": {"from": "supplier", "localField": "c_custkey", "foreignField": "s_suppkey", "as": "s"}}, {"$match": {"s": {"$ne": []}}}, {"$unset": "s"}, {"$project": {"c_custkey": 1}},
], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")

_pipe("lookup_anti", "customer", [
    {"$lookup": {"from": "supplier", "localField": "c_custkey", "foreignField": "s_suppkey", "as": "s"}}, {"$match": {"s": {"$size": 0}}}, {"$unset": "s"}, {"$project": {"c_custkey": 1}},
], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")

_pipe("lookup_pipeline_top", "customer", [
    {"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "as": "top", "pipeline": [
        {"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}, "o_orderstatus": "F"}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}]}},
    {"$unwind": "$top"}, {"$project": {"c_custkey": 1, "o_orderkey": "$top.o_orderkey"}},
], """
    SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F') WHERE r <= 2""")  # fmt: skip

_pipe("lookup_pipeline_range", "supplier", [
    {"$lookup": {"from": "nation", "let": {"n": "$s_nationkey"}, "as": "before", "pipeline": [{"$match": {"$expr": {"$lt": ["$n_nationkey", "$$n"]}}}, {"$count": "n"}]}},
    {"$project": {"s_suppkey": 1, "n": {"$ifNull": [{"$arrayElemAt": ["$before.n", 0]}, 0]}}},
], "SELECT s_suppkey, (SELECT count(*) FROM nation WHERE n_nationkey < s_nationkey) AS n FROM supplier")

_add("graph_lookup_chain", """
    WITH RECURSIVE w AS (SELECT n_nationkey AS k, n_nationkey AS node, 0 AS d FROM nation UNION ALL SELECT k, CAST(floor(node / 2) AS INTEGER), d + 1 FROM w WHERE node > 0 AND d < 6)
    SELECT k AS n_nationkey, CAST(count(DISTINCT node) AS INTEGER) AS n, CAST(max(d) AS BIGINT) AS deepest FROM w GROUP BY 1""",
    lambda t: api.aggregate(t["nation"].withColumn("parent", F.expr("case when n_nationkey > 0 then cast(n_nationkey div 2 as int) end")), [
        {"$graphLookup": {"from": "edges", "startWith": "$n_nationkey", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "up", "maxDepth": 6, "depthField": "d"}},
        {"$project": {"n_nationkey": 1, "n": {"$size": "$up"}, "deepest": {"$max": "$up.d"}}},
    ], {"edges": t["nation"].withColumn("parent", F.expr("case when n_nationkey > 0 then cast(n_nationkey div 2 as int) end"))}))

_pipe("union_with", "customer", [
    {"$project": {"name": "$c_name", "nation": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"name": "$s_name", "nation": "$s_nationkey"}}]}},
], "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")

# windows

_pipe("window_rank", "orders", [
    {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1, "o_orderkey": 1}, "output": {
        "rn": {"$documentNumber": {}}, "running": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}},
        "prev": {"$shift": {"output": "$o_orderkey", "by": -1, "default": -1}}, "most": {"$max": "$o_totalprice"}, "mv": {"$avg": "$o_totalprice", "window": {"documents": [-2, 0]}}}}},
    {"$project": {"o_orderkey": 1, "rn": 1, "prev": 1, "most": 1, "running": {"$round": ["$running", 2]}, "mv": {"$round": ["$mv", 4]}}},
], """
    SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, coalesce(lag(o_orderkey) OVER w, -1) AS prev, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most,
           round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS mv
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")  # fmt: skip

_pipe("window_time_range", "orders", [
    {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1}, "output": {"n": {"$count": {}, "window": {"range": [-90, "current"], "unit": "day"}}}}},
    {"$project": {"o_orderkey": 1, "n": 1}},
], """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders""")  # fmt: skip

_pipe("window_derivative_integral", "orders", [
    {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1, "o_orderkey": 1}, "output": {
        "d": {"$derivative": {"input": "$o_totalprice"}, "window": {"documents": [-1, 0]}}, "i": {"$integral": {"input": "$o_totalprice"}, "window": {"documents": ["unbounded", "current"]}},
        "cov": {"$covariancePop": ["$o_totalprice", "$o_orderkey"]}}}},
    {"$project": {"o_orderkey": 1, "d": {"$round": ["$d", 2]}, "i": {"$round": ["$i", 4]}, "cov": {"$round": ["$cov", 0]}}},
], """
    SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS d,
           round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) - (first_value(o_totalprice) OVER w + o_totalprice) / 2, 4) AS i,
           round(covar_pop(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey), 0) AS cov
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")  # fmt: skip

_pipe("locf_events", "events", [
    {"$set": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}},
    {"$fill": {"partitionBy": "$event_type", "sortBy": {"ts": 1, "event_id": 1}, "output": {"v": {"method": "locf"}}}}, {"$project": {"event_id": 1, "v": 1}},
], """
    SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events""")  # fmt: skip

_pipe("densify_daily", "events", [
    {"$match": {"event_type": "purchase"}}, {"$group": {"_id": {"u": "$user_id", "d": {"$dateTrunc": {"date": "$ts", "unit": "day"}}}, "n": {"$sum": 1}}},
    {"$project": {"_id": 0, "u": "$_id.u", "d": "$_id.d", "n": 1}}, {"$densify": {"field": "d", "partitionByFields": ["u"], "range": {"step": 1, "unit": "day", "bounds": "full"}}},
    {"$fill": {"output": {"n": {"value": 0}}}}, {"$project": {"u": 1, "n": 1, "d": {"$dateToString": {"date": "$d", "format": "%Y-%m-%d"}}}},
], """
    WITH g AS (SELECT user_id AS u, date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
    days AS (SELECT unnest(generate_series((SELECT min(d) FROM g)::TIMESTAMP, (SELECT max(d) FROM g)::TIMESTAMP, INTERVAL 1 DAY)) AS d)
    SELECT u, strftime(days.d, '%Y-%m-%d') AS d, coalesce(n, 0) AS n FROM (SELECT DISTINCT u FROM g) CROSS JOIN days LEFT JOIN g USING (u, d)""")  # fmt: skip

# expressions

_pipe("expr_dates", "orders", [
    {"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "q": {"$ceil": {"$divide": [{"$month": "$o_orderdate"}, 3]}}, "dow": {"$dayOfWeek": "$o_orderdate"}, "doy": {"$dayOfYear": "$o_orderdate"},
                  "iw": {"$isoWeek": "$o_orderdate"}, "iy": {"$isoWeekYear": "$o_orderdate"}, "text": {"$dateToString": {"date": "$o_orderdate", "format": "%d.%m.%Y %H:%M"}},
                  "month": {"$dateToString": {"date": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "format": "%Y-%m-%d"}},
                  "later": {"$dateToString": {"date": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}, "format": "%Y-%m-%d"}},
                  "months": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": _day(1999, 1, 1), "unit": "month"}}, "weeks": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": _day(1999, 1, 1), "unit": "week", "startOfWeek": "monday"}},
                  "ms": {"$subtract": [_day(1999, 1, 1), "$o_orderdate"]}}},
], """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, ceil(month(o_orderdate) / 3) AS q, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
           CAST(weekofyear(o_orderdate) AS INTEGER) AS iw, CAST(isoyear(o_orderdate) AS BIGINT) AS iy, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS text, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
           strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS months,
           CAST(date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', TIMESTAMP '1999-01-01')) / 7 AS BIGINT) AS weeks, date_diff('millisecond', o_orderdate, TIMESTAMP '1999-01-01') AS ms FROM orders""")  # fmt: skip

_pipe("expr_strings", "part", [
    {"$project": {"p_partkey": 1, "up": {"$toUpper": "$p_name"}, "n": {"$strLenCP": "$p_name"}, "sub": {"$substrCP": ["$p_name", 1, 3]}, "at": {"$indexOfCP": ["$p_name", "e"]}, "cat": {"$concat": ["$p_brand", "/", "$p_type"]},
                  "word": {"$arrayElemAt": [{"$split": ["$p_name", " "]}, 1]}, "rep": {"$replaceAll": {"input": "$p_name", "find": "l", "replacement": "_"}}, "one": {"$replaceOne": {"input": "$p_name", "find": "l", "replacement": "_"}},
                  "m": {"$regexMatch": {"input": "$p_name", "regex": "^[a-m]"}}, "t": {"$trim": {"input": {"$concat": ["  ", "$p_name", " "]}}}, "c": {"$strcasecmp": ["$p_type", "SMALL"]}, "s": {"$toString": "$p_size"}}},
], """
    SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 2, 3) AS sub, CAST(instr(p_name, 'e') - 1 AS INTEGER) AS at, p_brand || '/' || p_type AS cat, split_part(p_name, ' ', 2) AS word,
           replace(p_name, 'l', '_') AS rep, regexp_replace(p_name, 'l', '_') AS one, regexp_matches(p_name, '^[a-m]') AS m, p_name AS t,
           CASE WHEN lower(p_type) < 'small' THEN -1 WHEN lower(p_type) > 'small' THEN 1 ELSE 0 END AS c, CAST(p_size AS VARCHAR) AS s FROM part""")  # fmt: skip

_pipe("expr_arrays", "embeddings", [
    {"$project": {"vec_id": 1, "n": {"$size": "$embedding"}, "first": {"$round": [{"$toDouble": {"$first": "$embedding"}}, 5]}, "last": {"$round": [{"$toDouble": {"$arrayElemAt": ["$embedding", -1]}}, 5]},
                  "pos": {"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}},
                  "norm": {"$round": [{"$sqrt": {"$reduce": {"input": "$embedding", "initialValue": 0.0, "in": {"$add": ["$$value", {"$multiply": ["$$this", "$$this"]}]}}}}, 4]},
                  "top": {"$round": [{"$toDouble": {"$max": "$embedding"}}, 5]}, "head": {"$size": {"$slice": ["$embedding", 5]}},
                  "sum3": {"$round": [{"$sum": {"$map": {"input": {"$slice": ["$embedding", 0, 3]}, "as": "x", "in": {"$multiply": ["$$x", 2.0]}}}}, 4]}}},
], """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos,
           round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(list_max(embedding)::DOUBLE, 5) AS top, 5 AS head,
           round(list_sum(list_transform(embedding[1:3], lambda x: x::DOUBLE * 2)), 4) AS sum3 FROM embeddings""")  # fmt: skip

_pipe("expr_conditional_math", "lineitem", [
    {"$project": {"l_orderkey": 1, "l_linenumber": 1, "k": {"$switch": {"branches": [{"case": {"$lt": ["$l_quantity", 10]}, "then": "low"}, {"case": {"$lt": ["$l_quantity", 30]}, "then": "mid"}], "default": "high"}},
                  "m": {"$mod": ["$l_orderkey", 7]}, "p": {"$round": [{"$pow": ["$l_discount", 2]}, 6]}, "l": {"$round": [{"$ln": "$l_extendedprice"}, 6]}, "c": {"$cmp": ["$l_tax", "$l_discount"]},
                  "a": {"$abs": {"$subtract": ["$l_partkey", "$l_suppkey"]}}, "f": {"$floor": {"$divide": ["$l_extendedprice", 100]}}, "b": {"$and": [{"$gt": ["$l_quantity", 5]}, {"$ne": ["$l_returnflag", "R"]}]},
                  "g": {"$ifNull": [None, "$l_linestatus"]}, "s": {"$round": [{"$sin": "$l_quantity"}, 6]}}},
], """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS k, l_orderkey % 7 AS m, round(pow(l_discount, 2), 6) AS p, round(ln(l_extendedprice), 6) AS l,
           CASE WHEN l_tax < l_discount THEN -1 WHEN l_tax > l_discount THEN 1 ELSE 0 END AS c, abs(l_partkey - l_suppkey) AS a, floor(l_extendedprice / 100) AS f, l_quantity > 5 AND l_returnflag <> 'R' AS b, l_linestatus AS g,
           round(sin(l_quantity), 6) AS s FROM lineitem""")  # fmt: skip

_pipe("expr_objects_sets_types", "nation", [
    {"$project": {"n_nationkey": 1, "both": {"$size": {"$setIntersection": [{"$range": [0, 10]}, {"$range": ["$n_nationkey", 20]}]}}, "all": {"$size": {"$setUnion": [[1, 2], ["$n_regionkey"]]}},
                  "sub": {"$setIsSubset": [["$n_regionkey"], [0, 1, 2]]}, "kv": {"$size": {"$objectToArray": {"a": 1, "b": "$n_regionkey"}}}, "m": {"$getField": {"field": "b", "input": {"$mergeObjects": [{"a": 1, "b": 2}, {"b": "$n_regionkey"}]}}},
                  "t": {"$type": "$n_name"}, "i": {"$convert": {"input": {"$substrCP": ["$n_name", 7, 2]}, "to": "int", "onError": -1}}, "in": {"$in": ["$n_regionkey", [1, 3]]}, "z": {"$size": {"$zip": {"inputs": [[1, 2, 3], [4, 5]]}}}}},
], """
    SELECT n_nationkey, CAST(greatest(0, least(10, 20) - n_nationkey) AS INTEGER) AS both, CASE WHEN n_regionkey IN (1, 2) THEN 2 ELSE 3 END AS all, n_regionkey IN (0, 1, 2) AS sub, 2 AS kv, n_regionkey AS m, 'string' AS t,
           CAST(substr(n_name, 8, 2) AS INTEGER) AS i, n_regionkey IN (1, 3) AS in, 2 AS z FROM nation""")  # fmt: skip

_pipe("unwind_index", "documents", [
    {"$project": {"doc_id": 1, "lines": {"$split": ["$text", "\n"]}}}, {"$unwind": {"path": "$lines", "includeArrayIndex": "i"}}, {"$project": {"doc_id": 1, "i": 1, "n": {"$strLenCP": "$lines"}}},
], """
    SELECT doc_id, i - 1 AS i, CAST(length(l) AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")  # fmt: skip

_pipe("regex_pages", "pages", [
    {"$project": {"page_id": 1, "host": {"$let": {"vars": {"m": {"$regexFind": {"input": "$url", "regex": "https?://([^/]+)/"}}}, "in": {"$arrayElemAt": ["$$m.captures", 0]}}},
                  "links": {"$size": {"$regexFindAll": {"input": "$html", "regex": "<a href="}}}}},
], """
    SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links FROM pages""")  # fmt: skip

_add("json_props", """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""",
    lambda t: api.aggregate(t["events"].withColumn("p", F.from_json("props", "k int")), [
        {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "total": {"$sum": "$p.k"}}}, {"$project": {"_id": 0, "event_type": "$_id", "n": 1, "total": 1}}]))

_pipe("redact_replace", "nation", [
    {"$redact": {"$cond": [{"$lt": ["$n_nationkey", 10]}, "$$KEEP", "$$PRUNE"]}}, {"$replaceWith": {"k": "$n_nationkey", "in": {"region": "$n_regionkey", "name": "$n_name"}}},
    {"$set": {"in.region": {"$add": ["$in.region", 1]}}}, {"$project": {"k": 1, "r": "$in.region", "name": "$in.name"}},
], "SELECT n_nationkey AS k, CAST(n_regionkey + 1 AS BIGINT) AS r, n_name AS name FROM nation WHERE n_nationkey < 10")

_add("geo_within", """
    SELECT c_custkey FROM customer WHERE pow(c_nationkey - 10, 2) + pow(c_acctbal / 1000 - 4, 2) <= 16""",
    lambda t: api.find(t["customer"].withColumn("loc", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000)), {"loc": {"$geoWithin": {"$center": [[10, 4], 4]}}}, {"c_custkey": 1}))

_add("geo_near", """
    SELECT c_custkey, round(2 * asin(sqrt(pow(sin(radians((c_acctbal / 1000) - 4) / 2), 2) + cos(radians(c_acctbal / 1000)) * cos(radians(4)) * pow(sin(radians(c_nationkey - 10) / 2), 2))) * 6378.1, 3) AS km
    FROM customer WHERE 2 * asin(sqrt(pow(sin(radians((c_acctbal / 1000) - 4) / 2), 2) + cos(radians(c_acctbal / 1000)) * cos(radians(4)) * pow(sin(radians(c_nationkey - 10) / 2), 2))) * 6378100 <= 500000""",
    lambda t: api.aggregate(t["customer"].withColumn("loc", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000)), [
        {"$geoNear": {"near": {"type": "Point", "coordinates": [10, 4]}, "distanceField": "m", "key": "loc", "maxDistance": 500000, "spherical": True}},
        {"$project": {"c_custkey": 1, "km": {"$round": [{"$divide": ["$m", 1000]}, 3]}}}]))

# writes as transforms, versions, streams

_UPDATE = {"$inc": {"c_acctbal": 10.5}, "$set": {"c_mktsegment": "HOUSE"}, "$min": {"c_nationkey": 12}}
_add("update_ops", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 10.5, 2) ELSE round(c_acctbal, 2) END AS bal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_mktsegment = 'BUILDING' THEN least(c_nationkey, 12) ELSE c_nationkey END AS c_nationkey FROM customer""",
    lambda t: api.find(update(t["customer"], {"c_mktsegment": "BUILDING"}, _UPDATE), {}, {"c_custkey": 1, "c_mktsegment": 1, "c_nationkey": 1, "bal": {"$round": ["$c_acctbal", 2]}}))

_add("update_pipeline", """
    SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal * 2, 2) END AS twice FROM supplier""",
    lambda t: update(t["supplier"], {"s_acctbal": {"$gt": 0}}, [{"$set": {"twice": {"$round": [{"$multiply": ["$s_acctbal", 2]}, 2]}}}]).select("s_suppkey", "twice"))

_add("delete_rows", "SELECT count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)",
     lambda t: delete(t["orders"], {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}}).agg(F.count(F.lit(1)).alias("n")))

_add("merge_into", """
    SELECT n_nationkey AS _id, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'added', NULL""",
    lambda t: merge(t["nation"].withColumnRenamed("n_nationkey", "_id"), t["nation"].filter("n_nationkey < 5").select(F.col("n_nationkey").alias("_id"), F.lit("new").alias("n_name"))
                    .unionByName(t["nation"].limit(1).select(F.lit(100).alias("_id"), F.lit("added").alias("n_name"))), {"into": "nation"}))


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = t["customer"].select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal", "c_nationkey")
    ours = base.filter("_id % 11 <> 3").withColumn("c_acctbal", F.expr("case when _id % 5 = 0 then c_acctbal + 1 else c_acctbal end"))
    theirs = base.filter("_id % 13 <> 4").withColumn("c_nationkey", F.expr("case when _id % 3 = 0 then c_nationkey + 100 else c_nationkey end"))
    return base, ours, theirs


_add("diff_rows", """
    SELECT CASE WHEN c_custkey % 11 = 3 THEN 'removed' ELSE 'modified' END AS change, count(*) AS n FROM customer WHERE c_custkey % 11 = 3 OR c_custkey % 5 = 0 GROUP BY 1""",
    lambda t: diff(*_sides(t)[:2]).groupBy("change").agg(F.count(F.lit(1)).alias("n")))

_add("merge_three_way", """
    SELECT c_custkey AS _id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 11 <> 3 THEN round(c_acctbal + 1, 2) ELSE round(c_acctbal, 2) END AS bal, CASE WHEN c_custkey % 3 = 0 AND NOT c_custkey % 13 = 4 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey
    FROM customer
    WHERE NOT (c_custkey % 11 = 3 AND NOT (c_custkey % 3 = 0 AND c_custkey % 13 <> 4)) AND NOT (c_custkey % 13 = 4 AND NOT (c_custkey % 5 = 0 AND c_custkey % 11 <> 3))""",
    lambda t: _merged(t))


def _merged(t: Tables) -> DataFrame:
    """Both branches merged by field; a removed and changed row keeps its change."""
    base, ours, theirs = _sides(t)
    rows, conflicts = three_way(base, ours, theirs)
    kept = conflicts.select("_id", F.coalesce("ours", "theirs").alias("d")).select("_id", "d.*")
    return resolve(rows, conflicts, kept).select("_id", F.round("c_acctbal", 2).alias("bal"), "c_nationkey")


def _change_events(t: Tables) -> DataFrame:
    """Every customer arrives again under a new id; every old row is updated, those in debt go, and builders among these come back."""
    c = t["customer"]
    doc = F.struct("c_name", "c_acctbal")
    event = lambda rows, op, ts, _id, o: rows.select(F.lit(op).alias("op"), F.lit(ts).cast("long").alias("ts"), _id.alias("_id"), o.alias("o"))
    changed = F.struct(F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 5).alias("c_acctbal"))
    none = F.lit(None).cast(c.select(doc.alias("o")).schema["o"].dataType)
    debt, key = c.filter("c_acctbal < 0"), F.col("c_custkey")
    ins, upd, rem = event(c, "i", 1, -1 - key, doc), event(c, "u", 2, key, changed), event(debt, "d", 3, key, none)
    return ins.union(upd).union(rem).union(event(debt.filter("c_mktsegment = 'BUILDING'"), "i", 4, key, doc))


_add("cdc_apply", """
    SELECT c_custkey AS _id, c_name, round(CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE c_acctbal + 5 END, 2) AS bal FROM customer WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING'
    UNION ALL SELECT -1 - c_custkey, c_name, round(c_acctbal, 2) FROM customer""",
    lambda t: apply_events(t["customer"].select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal"), _change_events(t)).select("_id", "c_name", F.round("c_acctbal", 2).alias("bal")))

_add("stream_windows", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    lambda t: windowed(t["events"], "ts", "1 hour", ["event_type"], n=F.count(F.lit(1))).select(F.date_format("start", "yyyy-MM-dd HH").alias("h"), "event_type", "n"))

_add("stream_sessions", """
    WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s""",
    lambda t: sessions(t["events"], "ts", "12 hours", ["user_id"], n=F.count(F.lit(1))).select("user_id", "n"))

from . import more_queries  # noqa: E402, F401  (registers its queries here)
