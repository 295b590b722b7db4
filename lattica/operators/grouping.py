"""Grouping stages: group, bucket, bucketAuto, sortByCount, count, facet, densify, sample."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, ExpressionError, as_date, compare, compile_expr, literal
from ..functions.dates import MILLIS, of_unit
from .accumulators import Order, accumulate


def group(df: DataFrame, spec: dict[str, Any], order: Order | None, part: str | None = None, ctx: Ctx | None = None) -> DataFrame:
    """Partial and final hash aggregation; an empty input gives no group."""
    ctx = ctx or Ctx(df)
    key = compile_expr(spec["_id"], ctx)
    keyed = df.withColumn("_id__", key.col if key.kind != "null" else F.lit(None).cast("string"))
    inner = Ctx(keyed, ctx.vars)
    outs = [accumulate(v, inner, order).alias(k) for k, v in spec.items() if k != "_id"]
    by = [F.col("_id__"), *([F.col(part)] if part else [])]
    if not outs:
        return keyed.select(*by).distinct().withColumnRenamed("_id__", "_id")
    return keyed.groupBy(*by).agg(*outs).withColumnRenamed("_id__", "_id")


_COUNT = {"count": {"$sum": 1}}


def bucket(df: DataFrame, spec: dict[str, Any], order: Order | None) -> DataFrame:
    ctx = Ctx(df)
    bounds = spec["boundaries"]
    if len(bounds) < 2 or any(not a < b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ExpressionError("$bucket takes two or more ascending boundaries")
    e = compile_expr(spec["groupBy"], ctx)
    out: Column | None = None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        a, b = literal(lo, ctx), literal(hi, ctx)
        inside = compare(a, e, "lte") & compare(e, b, "lt")
        out = F.when(inside, a.col) if out is None else out.when(inside, a.col)
    if "default" in spec:
        out = out.otherwise(literal(spec["default"], ctx).col)
    else:
        out = out.otherwise(F.raise_error(F.lit("$bucket: a value is in no bucket and there is no default")))
    rows = df.withColumn("__bucket", out)
    done = group(rows, {"_id": "$__bucket"} | (spec.get("output") or _COUNT), order)
    return done.orderBy("_id")


def bucket_auto(df: DataFrame, spec: dict[str, Any], order: Order | None) -> DataFrame:
    """Buckets of round(n / buckets) rows; equal values stay together and the last bucket takes the rest.

    Boundaries are walked greedily over counts of distinct values: a bucket closes
    at the first value at which it holds its share. That walk needs the running
    count at each value only, so the counts are sorted and summed by ranges and the
    driver asks for one boundary at a time.
    """
    n = spec["buckets"]
    if not isinstance(n, int) or n < 1:
        raise ExpressionError("buckets must be a positive integer")
    ctx = Ctx(df)
    e = compile_expr(spec["groupBy"], ctx)
    rows = df.withColumn("__v", e.col)
    counts = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    if not total:
        return group(rows.withColumn("__b", F.struct(F.col("__v").alias("min"), F.col("__v").alias("max"))), {"_id": "$__b"} | (spec.get("output") or _COUNT), order)
    counts = running(counts, "__v", "n", "upto").cache()
    size = max(1, round(total / n))
    grain = spec.get("granularity")
    edges, done, left = [counts.agg(F.min(F.struct("__v")).alias("v")).first().v[0]], 0, n
    if grain:
        edges[0] = _granule(edges[0], grain, up=False)
    while left > 1 and done < total:
        closing = counts.filter(F.col("upto") >= done + size).agg(F.min(F.struct("upto", "__v")).alias("m")).first().m
        if closing is None or closing.upto >= total:
            break
        if grain:
            edge = _granule(closing["__v"], grain, up=True)
            under = counts.filter(F.col("__v") < F.lit(edge)).agg(F.max("upto")).first()[0]
            if under >= total:
                break
        else:
            after = counts.filter(F.col("upto") > closing.upto).agg(F.min(F.struct("upto", "__v")).alias("m")).first().m
            edge, under = after["__v"], closing.upto
        edges.append(edge)
        done, left = under, left - 1
    top = counts.agg(F.max(F.struct("__v")).alias("v")).first().v[0]
    edges.append(_granule(top, grain, up=True) if grain else top)
    counts.unpersist()
    kind = T.DoubleType() if grain else e.type
    out: Column | None = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        pair = F.struct(F.lit(lo).cast(kind).alias("min"), F.lit(hi).cast(kind).alias("max"))
        inside = F.col("__v") < F.lit(hi) if i < len(edges) - 2 else F.lit(True)
        if lo is None or hi is None:
            inside = F.col("__v").isNull() | inside
        inside = F.coalesce(inside, F.lit(True))
        out = F.when(inside, pair) if out is None else out.when(inside, pair)
    return group(rows.withColumn("__b", out), {"_id": "$__b"} | (spec.get("output") or _COUNT), order).orderBy("_id")


def running(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Running sum in key order without one task holding all rows: sums by range, then within each."""
    ranged = counts.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("__p", F.spark_partition_id())
    ranged = ranged.cache()
    parts = ranged.groupBy("__p").agg(F.sum(n).alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__p").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(base), "__p").withColumn(name, F.sum(n).over(own) + F.col("__base")).drop("__p", "__base")


#: The Renard and 1-2-5 series; the E series come from a rule below.
_SERIES = {
    "R5": [10, 16, 25, 40, 63],
    "R10": [100, 125, 160, 200, 250, 315, 400, 500, 630, 800],
    "R20": [100, 112, 125, 140, 160, 180, 200, 224, 250, 280, 315, 355, 400, 450, 500, 560, 630, 710, 800, 900],
    "R40": [100, 106, 112, 118, 125, 132, 140, 150, 160, 170, 180, 190, 200, 212, 224, 236, 250, 265, 280, 300, 315, 355, 375, 400, 425, 450,
            475, 500, 530, 560, 600, 630, 670, 710, 750, 800, 850, 900, 950],
    "R80": [103, 109, 115, 122, 128, 136, 145, 155, 165, 175, 185, 195, 206, 218, 230, 243, 258, 272, 290, 307, 325, 345, 365, 387, 412, 437, 462,
            487, 515, 545, 575, 615, 650, 690, 730, 775, 825, 875, 925, 975],
    "1-2-5": [10, 20, 50],
    "E6": [10, 15, 22, 33, 47, 68],
    "E12": [10, 12, 15, 18, 22, 27, 33, 39, 47, 56, 68, 82],
    "E24": [10, 11, 12, 13, 15, 16, 18, 20, 22, 24, 27, 30, 33, 36, 39, 43, 47, 51, 56, 62, 68, 75, 82, 91],
}


def _series(name: str) -> list[float]:
    """One decade of a series, from 1 on."""
    if name in _SERIES:
        values = _SERIES[name]
        return [x / 10 ** int(math.log10(values[0])) for x in values]
    if name in ("E48", "E96", "E192"):  # three significant digits of the geometric series
        n = int(name[1:])
        out = [round(10 ** (i / n), 2) for i in range(n)]
        return [9.2 if name == "E192" and abs(x - 9.19) < 1e-9 else x for x in out]
    raise ExpressionError(f"unknown granularity {name}")


def _granule(value: float, name: str, up: bool) -> float:
    """The nearest member of the series above (or at or below) a value."""
    if value is None or value < 0 or isinstance(value, float) and math.isnan(value):
        raise ExpressionError("granularity takes non-negative numbers")
    if value == 0:
        return 0
    if name == "POWERSOF2":
        k = math.floor(math.log2(value))
        while 2.0**k > value:
            k -= 1
        while 2.0 ** (k + 1) <= value:
            k += 1
        return 2.0 ** (k + 1) if up else (2.0**k if 2.0**k < value else 2.0 ** (k - 1))
    base = math.floor(math.log10(value))
    scale = sorted(x * 10.0**k for k in range(base - 1, base + 2) for x in _series(name))
    return next(x for x in scale if x > value) if up else next(x for x in reversed(scale) if x < value)


def sort_by_count(df: DataFrame, node: Any) -> DataFrame:
    return group(df, {"_id": node, "count": {"$sum": 1}}, None).orderBy(F.col("count").desc(), F.col("_id"))


def count(df: DataFrame, name: str, part: str | None = None) -> DataFrame:
    """One row, or none if the input is empty."""
    rows = df.groupBy(part or F.lit(1).alias("__one")).agg(F.count(F.lit(1)).cast("long").alias(name))
    return rows if part else rows.drop("__one").filter(F.col(name) > 0)


def densify(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Adds the missing steps; rows that are made hold the field and the partition's fields only."""
    name, by, rng = spec["field"], spec.get("partitionByFields") or [], spec["range"]
    step, unit, bounds = rng["step"], rng.get("unit"), rng["bounds"]
    ctx = Ctx(df)
    e = compile_expr(f"${name}", ctx)
    is_date = e.kind == "date"
    if is_date != (unit is not None):
        raise ExpressionError("$densify: dates take a unit and numbers take none")
    value = as_date(e).col if is_date else e.col
    rows = df.withColumn("__v", value)
    groups = rows.groupBy(*[F.col(f"`{b}`") for b in by]) if by else rows.groupBy(F.lit(0).alias("__all"))
    lo, hi = F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    parts = groups.agg(lo, hi).filter("__lo is not null")
    if bounds == "full":
        whole = rows.agg(lo, hi).first()  # two values
        if whole["__lo"] is None:
            return df
        parts = parts.withColumns({"__lo": F.lit(whole["__lo"]), "__hi": F.lit(whole["__hi"])})
    elif bounds != "partition":
        a, b = (literal(x, ctx).col for x in bounds)
        parts = parts.withColumns({"__lo": a, "__hi": b})
    end = F.col("__hi")
    fixed = isinstance(bounds, (list, tuple))
    if is_date and unit in ("month", "quarter", "year"):
        months = {"month": 1, "quarter": 3, "year": 12}[unit] * step
        n = F.floor(F.months_between(end, F.col("__lo")) / months).cast("int") + 1
        steps = F.transform(F.sequence(F.lit(0), n), lambda i: of_unit(F.col("__lo"), "month", (i * months).cast("int")))
    else:
        width = step * (MILLIS[unit] if is_date else 1)
        start, stop = (F.unix_millis(F.col("__lo")), F.unix_millis(end)) if is_date else (F.col("__lo"), end)
        n = F.floor((stop - start) / F.lit(width)).cast("int")
        wide = F.lit(width).cast("long") if isinstance(width, int) else F.lit(float(width))
        made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: start + i * wide)
        steps = F.transform(made, F.timestamp_millis) if is_date else made
    inside = F.col("__v") < end if fixed else F.col("__v") <= end
    grid = parts.select(*[F.col(f"`{b}`") for b in by], "__hi", F.explode(steps).alias("__v")).filter(inside).drop("__hi")
    keys = [grid[b].eqNullSafe(rows[b]) for b in by] + [grid["__v"] == rows["__v"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    new = grid.join(rows.select(*[F.col(f"`{b}`") for b in by], "__v"), on, "left_anti")
    if isinstance(e.type, T.TimestampNTZType):
        made = F.col("__v").cast("timestamp_ntz")
    else:
        made = F.col("__v").cast(e.type)
    new = new.select(*[F.col(f"`{b}`") for b in by if b != name], made.alias(name))
    return df.unionByName(new, allowMissingColumns=True)


#: Largest number of rows that a task holds to pick the first ones of an order.
MOST_HELD = 1 << 16


def sample(df: DataFrame, size: int) -> DataFrame:
    """So many rows at random: the first in a random order, or beyond what a task should hold a share and then as many of it."""
    if size <= MOST_HELD:
        return df.orderBy(F.rand()).limit(size)
    total = df.count()
    if size >= total:
        return df
    return df.filter(F.rand() < F.lit((size + 8 * math.sqrt(size)) / total)).limit(size)
