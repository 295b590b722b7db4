"""Joining stages: lookup in both forms, graphLookup, unionWith.

An equality lookup is one left join with the foreign rows gathered by key; a
lookup whose result is unwound at once is a plain join and gathers nothing. A
correlated sub-pipeline runs once for each distinct set of values that tie it to
the input: its leading match becomes the join condition, its other stages run
within each set, and the input is joined back on the values themselves. No row
is identified by a number drawn while the plan runs, since Spark runs the input
on both sides of that join; where the two runs could differ (limits, samples,
sums of doubles), the input is written once first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, Ex, compile_expr, path
from .accumulators import Order, orderable
from .rows import set_fields


#: Nodes of a plan that may give other rows when it runs again.
_UNSTABLE = re.compile(r"\b(GlobalLimit|LocalLimit|Offset|Tail|Sample|rand|randn|uuid|shuffle|monotonically_increasing_id|spark_partition_id|MapInArrow|MapInPandas)\b")
_SUMMED = re.compile(r"\b(Aggregate|Window)\b")


def _holds(t: T.DataType, *kinds: type) -> bool:
    if isinstance(t, T.StructType):
        return any(_holds(f.dataType, *kinds) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _holds(t.elementType, *kinds)
    if isinstance(t, T.MapType):
        return _holds(t.keyType, *kinds) or _holds(t.valueType, *kinds) or T.MapType in kinds
    return isinstance(t, kinds)


def _settled(df: DataFrame, keys: list[Column], checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The input, written once if running it twice could give other values of the keys."""
    probe = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    plan = probe._jdf.queryExecution().analyzed().toString()
    floats = any(_holds(f.dataType, T.DoubleType, T.FloatType) for f in probe.schema.fields)
    return checkpoint(df) if _UNSTABLE.search(plan) or floats and _SUMMED.search(plan) else df


def _identity(parts: dict[str, Ex]) -> Column:
    """One struct that stands for a row's values, comparable whatever their types."""
    out = [(e.col if orderable(e.type) else F.to_json(F.struct(e.col.alias("v")))).alias(k) for k, e in parts.items()]
    return F.struct(*out, F.lit(0).alias("z"))


def _fresh(name: str, *frames: DataFrame) -> str:
    while any(name in df.columns for df in frames):
        name += "_"
    return name


def _uses_variables(node: Any) -> bool:
    if isinstance(node, str):
        return node.startswith("$$") and node[2:].split(".")[0] not in _SYSTEM
    if isinstance(node, dict):
        return any(_uses_variables(v) for k, v in node.items() if k != "$literal")
    return isinstance(node, (list, tuple)) and any(map(_uses_variables, node))


_SYSTEM = {"ROOT", "CURRENT", "NOW", "CLUSTER_TIME", "REMOVE", "PRUNE", "KEEP", "DESCEND", "USER_ROLES"}


def _correlated(spec: dict[str, Any]) -> bool:
    """Whether a match uses variables; only expressions can."""
    for k, v in spec.items():
        if k == "$expr" and _uses_variables(v):
            return True
        if k in ("$and", "$or", "$nor") and any(_correlated(x) for x in v):
            return True
    return False


def _struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _array(e: Ex) -> bool:
    return isinstance(e.type, T.ArrayType)


def _gathered(t: T.DataType, col: Column) -> Column:
    """Matched documents as an array in their natural order."""
    rows = F.collect_list(col)
    return F.sort_array(rows) if orderable(t) else rows


def lookup_equal(df: DataFrame, foreign: DataFrame, local: str, other: str, name: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All foreign rows whose field equals the local one (an element of it, if it is an array); null and missing equal each other."""
    left, right = path(local, Ctx(df)), path(other, Ctx(foreign))
    doc = foreign.schema
    rows = foreign.select(right.col.alias("__k"), _struct(foreign).alias("__d"))
    if _array(right):
        rows = foreign.select(F.explode_outer(F.array_distinct(right.col)).alias("__k"), _struct(foreign).alias("__d"))
    empty = F.array().cast(T.ArrayType(doc))
    if not _array(left):
        found = rows.groupBy("__k").agg(_gathered(doc, F.col("__d")).alias("__m"))
        key = left.col if left.kind != "null" else F.lit(None).cast(found.schema["__k"].dataType)
        joined = df.withColumn("__l", key).join(found, F.col("__l").eqNullSafe(F.col("__k")), "left")
        return set_fields(joined, {name: F.coalesce("__m", empty)}).drop("__k", "__l", "__m")
    df = _settled(df, [left.col], checkpoint)
    row = _fresh("__row", df)
    tied = df.withColumn(row, _identity({"l": left}))
    keys = tied.select(row, left.col.alias("__a")).dropDuplicates([row])
    hits = keys.select(row, F.explode(F.array_distinct("__a")).alias("__l")).join(rows, F.col("__l").eqNullSafe(F.col("__k"))).select(row, "__d")
    if orderable(doc):
        hits = hits.distinct()
    found = hits.groupBy(row).agg(_gathered(doc, F.col("__d")).alias("__m"))
    joined = tied.join(found, row, "left")
    return set_fields(joined, {name: F.coalesce("__m", empty)}).drop(row, "__m")


def lookup_flat(df: DataFrame, foreign: DataFrame, local: str, other: str, name: str, keep: bool) -> DataFrame:
    """Lookup and unwind in one: a join that puts the matching document in the field."""
    left, right = path(local, Ctx(df)), path(other, Ctx(foreign))
    rows = foreign.select(right.col.alias("__k"), _struct(foreign).alias("__d"))
    key = left.col if left.kind != "null" else F.lit(None).cast(right.type)
    joined = df.withColumn("__l", key).join(rows, F.col("__l").eqNullSafe(F.col("__k")), "left" if keep else "inner")
    return set_fields(joined, {name: F.col("__d")}).drop("__k", "__l", "__d")


def lookup_exists(df: DataFrame, foreign: DataFrame, local: str, other: str, some: bool) -> DataFrame:
    """Lookup that is only asked whether it found anything: a semi or anti join."""
    left, right = path(local, Ctx(df)), path(other, Ctx(foreign))
    rows = foreign.select(right.col.alias("__k"))
    joined = df.withColumn("__l", left.col)
    return joined.join(rows, F.col("__l").eqNullSafe(F.col("__k")), "left_semi" if some else "left_anti").drop("__l")


def lookup_pipeline(
    df: DataFrame, foreign: DataFrame | None, spec: dict[str, Any], ctx: Ctx, run: Callable, filters: Callable,
    fetch: Callable[[list], DataFrame], checkpoint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``run(df, stages, order, part, ctx)`` runs stages within a partition column and gives (df, order).

    Variables of an outer lookup (``ctx.vars``) are seen in the sub-pipeline as its own are.
    """
    stages, name = list(spec["pipeline"]), spec["as"]
    if foreign is None:  # a literal source
        foreign = fetch(stages.pop(0)["$documents"])
    outer = {k: e for k, e in ctx.vars.items() if f"$${k}" in str(stages)}
    given = outer | {k: compile_expr(v, ctx) for k, v in (spec.get("let") or {}).items()}
    ties = dict(given)
    if "localField" in spec:
        ties["__local"] = path(spec["localField"], Ctx(df))
    if ties:
        df = _settled(df, [e.col for e in ties.values()], checkpoint)
    row = _fresh("__row", df)
    let = {k: _fresh(f"__let_{k}", df, foreign) for k in given}
    tied = df.withColumn(row, _identity(ties))
    local = [ties["__local"].col.alias("__local")] if "localField" in spec else []
    keys = tied.select(row, *[e.col.alias(let[k]) for k, e in given.items()], *local).dropDuplicates([row])
    bound = {k: Ex(F.col(let[k]), e.type, ctx) for k, e in given.items()}
    lead: list[tuple[Column, bool]] = []
    while stages and "$match" in stages[0]:
        lead += _conjuncts(stages.pop(0)["$match"], Ctx(foreign, bound), filters)
    plain = [c for c, free in lead if not free]
    for c in plain:
        foreign = foreign.filter(c)
    on: Column | None = None
    for c, free in lead:
        if free:
            on = c if on is None else on & c
    if "localField" in spec:
        other = path(spec["foreignField"], Ctx(foreign))
        mine = Ex(F.col("__local"), ties["__local"].type, ctx)
        same = _matches(mine, other)
        on = same if on is None else on & same
    if on is None and not bound:  # nothing ties it to the input row: one result for all
        sub, order = run(foreign, stages, None, None, Ctx(foreign))
        whole = sub.agg(_ordered(sub, order).alias("__m"))
        return set_fields(df.crossJoin(F.broadcast(whole)), {name: F.col("__m")}).drop("__m")
    pairs = keys.join(foreign, on if on is not None else F.lit(True), "inner")
    sub, order = run(pairs, stages, None, row, Ctx(pairs, bound))
    names = [c for c in sub.columns if c != row and not c.startswith("__")]
    sub = sub.select(row, *[F.col(f"`{c}`") for c in names])
    doc = T.StructType([sub.schema[c] for c in names])
    found = sub.groupBy(row).agg(_ordered(sub, order, names).alias("__m"))
    joined = tied.join(found, row, "left")
    return set_fields(joined, {name: F.coalesce("__m", F.array().cast(T.ArrayType(doc)))}).drop(row, "__m")


def _matches(a: Ex, b: Ex) -> Column:
    """Equality of a lookup's two fields; an array stands for its elements."""
    if _array(a) and _array(b):
        return F.coalesce(F.arrays_overlap(a.col, b.col), F.lit(False))
    if _array(a) or _array(b):
        many, one = (a, b) if _array(a) else (b, a)
        return F.coalesce(F.array_contains(many.col, one.col), F.lit(False))
    return a.col.eqNullSafe(b.col)


def _ordered(df: DataFrame, order: Order | None, names: list[str] | None = None) -> Column:
    from .accumulators import Call

    names = names or df.columns
    return Call(None, Ctx(df), order).listed(F.struct(*[F.col(f"`{c}`") for c in names]))


def _conjuncts(spec: dict[str, Any], ctx: Ctx, filters: Callable) -> list[tuple[Column, bool]]:
    """(condition, whether it uses the input row) for each part of a match."""
    out = []
    for k, v in spec.items():
        if k == "$and":
            for x in v:
                out += _conjuncts(x, ctx, filters)
        elif k == "$expr" and isinstance(v, dict) and "$and" in v:
            for x in v["$and"]:
                out += _conjuncts({"$expr": x}, ctx, filters)
        elif k == "$expr" and isinstance(v, dict) and "$eq" in v and _uses_variables(v):
            a, b = (compile_expr(x, ctx) for x in v["$eq"])
            same = a.kind == b.kind
            out.append((a.col.eqNullSafe(b.col) if same else filters({k: v}, ctx), True))
        else:
            out.append((filters({k: v}, ctx), _correlated({k: v})))
    return out


def union_with(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other, allowMissingColumns=True)


def graph_lookup(df: DataFrame, foreign: DataFrame, spec: dict[str, Any], filters: Callable, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Breadth-first search from all distinct starts at once: one join for each level.

    Pairs (start, node) are reached at their least depth. Levels are cut with
    ``checkpoint``; the loop ends when a level finds no new pair.
    """
    name, key, link = spec["as"], spec["connectToField"], spec["connectFromField"]
    limit, depth = spec.get("maxDepth"), spec.get("depthField")
    if spec.get("restrictSearchWithMatch"):
        foreign = foreign.filter(filters(spec["restrictSearchWithMatch"], Ctx(foreign)))
    fctx = Ctx(foreign)
    start = compile_expr(spec["startWith"], replace(Ctx(df)))
    df = _settled(df, [start.col], checkpoint)
    tied = df.withColumn("__row", _identity({"s": start}))
    seeds = F.explode("__s") if _array(start) else F.col("__s")
    frontier = tied.select("__row", start.col.alias("__s")).dropDuplicates(["__row"]).select("__row", seeds.alias("__v")).filter("__v is not null").distinct()
    identity = path("_id", fctx)
    if identity.kind == "null":
        identity = fctx.ex(F.xxhash64(F.to_json(_struct(foreign))))
    nodes = foreign.select(path(key, fctx).col.alias("__to"), path(link, fctx).col.alias("__from"), identity.col.alias("__node"), _struct(foreign).alias("__d"))
    from_array = isinstance(nodes.schema["__from"].dataType, T.ArrayType)
    reached: DataFrame | None = None
    level = 0
    while limit is None or level <= limit:
        hits = frontier.join(nodes, F.col("__v") == F.col("__to")).select("__row", "__node", "__d", "__from")
        hits = hits.dropDuplicates(["__row", "__node"])
        if reached is not None:
            hits = hits.join(reached.select("__row", "__node"), ["__row", "__node"], "left_anti")
        hits = checkpoint(hits.withColumn("__depth", F.lit(level).cast("long")))
        if hits.isEmpty():
            break
        reached = hits if reached is None else reached.unionByName(hits)
        step = F.explode("__from") if from_array else F.col("__from")
        frontier = hits.select("__row", step.alias("__v")).filter("__v is not null").distinct()
        level += 1
    doc: T.StructType = foreign.schema
    if depth:
        doc = T.StructType([*doc.fields, T.StructField(depth, T.LongType())])
    empty = F.array().cast(T.ArrayType(doc))
    if reached is None:
        return set_fields(df, {name: empty})
    value = F.col("__d")
    if depth:
        value = F.struct(*[value.getField(f).alias(f) for f in foreign.columns], F.col("__depth").alias(depth))
    rows = F.struct("__depth", "__node", value.alias("d"))
    found = reached.groupBy("__row").agg(F.array_sort(F.collect_list(rows), _by_depth).alias("__m"))
    joined = tied.join(found, "__row", "left")
    out = F.coalesce(F.transform("__m", lambda x: x["d"]), empty)
    return set_fields(joined, {name: out}).drop("__row", "__m")


def _by_depth(x: Column, y: Column) -> Column:
    less = (x["__depth"] < y["__depth"]) | ((x["__depth"] == y["__depth"]) & (x["__node"] < y["__node"]))
    same = (x["__depth"] == y["__depth"]) & (x["__node"] == y["__node"])
    return F.when(same, 0).when(less, -1).otherwise(1)
