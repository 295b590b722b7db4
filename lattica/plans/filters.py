"""Compile filter documents to predicates.

A predicate is never null: what is null or missing does not match, and negation
turns that into a match. Fields that are arrays match if the whole array or any
element does; which of the two applies is known from the schema.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import TYPE_RANK, Ctx, Ex, as_date, compile_expr, literal, path, truthy


class FilterError(ValueError):
    """A malformed or unsupported filter."""


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_filter(spec: dict[str, Any], ctx: Ctx) -> Column:
    """The rows that match a filter document; an empty one matches all."""
    out = F.lit(True)
    for key, value in spec.items():
        out = out & _top(key, value, ctx)
    return out


def _list(value: Any, key: str) -> list:
    if not isinstance(value, (list, tuple)) or not value:
        raise FilterError(f"{key} takes a non-empty list")
    return list(value)


def _top(key: str, value: Any, ctx: Ctx) -> Column:
    if key == "$and":
        out = F.lit(True)
        for x in _list(value, key):
            out = out & compile_filter(x, ctx)
        return out
    if key in ("$or", "$nor"):
        out = F.lit(False)
        for x in _list(value, key):
            out = out | compile_filter(x, ctx)
        return ~out if key == "$nor" else out
    if key == "$expr":
        return truthy(compile_expr(value, ctx))
    if key == "$jsonSchema":
        from .schema import json_schema

        return json_schema(value, ctx)
    if key == "$text":
        return text_search(value, ctx)
    if key in ("$comment", "$alwaysTrue"):
        return F.lit(True)
    if key == "$alwaysFalse":
        return F.lit(False)
    if key == "$sampleRate":
        return F.rand() < F.lit(float(value))
    if key.startswith("$"):
        raise FilterError(f"unknown top level operator {key}")
    return _field(path(key, ctx), value, ctx)


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and next(iter(value)).startswith("$") and next(iter(value)) not in ("$ref", "$id", "$db")


def _field(e: Ex, value: Any, ctx: Ctx) -> Column:
    if isinstance(value, re.Pattern):
        return _regex(e, value.pattern, "".join(f for f, k in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if value.flags & k))
    if not is_operators(value):
        return equals(e, value)
    out = F.lit(True)
    for op, x in value.items():
        if op == "$options":
            continue
        out = out & _operator(e, op, x, value, ctx)
    return out


def _any(e: Ex, test, whole: bool = False) -> Column:
    """The test on a value, or on any element if it is an array (and on the whole array if asked)."""
    if isinstance(e.type, T.ArrayType):
        t = e.type.elementType
        hit = _sure(F.exists(e.col, lambda x: _sure(test(Ex(x, t, e.ctx)))))
        return hit | _sure(test(e)) if whole else hit
    return _sure(test(e))


def _same(e: Ex, value: Any) -> Column:
    """Whole-value equality with a constant; types that cannot be equal are not."""
    if value is None:
        return e.col.isNull() if e.kind != "null" else F.lit(True)
    v = literal(value, e.ctx)
    if TYPE_RANK[v.kind] != TYPE_RANK[e.kind]:
        return F.lit(False)
    if isinstance(value, dict) and isinstance(e.type, T.StructType):
        if list(value) != e.type.fieldNames():
            return F.lit(False)
        out = F.lit(True)
        for k, x in value.items():
            out = out & _sure(_same(Ex(e.col.getField(k), e.type[k].dataType, e.ctx), x))
        return out
    if e.kind == "date":
        return as_date(e).col == v.col
    if e.kind == "array" and not value:
        return F.size(e.col) == 0
    return e.col == v.col


def equals(e: Ex, value: Any) -> Column:
    if e.kind == "null":
        return F.lit(value is None)
    if isinstance(e.type, T.ArrayType):
        t = e.type.elementType
        if value is None:
            return e.col.isNull() | _sure(F.exists(e.col, lambda x: x.isNull()))
        return _sure(F.exists(e.col, lambda x: _sure(_same(Ex(x, t, e.ctx), value)))) | _sure(_same(e, value))
    return _sure(_same(e, value))


def _ordered(e: Ex, value: Any, op: str) -> Column:
    """A range test within the constant's type."""
    if value is None:
        return (e.col.isNull() if e.kind != "null" else F.lit(True)) if op in ("$gte", "$lte") else F.lit(False)
    v = literal(value, e.ctx)

    def test(x: Ex) -> Column:
        if TYPE_RANK[x.kind] != TYPE_RANK[v.kind]:
            return F.lit(False)
        a = as_date(x).col if x.kind == "date" else x.col
        out = {"$gt": a > v.col, "$gte": a >= v.col, "$lt": a < v.col, "$lte": a <= v.col}[op]
        if isinstance(x.type, (T.DoubleType, T.FloatType)) and value == value:
            out = out & ~F.isnan(a)
        return out

    return _any(e, test, whole=isinstance(value, list))


def _regex(e: Ex, pattern: str, options: str) -> Column:
    p = (f"(?{options})" if options else "") + pattern
    return _any(e, lambda x: F.rlike(x.col, F.lit(p)) if x.kind == "string" else F.lit(False))


def _bits(value: Any) -> int:
    if isinstance(value, (list, tuple)):
        return sum(1 << b for b in value)
    if isinstance(value, bytes):
        return int.from_bytes(value, "little")
    return int(value)


#: Names of types and the kinds they stand for.
_TYPE_NAMES = {
    1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 16: "int",
    18: "long", 19: "decimal",
}


def _is_type(e: Ex, name: Any) -> Column:
    name = _TYPE_NAMES.get(name, name)
    t = e.type
    if name == "null":
        return e.col.isNull()
    hit = {
        "number": isinstance(t, T.NumericType), "double": isinstance(t, (T.DoubleType, T.FloatType)), "decimal": isinstance(t, T.DecimalType),
        "int": isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)), "long": isinstance(t, T.LongType),
    }.get(name, e.kind == name)
    return e.col.isNotNull() if hit else F.lit(False)


def _operator(e: Ex, op: str, value: Any, whole: dict, ctx: Ctx) -> Column:
    if op == "$eq":
        return equals(e, value)
    if op == "$ne":
        return ~equals(e, value)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _ordered(e, value, op)
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            raise FilterError(f"{op} takes a list")
        plain = [v for v in value if not isinstance(v, (re.Pattern, list, dict)) and v is not None]
        kinds = {literal(v, ctx).kind for v in plain}
        if kinds == {e.kind} and e.kind in ("string", "number"):  # one IN, which reaches the scan
            out = _sure(e.col.isin(*plain))
            rest = [v for v in value if v is None or isinstance(v, re.Pattern)]
        else:
            out, rest = F.lit(False), list(value)
        for v in rest:
            out = out | _field(e, v, ctx) if isinstance(v, re.Pattern) else out | equals(e, v)
        return ~out if op == "$nin" else out
    if op == "$not":
        return ~_field(e, value, ctx)
    if op == "$exists":
        there = e.col.isNotNull() if e.kind != "null" else F.lit(False)
        return there if value else ~there
    if op == "$type":
        out = F.lit(False)
        for name in value if isinstance(value, (list, tuple)) else [value]:
            out = out | _is_type(e, name)
            if isinstance(e.type, T.ArrayType) and name not in ("array", 4):
                t = e.type.elementType
                out = out | _sure(F.exists(e.col, lambda x, name=name: _is_type(Ex(x, t, ctx), name)))
        return out
    if op == "$regex":
        if isinstance(value, re.Pattern):
            return _field(e, value, ctx)
        return _regex(e, value, whole.get("$options", ""))
    if op == "$mod":
        div, rem = (int(x) for x in value)
        if not div:
            raise FilterError("$mod: the divisor must not be 0")
        return _any(e, lambda x: (x.col.cast("long") % div) == rem if x.kind == "number" else F.lit(False))
    if op == "$size":
        if not isinstance(value, int) or value < 0:
            raise FilterError("$size takes a non-negative integer")
        return _sure(F.size(e.col) == value) if isinstance(e.type, T.ArrayType) else F.lit(False)
    if op == "$all":
        if not value:
            return F.lit(False)
        out = F.lit(True)
        for v in value:
            out = out & (_operator(e, "$elemMatch", v["$elemMatch"], v, ctx) if isinstance(v, dict) and "$elemMatch" in v else _field(e, v, ctx))
        return out
    if op == "$elemMatch":
        if not isinstance(e.type, T.ArrayType):
            return F.lit(False)
        t = e.type.elementType
        if is_operators(value) and next(iter(value)) not in ("$and", "$or", "$nor"):
            return _sure(F.exists(e.col, lambda x: _field(Ex(x, t, ctx), value, ctx)))
        return _sure(F.exists(e.col, lambda x: compile_filter(value, _rooted(ctx, Ex(x, t, ctx)))))
    if op in ("$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear"):
        mask = F.lit(_bits(value)).cast("long")

        def bits(x: Ex) -> Column:
            if x.kind != "number":
                return F.lit(False)
            got = x.col.cast("long").bitwiseAND(mask)
            return {"$bitsAllSet": got == mask, "$bitsAnySet": got != 0, "$bitsAllClear": got == 0, "$bitsAnyClear": got != mask}[op]

        return _any(e, bits)
    if op in ("$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
        from ..operators.geo import geo_filter

        return geo_filter(e, op, value, whole)
    if op in ("$minDistance", "$maxDistance", "$comment"):
        return F.lit(True)
    raise FilterError(f"unknown operator {op}")


def _rooted(ctx: Ctx, e: Ex) -> Ctx:
    from dataclasses import replace

    return replace(ctx, root=e)


def text_search(spec: dict[str, Any], ctx: Ctx) -> Column:
    """Any of the terms, all of the phrases, none of the negated terms, in any string field."""
    search, cased = spec["$search"], spec.get("$caseSensitive", False)
    flag = "" if cased else "(?iu)"
    phrases = re.findall(r'"([^"]+)"', search)
    terms = re.sub(r'"[^"]*"', " ", search).split()
    barred = [t[1:] for t in terms if t.startswith("-") and len(t) > 1]
    terms = [t for t in terms if not t.startswith("-")]
    fields = [F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in ctx.df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not fields:
        return F.lit(False)
    body = F.concat_ws("\n", *fields)

    def has(word: str) -> Column:
        return F.rlike(body, F.lit(f"{flag}(?<![\\p{{L}}\\p{{N}}_])\\Q{word}\\E(?![\\p{{L}}\\p{{N}}_])"))

    out = F.lit(bool(phrases)) if not terms else F.lit(False)
    for t in terms:
        out = out | has(t)
    if phrases:
        out = F.lit(True)
        for p in phrases:
            out = out & has(p)
    for b in barred:
        out = out & ~has(b)
    return out


