"""``$jsonSchema`` as a predicate tree."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, Ex, field_of, root_of

#: JSON type names and what they are called here.
_JSON_TYPES = {"object": "object", "array": "array", "number": "number", "boolean": "bool", "string": "string", "null": "null"}


def json_schema(spec: dict[str, Any], ctx: Ctx) -> Column:
    return _check(root_of(ctx), spec, ctx, F.lit(True))


def _check(e: Ex, spec: dict[str, Any], ctx: Ctx, there: Column) -> Column:
    """Whether a value conforms; keywords of other kinds of value do not apply."""
    from .filters import _is_type, _sure, equals

    out = F.lit(True)
    kind = e.kind
    for key, v in spec.items():
        if key in ("bsonType", "type"):
            hit = F.lit(False)
            for name in v if isinstance(v, list) else [v]:
                hit = hit | _is_type(e, _JSON_TYPES.get(name, name) if key == "type" else name)
            out = out & hit
        elif key == "enum":
            hit = F.lit(False)
            for x in v:
                hit = hit | equals(e, x)
            out = out & hit
        elif key in ("minimum", "maximum", "multipleOf") and kind == "number":
            if key == "multipleOf":
                out = out & _sure(e.col % v == 0)
            elif key == "minimum":
                out = out & _sure(e.col > v if spec.get("exclusiveMinimum") is True else e.col >= v)
            else:
                out = out & _sure(e.col < v if spec.get("exclusiveMaximum") is True else e.col <= v)
        elif key in ("minLength", "maxLength", "pattern") and kind == "string":
            if key == "pattern":
                out = out & _sure(F.rlike(e.col, F.lit(v)))
            else:
                n = F.char_length(e.col)
                out = out & _sure(n >= v if key == "minLength" else n <= v)
        elif key in ("minItems", "maxItems", "uniqueItems", "items") and kind == "array":
            n = F.size(e.col)
            t = e.type.elementType
            if key == "minItems":
                out = out & _sure(n >= v)
            elif key == "maxItems":
                out = out & _sure(n <= v)
            elif key == "uniqueItems":
                out = out & (_sure(F.size(F.array_distinct(e.col)) == n) if v else F.lit(True))
            elif isinstance(v, dict):
                out = out & _sure(F.forall(e.col, lambda x, v=v: _check(Ex(x, t, ctx), v, ctx, F.lit(True))))
            else:
                for i, sub in enumerate(v):
                    out = out & ((n <= i) | _check(Ex(F.get(e.col, F.lit(i)), t, ctx), sub, ctx, F.lit(True)))
        elif key == "required":
            for name in v:
                inner = field_of(e, name) if kind == "object" else None
                out = out & (F.lit(False) if inner is None or inner.kind == "null" else inner.col.isNotNull())
        elif key == "properties" and kind == "object":
            for name, sub in v.items():
                inner = field_of(e, name)
                if inner.kind != "null":
                    out = out & (inner.col.isNull() | _check(inner, sub, ctx, there))
        elif key == "additionalProperties" and v is False and isinstance(e.type, T.StructType):
            for name in e.type.fieldNames():
                if name not in spec.get("properties", {}) and name != "_id":
                    out = out & e.col.getField(name).isNull()
        elif key in ("allOf", "anyOf", "oneOf"):
            hits = [_check(e, sub, ctx, there) for sub in v]
            if key == "allOf":
                for h in hits:
                    out = out & h
            elif key == "anyOf":
                some = F.lit(False)
                for h in hits:
                    some = some | h
                out = out & some
            else:
                total = F.lit(0)
                for h in hits:
                    total = total + h.cast("int")
                out = out & (total == 1)
        elif key == "not":
            out = out & ~_check(e, v, replace(ctx), there)
    return out
