"""Compile expression documents to columns, with static types beside them.

A field path is ``"$a.b"``, a variable ``"$$name"``, an operator a one-key
document ``{"$op": operand}``; other documents and lists build structs and
arrays. Types are known at compile time, so the rules for nulls, arrays and
mixed types are settled while the plan is built and rows only see built-in
functions.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """A malformed or unsupported expression."""


class Ex:
    """A column and its static type, worked out by the analyser when it is first asked for."""

    def __init__(self, col: Column, dtype: T.DataType | None = None, ctx: "Ctx | None" = None, const: Any = None, is_const: bool = False):
        self.col, self._type, self.ctx, self.const, self.is_const = col, dtype, ctx, const, is_const

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.ctx.type_of(self.col)
        return self._type

    @property
    def kind(self) -> str:
        return kind_of(self.type)




@dataclass
class Ctx:
    """What an expression is compiled against: the input's schema and the variables in scope.

    ``typer`` gives a column's type where the analyser cannot see it (inside lambdas).
    """

    df: DataFrame
    vars: dict[str, Ex] = field(default_factory=dict)
    root: Ex | None = None
    typer: Callable[[Column], T.DataType] | None = None

    def type_of(self, col: Column) -> T.DataType:
        if self.typer is not None:
            return self.typer(col)
        return self.df.select(col.alias("x")).schema[0].dataType

    def ex(self, col: Column, dtype: T.DataType | None = None) -> Ex:
        return Ex(col, dtype, self)

    def bind(self, **found: Ex) -> "Ctx":
        return replace(self, vars=self.vars | found)

    def of(self, node: Any) -> Ex:
        return compile_expr(node, self)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.BinaryType):
        return "binData"
    if isinstance(t, T.VariantType):
        return "variant"
    return "other"


#: The order of types.
TYPE_RANK = {"null": 0, "number": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "bool": 7, "date": 8, "variant": 9, "other": 10}

_OPERATORS: dict[str, Callable[[Any, Ctx], Ex]] = {}


def expression(*names: str):
    """Register a compiler ``(operand, ctx) -> Ex`` for an operator; also the way to add one's own."""

    def add(f):
        for n in names:
            _OPERATORS[n] = f
        return f

    return add


def operators() -> list[str]:
    return sorted(_OPERATORS)


def literal(value: Any, ctx: Ctx) -> Ex:
    """A constant; documents become structs and lists arrays."""
    if isinstance(value, dict):
        parts = [literal(v, ctx).col.alias(k) for k, v in value.items()]
        return Ex(F.struct(*parts) if parts else F.struct(), None, ctx, value, True)
    if isinstance(value, (list, tuple)):
        return Ex(F.array(*[literal(v, ctx).col for v in value]), None, ctx, list(value), True)
    if value is None:
        return Ex(F.lit(None), T.NullType(), ctx, None, True)
    if isinstance(value, bool):
        return Ex(F.lit(value), T.BooleanType(), ctx, value, True)
    if isinstance(value, int):
        wide = abs(value) >= 2**31
        return Ex(F.lit(value).cast("long") if wide else F.lit(value), T.LongType() if wide else T.IntegerType(), ctx, value, True)
    if isinstance(value, float):
        return Ex(F.lit(value), T.DoubleType(), ctx, value, True)
    if isinstance(value, str):
        return Ex(F.lit(value), T.StringType(), ctx, value, True)
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.UTC)
        return Ex(F.timestamp_millis(F.lit(int(value.timestamp() * 1000))), T.TimestampType(), ctx, value, True)
    if isinstance(value, decimal.Decimal):
        return Ex(F.lit(value), None, ctx, value, True)
    return Ex(F.lit(value), None, ctx, value, True)


def field_of(base: Ex, name: str) -> Ex:
    """One step of a path: a struct's field, a map's value, or that of each array element."""
    t, ctx = base.type, base.ctx
    if isinstance(t, T.StructType):
        if name in t.fieldNames():
            return Ex(base.col.getField(name), t[name].dataType, ctx)
        return Ex(F.lit(None), T.NullType(), ctx)
    if isinstance(t, T.MapType):
        return Ex(base.col.getItem(name), t.valueType, ctx)
    if isinstance(t, T.ArrayType):
        inner = field_of(Ex(F.lit(None).cast(t.elementType), t.elementType, ctx), name)
        if isinstance(inner.type, T.NullType):
            return Ex(F.array().cast(T.ArrayType(T.StringType())), T.ArrayType(T.StringType()), ctx)
        each = F.transform(base.col, lambda x: field_of(Ex(x, t.elementType, ctx), name).col)
        return Ex(F.filter(each, lambda x: x.isNotNull()), T.ArrayType(inner.type), ctx)
    if isinstance(t, T.VariantType):
        return Ex(F.try_variant_get(base.col, f"$.{name}", "variant"), T.VariantType(), ctx)
    return Ex(F.lit(None), T.NullType(), ctx)


def path(text: str, ctx: Ctx) -> Ex:
    """A dotted path from the root document."""
    head, *rest = text.split(".")
    if ctx.root is not None:
        out = field_of(ctx.root, head)
    else:
        schema = ctx.df.schema
        if head not in schema.fieldNames():
            return Ex(F.lit(None), T.NullType(), ctx)
        out = Ex(F.col(f"`{head}`"), schema[head].dataType, ctx)
    for name in rest:
        out = field_of(out, name)
    return out


def root_of(ctx: Ctx) -> Ex:
    if ctx.root is not None:
        return ctx.root
    return Ex(F.struct(*[F.col(f"`{c}`") for c in ctx.df.columns]), ctx.df.schema, ctx)


def variable(text: str, ctx: Ctx) -> Ex:
    head, *rest = text.split(".")
    if head in ctx.vars:
        out = ctx.vars[head]
    elif head in ("ROOT", "CURRENT"):
        if rest:
            return path(".".join(rest), ctx)
        return root_of(ctx)
    elif head == "NOW":
        out = Ex(F.current_timestamp(), T.TimestampType(), ctx)
    elif head == "REMOVE":
        out = Ex(F.lit(None), T.NullType(), ctx)
    elif head in ("PRUNE", "KEEP", "DESCEND"):
        out = Ex(F.lit(head), T.StringType(), ctx)
    elif head == "USER_ROLES":
        out = Ex(F.array().cast(T.ArrayType(T.StringType())), T.ArrayType(T.StringType()), ctx)
    else:
        raise ExpressionError(f"use of undefined variable: {head}")
    for name in rest:
        out = field_of(out, name)
    return out


def compile_expr(node: Any, ctx: Ctx) -> Ex:
    if isinstance(node, Column):
        return Ex(node, None, ctx)
    if isinstance(node, str):
        if node.startswith("$$"):
            return variable(node[2:], ctx)
        if node.startswith("$"):
            return path(node[1:], ctx)
        return literal(node, ctx)
    if isinstance(node, dict):
        if len(node) == 1 and (key := next(iter(node))).startswith("$"):
            if key not in _OPERATORS:
                raise ExpressionError(f"unrecognized expression {key}")
            return _OPERATORS[key](node[key], ctx)
        if any(k.startswith("$") for k in node):
            raise ExpressionError(f"an operator document has exactly one key: {list(node)}")
        if not node:
            return literal({}, ctx)
        parts = [(k, compile_expr(v, ctx)) for k, v in node.items()]
        return Ex(F.struct(*[e.col.alias(k) for k, e in parts]), None, ctx)
    if isinstance(node, (list, tuple)):
        if not node:
            return Ex(F.array().cast("array<string>"), T.ArrayType(T.StringType()), ctx)
        return Ex(F.array(*[compile_expr(v, ctx).col for v in node]), None, ctx)
    return literal(node, ctx)


# helpers that operators share


def operands(node: Any, ctx: Ctx, least: int = 0, most: int | None = None, name: str = "operator") -> list[Ex]:
    """The operand list of an n-ary operator; a single operand need not be in a list."""
    items = list(node) if isinstance(node, (list, tuple)) else [node]
    if len(items) < least or most is not None and len(items) > most:
        raise ExpressionError(f"{name} takes {least} to {most if most is not None else 'any number of'} operands, not {len(items)}")
    return [compile_expr(x, ctx) for x in items]


def named(node: Any, ctx: Ctx, required: tuple[str, ...], optional: tuple[str, ...] = (), name: str = "operator") -> dict[str, Ex | None]:
    """The named operands of an operator document."""
    if not isinstance(node, dict):
        raise ExpressionError(f"{name} takes a document")
    unknown = set(node) - {*required, *optional}
    missing = set(required) - set(node)
    if unknown or missing:
        raise ExpressionError(f"{name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
    return {k: compile_expr(node[k], ctx) if k in node else None for k in (*required, *optional)}


def truthy(e: Ex) -> Column:
    """Not null, false or 0; never null itself."""
    if e.kind == "null":
        return F.lit(False)
    if e.kind == "bool":
        return F.coalesce(e.col, F.lit(False))
    if e.kind == "number":
        return F.coalesce(e.col != 0, F.lit(False))
    return e.col.isNotNull()


def is_null(e: Ex) -> Column:
    return F.lit(True) if e.kind == "null" else e.col.isNull()


def as_date(e: Ex) -> Ex:
    """Dates as TIMESTAMP, whatever type they were read as."""
    if isinstance(e.type, T.TimestampType):
        return e
    return Ex(e.col.cast("timestamp"), T.TimestampType(), e.ctx)


def guard(ok: Column, value: Column, message: str) -> Column:
    """The value, or an error on rows where the condition is false (null passes)."""
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))


def _double(e: Ex) -> bool:
    return isinstance(e.type, (T.DoubleType, T.FloatType))


def compare(a: Ex, b: Ex, op: str) -> Column:
    """eq, lt, lte in the total order of values; never null."""
    ra, rb = TYPE_RANK[a.kind], TYPE_RANK[b.kind]
    na, nb = is_null(a), is_null(b)
    if ra == rb or 0 in (ra, rb):
        if ra == rb == 0:
            return F.lit(op != "lt")
        if 0 in (ra, rb):
            if op == "eq":
                return na & nb
            if op == "lt":
                return na & ~nb
            return na
        x, y = (as_date(a).col, as_date(b).col) if a.kind == "date" else (a.col, b.col)
        if op == "eq":
            return x.eqNullSafe(y)
        less = x < y
        if _double(a) or _double(b):
            nx, ny = F.isnan(x.cast("double")), F.isnan(y.cast("double"))
            less = F.when(nx | ny, nx & ~ny).otherwise(less)
        lt = F.when(na, ~nb).when(nb, F.lit(False)).otherwise(less)
        if op == "lt":
            return lt
        return lt | x.eqNullSafe(y)
    if op == "eq":
        return na & nb
    lt = F.when(na & nb, F.lit(False)).when(na, F.lit(True)).when(nb, F.lit(False)).otherwise(F.lit(ra < rb))
    return lt if op == "lt" else lt | (na & nb)


def wider(*types: T.DataType) -> T.DataType:
    """The numeric type that holds results over all of these; 32-bit integers give 64-bit ones."""
    if any(isinstance(t, T.DecimalType) for t in types):
        if any(isinstance(t, (T.DoubleType, T.FloatType)) for t in types):
            return T.DoubleType()
        return next(t for t in types if isinstance(t, T.DecimalType))
    if any(isinstance(t, (T.DoubleType, T.FloatType)) for t in types):
        return T.DoubleType()
    return T.LongType()


def scoped(ctx: Ctx, body: Any, types: dict[str, T.DataType]) -> tuple[T.DataType, Callable[..., Column]]:
    """(type, builder) of a lambda's body over parameters of these types.

    The analyser cannot type a lambda's parameter by itself, so the body is
    compiled once over typed nulls, with the types it asks for taken down, and then
    over the parameters, with those types read back in the same order.
    """
    tape: list[T.DataType] = []

    def record(col: Column) -> T.DataType:
        tape.append(ctx.type_of(col))
        return tape[-1]

    first = replace(ctx, typer=record)
    blanks = {k: Ex(F.lit(None) if isinstance(t, T.NullType) else F.lit(None).cast(t), t, first) for k, t in types.items()}
    body_type = compile_expr(body, first.bind(**blanks)).type

    def build(**cols: Column) -> Column:
        left = iter(tape)
        second = replace(ctx, typer=lambda _: next(left))
        return compile_expr(body, second.bind(**{k: Ex(c, types[k], second) for k, c in cols.items()})).col

    return body_type, build


def element_type(e: Ex, name: str) -> T.DataType:
    if isinstance(e.type, T.ArrayType):
        return e.type.elementType
    raise ExpressionError(f"{name} takes an array, not {e.type.simpleString()}")
