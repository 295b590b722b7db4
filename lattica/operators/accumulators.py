"""Accumulators of groups and windows.

Accumulators that depend on the order of rows (first, last, push and their
kin) take an explicit order: the keys of the last sort, else ``_id``, else all
columns that can be ordered. They never rely on the order rows happen to arrive in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from ..functions.arrays import rank_of
from ..functions.core import Ctx, Ex, ExpressionError, as_date, compile_expr

Order = list[tuple[str, int]]


def orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(orderable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return orderable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def sort_keys(ctx: Ctx, order: Order) -> list[Column]:
    """Sort expressions: an array sorts by its least element upwards and its greatest downwards."""
    out = []
    for name, way in order:
        e = compile_expr(f"${name}", ctx)
        c = (F.array_min if way > 0 else F.array_max)(e.col) if isinstance(e.type, T.ArrayType) and orderable(e.type) else e.col
        if isinstance(e.type, (T.DoubleType, T.FloatType)):  # NaN is the least number
            c = F.when(e.col.isNull(), F.lit(None)).otherwise(F.struct((~F.isnan(e.col)).alias("n"), e.col.alias("v")))
        out.append(c.asc_nulls_first() if way > 0 else c.desc_nulls_last())
    return out


def default_order(ctx: Ctx, order: Order | None) -> Order:
    if order:
        return order
    names = ctx.df.columns
    if "_id" in names and orderable(ctx.df.schema["_id"].dataType):
        return [("_id", 1)]
    return [(f.name, 1) for f in ctx.df.schema.fields if orderable(f.dataType) and "." not in f.name and not f.name.startswith("__")]


def rank_struct(ctx: Ctx, order: Order) -> Column | None:
    """One ascending key for the order, or None if a key cannot be turned round."""
    parts = []
    for i, (name, way) in enumerate(order):
        e = compile_expr(f"${name}", ctx)
        c = e.col
        if e.kind == "null":
            continue
        if isinstance(e.type, T.ArrayType):
            c = (F.array_min if way > 0 else F.array_max)(c)
            e = Ex(c, e.type.elementType, ctx)
        if way < 0:
            if e.kind == "number":
                c = -c.cast("decimal(38,10)") if isinstance(e.type, T.DecimalType) else -c.cast("double") if _floating(e.type) else -c.cast("decimal(20,0)")
            elif e.kind == "date":
                c = -F.unix_micros(as_date(e).col)
            elif e.kind == "bool":
                c = ~c
            elif isinstance(e.type, T.StringType):
                c = _turned(c)
            else:
                return None
            parts += [e.col.isNull().cast("int").alias(f"n{i}"), c.alias(f"k{i}")]
        else:
            parts.append(c.alias(f"k{i}"))
    return F.struct(*parts) if parts else F.struct(F.lit(0).alias("k"))


def _turned(text: Column) -> Column:
    """A key that sorts texts downwards: every half byte is complemented, and an end mark beyond all of them puts longer texts first."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _floating(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


@dataclass
class Call:
    """One accumulator: its operand, where it is compiled and the order of rows."""

    operand: Any
    ctx: Ctx
    order: Order | None
    over: Callable[[Column], Column] = lambda c: c

    def ex(self, node: Any = None) -> Ex:
        return compile_expr(self.operand if node is None else node, self.ctx)

    def listed(self, value: Column, order: Order | None = None) -> Column:
        """All values in the order of rows, nulls kept."""
        order = default_order(self.ctx, order or self.order)
        key = rank_struct(self.ctx, order)
        if key is not None:
            rows = self.over(F.collect_list(F.struct(key.alias("o"), value.alias("v"))))
            return F.transform(F.array_sort(rows, _by_key), lambda x: x["v"])
        keys = [compile_expr(f"${n}", self.ctx) for n, _ in order]
        row = F.struct(*[k.col.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))

        def cmp(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for i in reversed(range(len(order))):
                a, b, way = x[f"k{i}"], y[f"k{i}"], order[i][1]
                less = F.when(a.isNull(), b.isNotNull()).otherwise(F.coalesce(a < b, F.lit(False)))
                more = F.when(b.isNull(), a.isNotNull()).otherwise(F.coalesce(b < a, F.lit(False)))
                out = F.when(less, -way).when(more, way).otherwise(out)
            return out

        return F.transform(F.array_sort(self.over(F.collect_list(row)), cmp), lambda x: x["v"])

    def ends(self, e: Ex, n: int, last: bool, order: Order | None = None) -> Column:
        """The n first or last values in the order of rows, nulls kept.

        A bounded queue for each group is all that a task holds, and what it
        sends on; only orders or values that cannot be compared gather all rows.
        """
        order = default_order(self.ctx, order or self.order)
        key = rank_struct(self.ctx, order)
        if key is None or not orderable(e.type):
            rows = self.listed(e.col, order)
            return _last_n(rows, n) if last else F.slice(rows, 1, n)
        rows = self.over(_top_k(F.struct(key.alias("o"), e.col.alias("v")), n, not last))
        return F.transform(F.reverse(rows) if last else rows, lambda x: x["v"])

    def nth(self, value: Column, last: bool, order: Order | None = None) -> Column:
        order = default_order(self.ctx, order or self.order)
        key = rank_struct(self.ctx, order)
        if key is None:
            rows = self.listed(value, order)
            return F.try_element_at(rows, F.lit(-1)) if last else F.get(rows, F.lit(0))
        return self.over((F.max_by if last else F.min_by)(value, key))


def _top_k(c: Column, n: int, least: bool) -> Column:
    """The n least values upwards, or the n greatest downwards, by a queue of n."""
    return InternalFunction.collect_top_k(c, n, least)


def _by_key(x: Column, y: Column) -> Column:
    return F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)


_ACCUMULATORS: dict[str, Callable[[Call], Column]] = {}


def accumulator(name: str):
    """Register ``(call) -> Column``; also the way to add one's own."""

    def add(f):
        _ACCUMULATORS[name] = f
        return f

    return add


def accumulate(spec: dict[str, Any], ctx: Ctx, order: Order | None, over: Callable[[Column], Column] = lambda c: c) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ExpressionError("an accumulator is a document with one key")
    ((name, operand),) = spec.items()
    if name not in _ACCUMULATORS:
        raise ExpressionError(f"unknown accumulator {name}")
    return _ACCUMULATORS[name](Call(operand, ctx, order, over))


@accumulator("$sum")
def _sum(c: Call) -> Column:
    e = c.ex()
    if e.kind != "number":
        return F.lit(0) + c.over(F.count(F.lit(1))) * 0
    zero = F.lit(0).cast("double" if _floating(e.type) else "long")
    return F.coalesce(c.over(F.sum(e.col)), zero)


@accumulator("$avg")
def _avg(c: Call) -> Column:
    e = c.ex()
    return c.over(F.avg(e.col if e.kind == "number" else F.lit(None).cast("double")))


@accumulator("$count")
def _count(c: Call) -> Column:
    return c.over(F.count(F.lit(1)))


def _extreme(name, f):
    @accumulator(name)
    def g(c: Call) -> Column:
        e = c.ex()
        if _floating(e.type):  # NaN is the least number
            best = c.over(f(F.when(e.col.isNotNull(), F.struct((~F.isnan(e.col)).alias("n"), e.col.alias("v")))))
            return best["v"]
        return c.over(f(e.col))


_extreme("$min", F.min)
_extreme("$max", F.max)


@accumulator("$first")
def _first(c: Call) -> Column:
    return c.nth(c.ex().col, False)


@accumulator("$last")
def _last(c: Call) -> Column:
    return c.nth(c.ex().col, True)


@accumulator("$push")
def _push(c: Call) -> Column:
    return c.listed(c.ex().col)


@accumulator("$addToSet")
def _add_to_set(c: Call) -> Column:
    e = c.ex()
    found = F.transform(c.over(F.collect_set(F.struct(e.col.alias("v")))), lambda x: x["v"])
    return F.sort_array(found) if orderable(e.type) else found


@accumulator("$mergeObjects")
def _merge(c: Call) -> Column:
    e = c.ex()
    if isinstance(e.type, T.MapType):
        rows = F.filter(c.listed(e.col), lambda x: x.isNotNull())
        empty = F.create_map().cast(e.type)
        return F.aggregate(rows, empty, lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(x, k)), x))
    if not isinstance(e.type, T.StructType):
        raise ExpressionError("$mergeObjects takes documents")
    key = rank_struct(c.ctx, default_order(c.ctx, c.order))
    return F.struct(*[
        c.over(F.max_by(e.col.getField(f), F.when(e.col.isNotNull(), key))).alias(f) for f in e.type.fieldNames()
    ])


@accumulator("$stdDevPop")
def _std_pop(c: Call) -> Column:
    e = c.ex()
    return c.over(F.stddev_pop(e.col if e.kind == "number" else F.lit(None).cast("double")))


@accumulator("$stdDevSamp")
def _std_samp(c: Call) -> Column:
    e = c.ex()
    return c.over(F.stddev_samp(e.col if e.kind == "number" else F.lit(None).cast("double")))


def _number(node: Any, ctx: Ctx) -> int:
    e = compile_expr(node, ctx)
    if not e.is_const or not isinstance(e.const, int) or e.const < 1:
        raise ExpressionError("n must be a positive integer constant")
    return e.const


def _last_n(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, F.lit(n))


@accumulator("$firstN")
def _first_n(c: Call) -> Column:
    return c.ends(c.ex(c.operand["input"]), _number(c.operand["n"], c.ctx), False)


@accumulator("$lastN")
def _last_n_acc(c: Call) -> Column:
    return c.ends(c.ex(c.operand["input"]), _number(c.operand["n"], c.ctx), True)


def _ranked(name, asc):
    @accumulator(name)
    def g(c: Call) -> Column:
        e, n = c.ex(c.operand["input"]), _number(c.operand["n"], c.ctx)
        if not orderable(e.type):
            raise ExpressionError(f"{name} takes values that can be compared")
        parts = [(~F.isnan(e.col)).alias("n")] if _floating(e.type) else []  # NaN is the least number
        rows = c.over(_top_k(F.when(e.col.isNotNull(), F.struct(*parts, e.col.alias("v"))), n, asc))
        return F.transform(F.filter(rows, lambda x: x.isNotNull()), lambda x: x["v"])


_ranked("$minN", True)
_ranked("$maxN", False)


def _order_of(spec: dict[str, int]) -> Order:
    return [(k, 1 if v > 0 else -1) for k, v in spec.items()]


@accumulator("$top")
def _top(c: Call) -> Column:
    return c.nth(c.ex(c.operand["output"]).col, False, _order_of(c.operand["sortBy"]))


@accumulator("$bottom")
def _bottom(c: Call) -> Column:
    return c.nth(c.ex(c.operand["output"]).col, True, _order_of(c.operand["sortBy"]))


@accumulator("$topN")
def _top_n(c: Call) -> Column:
    return c.ends(c.ex(c.operand["output"]), _number(c.operand["n"], c.ctx), False, _order_of(c.operand["sortBy"]))


@accumulator("$bottomN")
def _bottom_n(c: Call) -> Column:
    return c.ends(c.ex(c.operand["output"]), _number(c.operand["n"], c.ctx), True, _order_of(c.operand["sortBy"]))


def _percentiles(c: Call, node: Any, ps: list[float]) -> list[Column]:
    """Values at rank ceil(p * n), NaN left out."""
    e = compile_expr(node, c.ctx)
    x = e.col.cast("double") if e.kind == "number" else F.lit(None).cast("double")
    ordered = F.sort_array(c.over(F.collect_list(F.when(~F.isnan(x), x))))
    return [rank_of(ordered, p) for p in ps]


@accumulator("$percentile")
def _percentile(c: Call) -> Column:
    return F.array(*_percentiles(c, c.operand["input"], c.operand["p"]))


@accumulator("$median")
def _median(c: Call) -> Column:
    return _percentiles(c, c.operand["input"], [0.5])[0]
