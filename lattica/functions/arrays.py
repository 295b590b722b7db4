"""Array and set operators, and accumulators over one row's operands."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import Ctx, Ex, ExpressionError, compare, compile_expr, element_type, expression, guard, literal, operands, scoped, truthy

_D, _L, _B, _I = T.DoubleType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _null(ctx: Ctx) -> Ex:
    return Ex(F.lit(None), T.NullType(), ctx)


def _one_array(node, ctx, name):
    """An operand that is an array, given bare or as the only member of a list."""
    if isinstance(node, list) and len(node) == 1:
        node = node[0]
    return compile_expr(node, ctx)


@expression("$size")
def _size(node, ctx):
    e = _one_array(node, ctx, "$size")
    return Ex(guard(e.col.isNotNull(), F.size(e.col), "$size requires an array"), _I, ctx)


@expression("$arrayElemAt")
def _elem_at(node, ctx):
    a, i = operands(node, ctx, 2, 2, "$arrayElemAt")
    if a.kind == "null":
        return a
    at = F.when(i.col < 0, F.size(a.col) + i.col).otherwise(i.col).cast("int")
    return Ex(F.get(a.col, at), element_type(a, "$arrayElemAt"), ctx)


@expression("$first")
def _first(node, ctx):
    e = _one_array(node, ctx, "$first")
    return Ex(F.get(e.col, F.lit(0)), element_type(e, "$first"), ctx) if e.kind != "null" else e


@expression("$last")
def _last(node, ctx):
    e = _one_array(node, ctx, "$last")
    return Ex(F.try_element_at(e.col, F.lit(-1)), element_type(e, "$last"), ctx) if e.kind != "null" else e


def sort_asc(col):
    """Ascending with nulls first, the order of values."""
    return F.sort_array(col)


def _n(name, build):
    @expression(name)
    def f(node, ctx):
        a, n = compile_expr(node["input"], ctx), compile_expr(node["n"], ctx)
        if n.is_const and (not isinstance(n.const, int) or n.const < 1):
            raise ExpressionError(f"{name}: n must be a positive integer")
        return Ex(build(a.col, n.col.cast("int")), a.type, ctx)


_n("$firstN", lambda a, n: F.slice(a, F.lit(1), n))
_n("$lastN", lambda a, n: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n))
_n("$minN", lambda a, n: F.slice(F.sort_array(F.filter(a, lambda x: x.isNotNull())), F.lit(1), n))
_n("$maxN", lambda a, n: F.slice(F.sort_array(F.filter(a, lambda x: x.isNotNull()), False), F.lit(1), n))


@expression("$concatArrays")
def _concat_arrays(node, ctx):
    es = operands(node, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    return ctx.ex(F.concat(*[e.col for e in es]))


@expression("$in")
def _in(node, ctx):
    v, a = operands(node, ctx, 2, 2, "$in")
    et = element_type(a, "$in")
    return Ex(F.coalesce(F.exists(a.col, lambda x: compare(Ex(x, et, ctx), Ex(v.col, v.type, ctx), "eq")), F.lit(False)), _B, ctx)


@expression("$indexOfArray")
def _index_of(node, ctx):
    es = operands(node, ctx, 2, 4, "$indexOfArray")
    a, v = es[0], es[1]
    if a.kind == "null":
        return a
    start = es[2].col.cast("int") if len(es) > 2 else F.lit(0)
    end = es[3].col.cast("int") if len(es) > 3 else F.size(a.col)
    places = F.transform(a.col, lambda x, i: F.when(x.eqNullSafe(v.col) & (i >= start) & (i < end), i))
    return Ex(F.when(a.col.isNotNull(), F.coalesce(F.array_min(places), F.lit(-1))), _I, ctx)


@expression("$reverseArray")
def _reverse(node, ctx):
    e = _one_array(node, ctx, "$reverseArray")
    return Ex(F.reverse(e.col), e.type, ctx) if e.kind != "null" else e


@expression("$slice")
def _slice(node, ctx):
    es = operands(node, ctx, 2, 3, "$slice")
    a = es[0]
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    size = F.size(a.col)
    if len(es) == 2:
        n = es[1].col.cast("int")
        out = F.when(n >= 0, F.slice(a.col, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(
            F.slice(a.col, F.greatest(size + n, F.lit(0)) + 1, F.greatest(-n, F.lit(0)))
        )
    else:
        p, n = es[1].col.cast("int"), es[2].col.cast("int")
        at = F.when(p < 0, F.greatest(size + p, F.lit(0))).otherwise(p)
        out = guard(n > 0, F.slice(a.col, at + 1, F.greatest(n, F.lit(0))), "$slice: the third operand must be positive")
    return Ex(out, a.type, ctx)


@expression("$range")
def _range(node, ctx):
    es = operands(node, ctx, 2, 3, "$range")
    a, b = es[0].col.cast("int"), es[1].col.cast("int")
    step = es[2].col.cast("int") if len(es) > 2 else F.lit(1)
    if len(es) > 2 and es[2].is_const and es[2].const == 0:
        raise ExpressionError("$range: the step must not be 0")
    some = ((step > 0) & (a < b)) | ((step < 0) & (a > b))
    full = F.sequence(a, F.when(step > 0, b - 1).otherwise(b + 1), step)
    return Ex(F.when(some, full).otherwise(F.array().cast("array<int>")), T.ArrayType(_I), ctx)


@expression("$map")
def _map(node, ctx):
    a = compile_expr(node["input"], ctx)
    if a.kind == "null":
        return a
    name = node.get("as", "this")
    out, build = scoped(ctx, node["in"], {name: element_type(a, "$map")})
    return Ex(F.transform(a.col, lambda x: build(**{name: x})), T.ArrayType(out), ctx)


@expression("$filter")
def _filter(node, ctx):
    a = compile_expr(node["input"], ctx)
    if a.kind == "null":
        return a
    name, et = node.get("as", "this"), element_type(a, "$filter")
    out, build = scoped(ctx, node["cond"], {name: et})
    kept = F.filter(a.col, lambda x: truthy(Ex(build(**{name: x}), out, ctx)))
    if node.get("limit") is not None:
        kept = F.slice(kept, F.lit(1), compile_expr(node["limit"], ctx).col.cast("int"))
    return Ex(kept, a.type, ctx)


@expression("$reduce")
def _reduce(node, ctx):
    a, zero = compile_expr(node["input"], ctx), compile_expr(node["initialValue"], ctx)
    if a.kind == "null":
        return a
    et = element_type(a, "$reduce")
    # the accumulator takes the type that the body gives it
    t = zero.type
    for _ in range(2):
        out, build = scoped(ctx, node["in"], {"value": t, "this": et})
        if out == t:
            break
        t = out
    start = zero.col.cast(t) if not isinstance(t, T.NullType) else zero.col
    return Ex(F.aggregate(a.col, start, lambda acc, x: build(value=acc, this=x).cast(t)), t, ctx)


@expression("$zip")
def _zip(node, ctx):
    es = [compile_expr(x, ctx) for x in node["inputs"]]
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    sizes = [F.size(e.col) for e in es]
    longest = node.get("useLongestLength", False)
    n = (F.greatest if longest else F.least)(*sizes) if len(es) > 1 else sizes[0]
    fill = [literal(d, ctx).col for d in node.get("defaults", [])] or [F.lit(None)] * len(es)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def row(i):
        return F.array(*[F.when(i < s, F.get(e.col, i)).otherwise(d) for e, s, d in zip(es, sizes, fill, strict=True)])

    missing = es[0].col.isNull()
    for e in es[1:]:
        missing = missing | e.col.isNull()
    return ctx.ex(F.when(~missing, F.transform(index, row)))


@expression("$sortArray")
def _sort_array(node, ctx):
    a, by = compile_expr(node["input"], ctx), node["sortBy"]
    if a.kind == "null":
        return a
    if by in (1, -1):
        return Ex(F.sort_array(a.col, by == 1), a.type, ctx)
    et = element_type(a, "$sortArray")

    def order(x, y):
        out = F.lit(0)
        for path, way in reversed(by.items()):
            p, q = Ex(x, et, ctx), Ex(y, et, ctx)
            for part in path.split("."):
                p, q = Ex(p.col.getField(part), p.type[part].dataType, ctx), Ex(q.col.getField(part), q.type[part].dataType, ctx)
            out = F.when(compare(p, q, "lt"), -way).when(compare(q, p, "lt"), way).otherwise(out)
        return out

    return Ex(F.array_sort(a.col, order), a.type, ctx)


@expression("$allElementsTrue")
def _all_true(node, ctx):
    e = _one_array(node, ctx, "$allElementsTrue")
    et = element_type(e, "$allElementsTrue")
    return Ex(F.forall(e.col, lambda x: truthy(Ex(x, et, ctx))), _B, ctx)


@expression("$anyElementTrue")
def _any_true(node, ctx):
    e = _one_array(node, ctx, "$anyElementTrue")
    et = element_type(e, "$anyElementTrue")
    return Ex(F.exists(e.col, lambda x: truthy(Ex(x, et, ctx))), _B, ctx)


# sets


@expression("$setUnion")
def _set_union(node, ctx):
    es = operands(node, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    return ctx.ex(F.array_distinct(F.concat(*[e.col for e in es])))


@expression("$setIntersection")
def _set_intersection(node, ctx):
    es = operands(node, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    out = F.array_distinct(es[0].col)
    for e in es[1:]:
        out = F.array_intersect(out, e.col)
    return ctx.ex(out)


@expression("$setDifference")
def _set_difference(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$setDifference")
    return _null(ctx) if "null" in (a.kind, b.kind) else ctx.ex(F.array_except(a.col, b.col))


@expression("$setEquals")
def _set_equals(node, ctx):
    es = operands(node, ctx, 2, None, "$setEquals")
    out = F.lit(True)
    for e in es[1:]:
        out = out & (F.size(F.array_except(es[0].col, e.col)) == 0) & (F.size(F.array_except(e.col, es[0].col)) == 0)
    return Ex(out, _B, ctx)


@expression("$setIsSubset")
def _set_is_subset(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$setIsSubset")
    return Ex(F.size(F.array_except(a.col, b.col)) == 0, _B, ctx)


# accumulators over the operands of one row


def _values(node, ctx) -> Ex:
    """The operands as one array: a single array operand stands for its elements."""
    if isinstance(node, list) and len(node) != 1:
        es = [compile_expr(x, ctx) for x in node]
        es = [e for e in es if e.kind != "null"] or es
        return ctx.ex(F.array(*[e.col for e in es]))
    e = compile_expr(node[0] if isinstance(node, list) else node, ctx)
    return e if isinstance(e.type, T.ArrayType) else Ex(F.array(e.col), T.ArrayType(e.type), ctx)


def _numbers(node, ctx):
    e = _values(node, ctx)
    et = e.type.elementType
    if not isinstance(et, T.NumericType):
        return F.array().cast("array<double>"), _D
    return F.coalesce(F.filter(e.col, lambda x: x.isNotNull()), F.array().cast(T.ArrayType(et))), et


@expression("$sum")
def _sum(node, ctx):
    a, et = _numbers(node, ctx)
    t = _L if isinstance(et, T.IntegralType) else et
    return Ex(F.aggregate(a, F.lit(0).cast(t), lambda acc, x: (acc + x.cast(t)).cast(t)), t, ctx)


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.nullif(F.size(a), F.lit(0)).cast("double")


@expression("$avg")
def _avg(node, ctx):
    a, _ = _numbers(node, ctx)
    return Ex(_mean(a), _D, ctx)


@expression("$min")
def _min(node, ctx):
    e = _values(node, ctx)
    return Ex(F.array_min(e.col), e.type.elementType, ctx)


@expression("$max")
def _max(node, ctx):
    e = _values(node, ctx)
    return Ex(F.array_max(e.col), e.type.elementType, ctx)


def _deviation(a, less):
    m = _mean(a)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - m) * (x.cast("double") - m))
    return F.when(F.size(a) > less, F.sqrt(total / (F.size(a) - less)))


@expression("$stdDevPop")
def _std_pop(node, ctx):
    return Ex(_deviation(_numbers(node, ctx)[0], 0), _D, ctx)


@expression("$stdDevSamp")
def _std_samp(node, ctx):
    return Ex(_deviation(_numbers(node, ctx)[0], 1), _D, ctx)


def rank_of(array, p):
    """The element at rank ceil(p * n) of a sorted array."""
    n = F.size(array)
    return F.get(array, F.greatest(F.ceil(F.lit(float(p)) * n).cast("int"), F.lit(1)) - 1)


@expression("$percentile")
def _percentile(node, ctx):
    a, _ = _numbers(node["input"], ctx)
    ordered = F.sort_array(F.filter(F.transform(a, lambda x: x.cast("double")), lambda x: ~F.isnan(x)))
    return Ex(F.array(*[rank_of(ordered, p) for p in node["p"]]), T.ArrayType(_D), ctx)


@expression("$median")
def _median(node, ctx):
    a, _ = _numbers(node["input"], ctx)
    ordered = F.sort_array(F.filter(F.transform(a, lambda x: x.cast("double")), lambda x: ~F.isnan(x)))
    return Ex(rank_of(ordered, 0.5), _D, ctx)
