"""Update documents as column transforms."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, Ex, ExpressionError, compare, literal, path, wider
from ..plans.filters import _field, compile_filter, is_operators
from .rows import _with, set_fields

_PIPELINE = {"$addFields", "$set", "$project", "$unset", "$replaceRoot", "$replaceWith"}


def update_columns(df: DataFrame, filter_: dict[str, Any], update: dict[str, Any], array_filters: list[dict] | None = None, inserting: bool = False) -> dict[str, Column]:
    """New values of the top-level fields of rows that match; the filter is evaluated on the old row."""
    ctx = Ctx(df)
    values: dict[str, Ex] = {}
    marks = {next(iter(f)).split(".")[0]: f for f in array_filters or []}

    def current(name: str) -> Ex:
        head, *rest = name.split(".")
        e = values.get(head) or path(head, ctx)
        for part in rest:
            from ..functions.core import field_of

            e = field_of(e, part)
        return e

    def put(name: str, build) -> None:
        """``build`` makes the new value of a field from the old one."""
        head, *rest = name.split(".")
        base = values.get(head) or path(head, ctx)
        values[head] = Ex(_put(base, rest, build, filter_, marks, ctx, name), None, ctx)

    for op, spec in update.items():
        if op == "$setOnInsert":
            if inserting:
                for name, v in spec.items():
                    put(name, lambda old, v=v: literal(v, ctx))
            continue
        if op not in _UPDATES and op not in ("$unset", "$rename"):
            raise ExpressionError(f"unknown update operator {op}")
        for name, v in spec.items():
            if op == "$unset":
                put(name, lambda old: Ex(F.lit(None).cast(old.type) if old.kind != "null" else F.lit(None), old.type, ctx))
            elif op == "$rename":
                old = current(name)
                put(v, lambda _, old=old: old)
                put(name, lambda old: Ex(F.lit(None).cast(old.type), old.type, ctx))
            else:
                put(name, lambda old, v=v, op=op: _UPDATES[op](old, v, ctx))
    return {k: e.col for k, e in values.items()}


def _put(base: Ex, rest: list[str], build, filter_, marks, ctx: Ctx, name: str) -> Column:
    if not rest:
        return build(base).col
    head, *more = rest
    if head == "$[]" or head.startswith("$[") or head == "$":
        if not isinstance(base.type, T.ArrayType):
            raise ExpressionError(f"{name}: {head} needs an array")
        t = base.type.elementType

        def each(x: Column) -> Column:
            return _put(Ex(x, t, ctx), more, build, filter_, marks, ctx, name)

        if head == "$[]":
            return F.transform(base.col, each)
        if head == "$":  # the first element that the filter matched
            prefix = name[: name.index(".$")]
            tests = {k: v for k, v in filter_.items() if k == prefix or k.startswith(prefix + ".")}
            if not tests:
                raise ExpressionError(f"{name}: the filter has no condition on {prefix}")

            def hit(x: Column) -> Column:
                ok = F.lit(True)
                for k, v in tests.items():
                    e = Ex(x, t, ctx)
                    if k == prefix:
                        v = v["$elemMatch"] if isinstance(v, dict) and "$elemMatch" in v else v
                        if is_operators(v) or not isinstance(v, dict):
                            ok = ok & _field(e, v, ctx)
                        else:
                            ok = ok & _element(e, v, ctx)
                    else:
                        ok = ok & _element(e, {k[len(prefix) + 1 :]: v}, ctx)
                return ok

            flags = F.transform(base.col, lambda x: F.coalesce(hit(x), F.lit(False)))
            at = F.array_position(flags, True)
            return F.transform(base.col, lambda x, i: F.when(i + 1 == at, each(x)).otherwise(x))
        mark = head[2:-1]
        if mark not in marks:
            raise ExpressionError(f"no array filter for {mark}")
        test = {k[len(mark) + 1 :] if k != mark else "": v for k, v in marks[mark].items()}

        def chosen(x: Column) -> Column:
            e, ok = Ex(x, t, ctx), F.lit(True)
            for k, v in test.items():
                ok = ok & (_field(e, v, ctx) if k == "" else _element(e, {k: v}, ctx))
            return ok

        return F.transform(base.col, lambda x: F.when(chosen(x), each(x)).otherwise(x))
    if head.isdigit() and isinstance(base.type, T.ArrayType):
        t = base.type.elementType
        return F.transform(base.col, lambda x, i: F.when(i == int(head), _put(Ex(x, t, ctx), more, build, filter_, marks, ctx, name)).otherwise(x))
    if isinstance(base.type, T.StructType) and head in base.type.fieldNames():
        inner = Ex(base.col.getField(head), base.type[head].dataType, ctx)
        new = _put(inner, more, build, filter_, marks, ctx, name)
        return F.struct(*[(new if n == head else base.col.getField(n)).alias(n) for n in base.type.fieldNames()])
    return _with(base, rest, build(Ex(F.lit(None), T.NullType(), ctx)).col)


def _element(e: Ex, spec: dict[str, Any], ctx: Ctx) -> Column:
    from dataclasses import replace

    return compile_filter(spec, replace(ctx, root=e))


def _set(old, v, ctx):
    e = literal(v, ctx)
    return Ex(e.col.cast(old.type), old.type, ctx) if old.kind == e.kind == "number" and wider(old.type, e.type) == old.type else e


def _inc(old, v, ctx):
    e = literal(v, ctx)
    if old.kind == "null":
        return e
    t = old.type if isinstance(v, int) and not isinstance(old.type, T.DecimalType) else wider(old.type, e.type)
    return Ex(F.coalesce(old.col.cast(t), F.lit(0).cast(t)) + e.col.cast(t), None, ctx)


def _mul(old, v, ctx):
    e = literal(v, ctx)
    if old.kind == "null":
        return Ex(e.col * 0, None, ctx)
    t = old.type if isinstance(v, int) and not isinstance(old.type, T.DecimalType) else wider(old.type, e.type)
    return Ex(F.coalesce(old.col.cast(t), F.lit(0).cast(t)) * e.col.cast(t), None, ctx)


def _bounded(way):
    def f(old, v, ctx):
        e = literal(v, ctx)
        if old.kind == "null":
            return e
        better = compare(e, old, "lt") if way < 0 else compare(old, e, "lt")
        return Ex(F.when(old.col.isNull() | better, e.col).otherwise(old.col), None, ctx)

    return f


def _bit(old, v, ctx):
    c = F.coalesce(old.col, F.lit(0)) if old.kind != "null" else F.lit(0)
    for how, n in v.items():
        c = {"and": c.bitwiseAND, "or": c.bitwiseOR, "xor": c.bitwiseXOR}[how](F.lit(n))
    return Ex(c, None, ctx)


def _array_of(old: Ex, v: Any, ctx: Ctx) -> tuple[Column, Column]:
    """(old array, new elements); a missing field is an empty array."""
    items = v["$each"] if isinstance(v, dict) and "$each" in v else [v]
    if old.kind == "null":
        new = F.array(*[literal(x, ctx).col for x in items])
        return F.slice(new, 1, 0), new
    t = old.type
    new = F.array(*[literal(x, ctx).col for x in items]).cast(t) if items else F.array().cast(t)
    return F.coalesce(old.col, F.array().cast(t)), new


def _push(old, v, ctx):
    had, new = _array_of(old, v, ctx)
    how = v if isinstance(v, dict) and "$each" in v else {}
    if "$position" in how:
        p = how["$position"]
        at = F.lit(p) if p >= 0 else F.greatest(F.size(had) + p, F.lit(0))
        out = F.concat(F.slice(had, F.lit(1), at), new, F.slice(had, at + 1, F.greatest(F.size(had) - at, F.lit(0))))
    else:
        out = F.concat(had, new)
    if "$sort" in how:
        from ..functions.core import compile_expr

        by = how["$sort"]
        e = Ex(out, old.type if old.kind != "null" else None, ctx)
        out = F.sort_array(out, by > 0) if by in (1, -1) else compile_expr({"$sortArray": {"input": e.col, "sortBy": by}}, ctx).col
    if "$slice" in how:
        n = how["$slice"]
        out = F.slice(out, 1, n) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
    return Ex(out, None, ctx)


def _add_to_set(old, v, ctx):
    had, new = _array_of(old, v, ctx)
    fresh = F.filter(F.array_distinct(new), lambda x: ~F.exists(had, lambda y: y.eqNullSafe(x)))
    return Ex(F.concat(had, fresh), None, ctx)


def _pop(old, v, ctx):
    n = F.greatest(F.size(old.col) - 1, F.lit(0))
    return Ex(F.slice(old.col, F.lit(2 if v < 0 else 1), n), old.type, ctx)


def _pull(old, v, ctx):
    t = old.type.elementType
    if is_operators(v) or not isinstance(v, dict):
        return Ex(F.filter(old.col, lambda x: ~_field(Ex(x, t, ctx), v, ctx)), old.type, ctx)
    return Ex(F.filter(old.col, lambda x: ~_element(Ex(x, t, ctx), v, ctx)), old.type, ctx)


def _pull_all(old, v, ctx):
    drop = F.array(*[literal(x, ctx).col for x in v]).cast(old.type)
    return Ex(F.filter(old.col, lambda x: ~F.exists(drop, lambda y: y.eqNullSafe(x))), old.type, ctx)


_UPDATES = {
    "$set": _set, "$inc": _inc, "$mul": _mul, "$min": _bounded(-1), "$max": _bounded(1), "$bit": _bit, "$push": _push,
    "$currentDate": lambda old, v, ctx: Ex(F.current_timestamp(), T.TimestampType(), ctx),
    "$addToSet": _add_to_set, "$pop": _pop, "$pull": _pull, "$pullAll": _pull_all,
}


def update(df: DataFrame, filter_: dict[str, Any], change: Any, multi: bool = True, upsert: bool = False, array_filters: list[dict] | None = None, sort: dict | None = None) -> DataFrame:
    """The collection after the update. Without ``multi`` the first match (by ``sort``, else ``_id``) changes."""
    hit = compile_filter(filter_, Ctx(df))
    rows = df.withColumn("__hit", hit)
    if not multi:
        from pyspark.sql import Window

        from .accumulators import default_order, sort_keys

        ctx = Ctx(df)
        keys = sort_keys(ctx, default_order(ctx, [(k, v) for k, v in (sort or {}).items()] or None))
        first = df.filter(hit).orderBy(*keys).limit(1)
        if "_id" in df.columns:
            first = first.select(F.col("_id").alias("__first"))
            rows = rows.join(F.broadcast(first), F.col("_id").eqNullSafe(F.col("__first")), "left")  # one row
            rows = rows.withColumn("__hit", F.col("__hit") & F.col("__first").isNotNull()).drop("__first")
        else:
            place = F.row_number().over(Window.partitionBy("__hit").orderBy(*keys))
            rows = rows.withColumn("__hit", F.col("__hit") & (place == 1))
    if isinstance(change, list):
        from ..plans.pipeline import Pipeline

        if any(next(iter(s)) not in _PIPELINE for s in change):
            raise ExpressionError("this stage is not allowed in an update")
        new = Pipeline(df.sparkSession).run(rows.filter("__hit").drop("__hit"), change)
        out = rows.filter(~F.col("__hit")).drop("__hit").unionByName(new, allowMissingColumns=True)
    elif is_operators(change):
        values = update_columns(df, filter_, change, array_filters)
        new = {}
        for name, col in values.items():
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            new[name] = F.when(F.col("__hit"), col).otherwise(old)
        out = set_fields(rows, new).drop("__hit")
    else:  # a replacement keeps the id
        ctx = Ctx(df)
        fixed = {k: literal(v, ctx).col for k, v in change.items() if k != "_id"}
        new = {}
        for name in dict.fromkeys([*df.columns, *fixed]):
            if name == "_id":
                continue
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            new[name] = F.when(F.col("__hit"), fixed.get(name, F.lit(None))).otherwise(old)
        out = set_fields(rows, new).drop("__hit")
    if upsert and df.filter(hit).isEmpty():
        out = df.unionByName(seed(df, filter_, change), allowMissingColumns=True)
    return out


def seed(df: DataFrame, filter_: dict[str, Any], change: Any) -> DataFrame:
    """The document that an upsert inserts: the filter's equalities, then the update."""
    base: dict[str, Any] = {}
    for k, v in filter_.items():
        if k == "$and":
            for x in v:
                base |= {a: b for a, b in x.items() if not is_operators(b) and not a.startswith("$")}
        elif not k.startswith("$"):
            if not is_operators(v):
                base[k] = v
            elif "$eq" in v:
                base[k] = v["$eq"]
    one = df.sparkSession.range(1)
    ctx = Ctx(one)
    cols = [literal(v, ctx).col.cast(df.schema[k].dataType if k in df.columns else literal(v, ctx).type).alias(k) for k, v in base.items() if "." not in k]
    cols += [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in base]
    row = one.select(*cols)
    if isinstance(change, list):
        from ..plans.pipeline import Pipeline

        return Pipeline(df.sparkSession).run(row, change)
    if is_operators(change):
        return set_fields(row, update_columns(row, filter_, change, inserting=True))
    return set_fields(row, {k: literal(v, Ctx(row)).col for k, v in change.items()})


def delete(df: DataFrame, filter_: dict[str, Any], limit: int = 0) -> DataFrame:
    """The collection without the matches (all, or the first by ``_id``)."""
    hit = compile_filter(filter_, Ctx(df))
    if not limit:
        return df.filter(~hit)
    first = df.filter(hit).orderBy("_id").limit(1).select(F.col("_id").alias("__first"))
    return df.join(F.broadcast(first), F.col("_id").eqNullSafe(F.col("__first")), "left_anti")
