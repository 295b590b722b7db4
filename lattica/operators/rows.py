"""Row-wise stages: projections, added and removed fields, unwinding, replacing, redacting."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, Ex, ExpressionError, compile_expr, path, root_of


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _with(e: Ex, parts: list[str], value: Column) -> Column:
    """A value with a nested field set; documents that are missing on the way are made."""
    name, *rest = parts
    if isinstance(e.type, T.ArrayType):
        t = e.type.elementType
        return F.transform(e.col, lambda x: _with(Ex(x, t, e.ctx), parts, value))
    if isinstance(e.type, T.StructType):
        names = e.type.fieldNames()
        old = Ex(e.col.getField(name), e.type[name].dataType, e.ctx) if name in names else Ex(F.lit(None), T.NullType(), e.ctx)
        new = _with(old, rest, value) if rest else value
        cols = [(new if n == name else e.col.getField(n)).alias(n) for n in names]
        return F.struct(*cols) if name in names else F.struct(*cols, new.alias(name))
    out = value
    for n in reversed(parts):
        out = F.struct(out.alias(n))
    return out


def set_fields(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """All values are of the input row; dotted names set nested fields."""
    ctx = Ctx(df)
    out: dict[str, Column] = {}
    for name, value in values.items():
        head, *rest = name.split(".")
        if rest:
            base = Ex(out[head], None, ctx) if head in out else path(head, ctx)
            value = _with(base, rest, value)
        out[head] = value
    return df.withColumns(out)


def add_fields(df: DataFrame, spec: dict[str, Any], ctx: Ctx | None = None) -> DataFrame:
    ctx = ctx or Ctx(df)
    flat: dict[str, Any] = {}

    def walk(prefix: str, node: dict[str, Any]) -> None:
        for k, v in node.items():
            name = f"{prefix}.{k}" if prefix else k
            if prefix == "" and isinstance(v, dict) and v and not next(iter(v)).startswith("$") and isinstance(path(k, ctx).type, T.StructType):
                walk(name, v)
            else:
                flat[name] = v

    walk("", spec)
    removed = [k for k, v in flat.items() if v == "$$REMOVE"]
    df = set_fields(df, {k: compile_expr(v, ctx).col for k, v in flat.items() if v != "$$REMOVE"})
    return unset(df, removed) if removed else df


def _without(e: Ex, parts: list[str]) -> Column:
    if isinstance(e.type, T.ArrayType):
        t = e.type.elementType
        return F.transform(e.col, lambda x: _without(Ex(x, t, e.ctx), parts))
    if not isinstance(e.type, T.StructType) or parts[0] not in e.type.fieldNames():
        return e.col
    name, *rest = parts
    cols = []
    for n in e.type.fieldNames():
        inner = Ex(e.col.getField(n), e.type[n].dataType, e.ctx)
        if n != name:
            cols.append(inner.col.alias(n))
        elif rest:
            cols.append(_without(inner, rest).alias(n))
    return F.when(e.col.isNotNull(), F.struct(*cols))


def unset(df: DataFrame, names: list[str] | str) -> DataFrame:
    for name in [names] if isinstance(names, str) else names:
        head, *rest = name.split(".")
        if head in df.columns:
            df = df.withColumn(head, _without(path(head, Ctx(df)), rest)) if rest else df.drop(head)
    return df


def _tree(spec: dict[str, Any]) -> dict[str, Any]:
    """Dotted names and nested documents as one tree; leaves are flags or expressions."""
    out: dict[str, Any] = {}
    for key, v in spec.items():
        at = out
        *way, last = key.split(".")
        for part in way:
            at = at.setdefault(part, {})
        nested = isinstance(v, dict) and v and not any(k.startswith("$") for k in v)
        at[last] = _tree(v) if nested else ("leaf", v)
    return out


def _flag(v: Any) -> bool:
    return isinstance(v, (bool, int, float))


def _included(e: Ex, tree: dict[str, Any], ctx: Ctx) -> Column:
    if isinstance(e.type, T.ArrayType):
        t = e.type.elementType
        return F.transform(e.col, lambda x: _included(Ex(x, t, ctx), tree, ctx))
    cols = []
    names = e.type.fieldNames() if isinstance(e.type, T.StructType) else []
    for n in names:
        inner = Ex(e.col.getField(n), e.type[n].dataType, ctx)
        if n in tree and isinstance(tree[n], dict):
            cols.append(_included(inner, tree[n], ctx).alias(n))
        elif n in tree and _flag(tree[n][1]) and tree[n][1]:
            cols.append(inner.col.alias(n))
    for n, v in tree.items():
        if isinstance(v, tuple) and not _flag(v[1]):
            cols.append(compile_expr(v[1], ctx).col.alias(n))
        elif isinstance(v, dict) and n not in names:
            cols.append(_included(Ex(F.lit(None), T.NullType(), ctx), v, ctx).alias(n))
    return F.struct(*cols)


def project(df: DataFrame, spec: dict[str, Any], ctx: Ctx | None = None) -> DataFrame:
    """Inclusion (with computed fields) or exclusion; ``_id`` stays unless it is excluded."""
    if not spec:
        raise ExpressionError("a projection must not be empty")
    ctx = ctx or Ctx(df)
    tree = _tree(spec)

    def leaves(t: dict[str, Any]):
        for v in t.values():
            yield from leaves(v) if isinstance(v, dict) else [v[1]]

    plain = [v for k, t in tree.items() if k != "_id" for v in (leaves(t) if isinstance(t, dict) else [t[1]])]
    off = [v for v in plain if _flag(v) and not v]
    if off and len(off) < len([v for v in plain if _flag(v)]):
        raise ExpressionError("inclusion and exclusion cannot be mixed")
    excluding = bool(off) or not plain and isinstance(tree.get("_id"), tuple) and _flag(tree["_id"][1]) and not tree["_id"][1]
    if excluding:
        names = []

        def walk(prefix: str, t: dict[str, Any]) -> None:
            for k, v in t.items():
                name = f"{prefix}{k}"
                if isinstance(v, dict):
                    walk(name + ".", v)
                elif not v[1]:
                    names.append(name)

        walk("", tree)
        return unset(df, names)
    if "_id" in df.columns and "_id" not in tree:
        tree = {"_id": ("leaf", 1)} | tree
    cols = []
    for n in df.columns:
        if n.startswith("__"):
            cols.append(_q(n))
        elif n in tree:
            v = tree[n]
            if isinstance(v, dict):
                cols.append(_included(path(n, ctx), v, ctx).alias(n))
            elif _flag(v[1]) and v[1]:
                cols.append(_q(n))
    for n, v in tree.items():
        if isinstance(v, tuple) and not _flag(v[1]) and v[1] != "$$REMOVE":
            cols.append(compile_expr(v[1], ctx).col.alias(n))
        elif isinstance(v, dict) and n not in df.columns:
            cols.append(_included(Ex(F.lit(None), T.NullType(), ctx), v, ctx).alias(n))
    return df.select(*cols)


def replace_root(df: DataFrame, node: Any, ctx: Ctx | None = None) -> DataFrame:
    e = compile_expr(node, ctx or Ctx(df))
    if not isinstance(e.type, T.StructType):
        raise ExpressionError("a new root must be a document")
    kept = [_q(c) for c in df.columns if c.startswith("__")]
    rows = df.select(*kept, e.col.alias("__root"))
    rows = rows.withColumn("__root", F.when(F.col("__root").isNull(), F.raise_error(F.lit("a new root must be a document"))).otherwise(F.col("__root")))
    return rows.select(*kept, *[F.col("__root").getField(f).alias(f) for f in e.type.fieldNames()])


def unwind(df: DataFrame, spec: Any) -> DataFrame:
    """One row for each element. Rows without elements go unless they are to be preserved."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    name = spec["path"].removeprefix("$")
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    e = path(name, Ctx(df))
    if not isinstance(e.type, T.ArrayType):
        df = df if keep else df.filter(e.col.isNotNull())
        return set_fields(df, {index: F.lit(None).cast("long")}) if index else df
    rows = df.select(*[_q(c) for c in df.columns], (F.posexplode_outer if keep else F.posexplode)(e.col).alias("__pos", "__value"))
    values = {name: F.col("__value")}
    if index:
        values[index] = F.col("__pos").cast("long")
    return set_fields(rows, values).drop("__pos", "__value")


def redact(df: DataFrame, node: Any) -> DataFrame:
    """Keep, prune or descend, level by level along the static schema."""
    ctx = Ctx(df)

    def walk(e: Ex) -> Column:
        """The value after redaction, null where it is pruned."""
        from dataclasses import replace

        if isinstance(e.type, T.ArrayType) and isinstance(e.type.elementType, (T.StructType, T.ArrayType)):
            t = e.type.elementType
            return F.filter(F.transform(e.col, lambda x: walk(Ex(x, t, ctx))), lambda x: x.isNotNull())
        if not isinstance(e.type, T.StructType):
            return e.col
        verdict = compile_expr(node, replace(ctx, root=e)).col
        cols = [walk(Ex(e.col.getField(f.name), f.dataType, ctx)).alias(f.name) for f in e.type.fields]
        return F.when(verdict == "KEEP", e.col).when(verdict == "DESCEND", F.struct(*cols))

    rows = df.select(walk(root_of(ctx)).alias("__root")).filter("__root is not null")
    return rows.select(*[F.col("__root").getField(c).alias(c) for c in df.columns])
