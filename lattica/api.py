"""find, aggregate, count, distinct and the writes over named collections."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.core import Ctx, Ex, ExpressionError, path
from .operators import geo, rows, updates
from .operators.accumulators import sort_keys
from .plans.filters import _field, compile_filter, is_operators
from .plans.pipeline import Pipeline
from .sources import files
from .sources.store import Store


def find(
    df: DataFrame, filter: dict[str, Any] | None = None, projection: dict[str, Any] | None = None, sort: dict[str, int] | None = None,
    skip: int = 0, limit: int = 0, min: dict[str, Any] | None = None, max: dict[str, Any] | None = None,
) -> DataFrame:
    """Filter, bounds, sort, skip, limit and projection, in this order."""
    filter = filter or {}
    out = df.filter(compile_filter(filter, Ctx(df))) if filter else df
    for bound, upper in ((min, False), (max, True)):
        if bound:
            out = out.filter(_bound(out, bound, upper))
    if sort:
        if "$natural" in sort:
            out = out.orderBy(F.col("_id").asc() if sort["$natural"] > 0 else F.col("_id").desc())
        else:
            if any(isinstance(v, dict) for v in sort.values()):
                raise ExpressionError("a sort by $meta is not offered: texts have no score")
            keys = [(k, 1 if v > 0 else -1) for k, v in sort.items()]
            if "_id" in df.columns and "_id" not in sort:
                keys.append(("_id", 1))
            out = out.orderBy(*sort_keys(Ctx(out), keys))
    else:
        near = geo.near_order(df, filter)
        if near is not None:
            out = out.orderBy(near)
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(abs(limit))
    return find_projection(out, projection, filter) if projection else out


def _bound(df: DataFrame, spec: dict[str, Any], upper: bool):
    """Lexicographic bounds: the lower one inclusive, the upper one exclusive."""
    names = list(spec)
    left = F.struct(*[F.col(f"`{n}`") for n in names])
    right = F.struct(*[F.lit(v).cast(df.schema[n].dataType).alias(n) for n, v in spec.items()])
    return left < right if upper else left >= right


def find_projection(df: DataFrame, spec: dict[str, Any], filter: dict[str, Any]) -> DataFrame:
    """A projection with $slice, $elemMatch and the positional operator beside the common forms."""
    ctx = Ctx(df)
    values, plain = {}, {}
    for name, v in spec.items():
        if name.endswith(".$"):
            name = name[:-2]
            e, test = path(name, ctx), filter.get(name)
            values[name] = _first_match(e, test, ctx, {k[len(name) + 1 :]: x for k, x in filter.items() if k.startswith(name + ".")})
            plain[name] = 1
        elif isinstance(v, dict) and "$slice" in v:
            n = v["$slice"]
            e = path(name, ctx)
            if isinstance(n, (list, tuple)):
                at = F.lit(n[0]) if n[0] >= 0 else F.greatest(F.size(e.col) + n[0], F.lit(0))
                values[name] = F.slice(e.col, at + 1, F.lit(n[1]))
            else:
                values[name] = F.slice(e.col, 1, n) if n >= 0 else F.slice(e.col, F.greatest(F.size(e.col) + n, F.lit(0)) + 1, F.lit(-n))
        elif isinstance(v, dict) and "$elemMatch" in v:
            e = path(name, ctx)
            values[name] = _first_match(e, v, ctx, {})
            plain[name] = 1
        else:
            plain[name] = v
    sliced = [n for n in values if n not in plain]
    if values:
        df = rows.set_fields(df, values)
    if not plain:
        return df
    if any(v not in (0, False) for k, v in plain.items() if k != "_id"):
        plain |= {n: 1 for n in sliced}
    return rows.project(df, plain)


def _first_match(e: Ex, test: Any, ctx: Ctx, nested: dict[str, Any]):
    from dataclasses import replace

    if not isinstance(e.type, T.ArrayType):
        return F.lit(None)
    t = e.type.elementType
    if isinstance(test, dict) and "$elemMatch" in test:
        test = test["$elemMatch"]

    def hit(x):
        ok = F.lit(True)
        if test is not None:
            plain = is_operators(test) or not isinstance(test, dict)
            ok = ok & (_field(Ex(x, t, ctx), test, ctx) if plain else compile_filter(test, replace(ctx, root=Ex(x, t, ctx))))
        if nested:
            ok = ok & compile_filter(nested, replace(ctx, root=Ex(x, t, ctx)))
        return ok

    found = F.slice(F.filter(e.col, hit), 1, 1)
    return F.when(F.size(found) > 0, found)


def aggregate(df: DataFrame | None, pipeline: list[dict[str, Any]], collections: Mapping[str, DataFrame] | None = None, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or (df.sparkSession if df is not None else SparkSession.active())
    store = collections if isinstance(collections, Store) else None
    return Pipeline(spark, collections, store.save if store else None, store.merge if store else None).run(df, pipeline)


def count(df: DataFrame, filter: dict[str, Any] | None = None, skip: int = 0, limit: int = 0) -> int:
    return find(df, filter, skip=skip, limit=limit).count()


def distinct(df: DataFrame, key: str, filter: dict[str, Any] | None = None) -> DataFrame:
    """Distinct values of a field in order; arrays count by element."""
    df = df.filter(compile_filter(filter, Ctx(df))) if filter else df
    e = path(key, Ctx(df))
    if isinstance(e.type, T.ArrayType):
        out = df.select(F.explode(e.col).alias("value"))
    else:
        out = df.select(e.col.alias("value"))
    return out.filter("value is not null").distinct().orderBy("value")


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows that both have; with ``all`` as often as the one that has them less often."""
    return a.intersectAll(b) if all else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows of the first that the second has not; with ``all`` as often as the first has them more often."""
    return a.exceptAll(b) if all else a.subtract(b)


class Database:
    """Commands over a store: each write reads a collection, transforms it and replaces it."""

    def __init__(self, spark: SparkSession, root: str, views: dict[str, tuple[str, list]] | None = None):
        self.spark, self.store = spark, Store(spark, root)
        kept = files.read_text(spark, f"{root}/.views.json")
        self.views: dict[str, tuple[str, list]] = ({k: tuple(v) for k, v in json.loads(kept).items()} if kept else {}) | dict(views or {})

    def __getitem__(self, name: str) -> DataFrame:
        depth, stages = 0, []
        while name in self.views:
            name, own = self.views[name]
            stages = [*own, *stages]
            depth += 1
            if depth > 20:
                raise ValueError("views are nested too deeply or in a circle")
        df = self.store[name]
        return aggregate(df, stages, self.store) if stages else df

    def create_view(self, name: str, on: str, pipeline: list[dict[str, Any]]) -> None:
        at = on
        while at in self.views:
            if at == name:
                raise ValueError("a view must not depend on itself")
            at = self.views[at][0]
        if at == name:
            raise ValueError("a view must not depend on itself")
        self.views[name] = (on, pipeline)
        files.write_text(self.spark, f"{self.store.root}/.views.json", json.dumps(self.views, default=str))

    def drop_view(self, name: str) -> None:
        del self.views[name]
        files.write_text(self.spark, f"{self.store.root}/.views.json", json.dumps(self.views, default=str))

    def insert(self, name: str, docs: list[dict[str, Any]] | DataFrame, ordered: bool = True, validator: dict[str, Any] | None = None) -> None:
        df = docs if isinstance(docs, DataFrame) else Pipeline(self.spark).documents(docs)
        if validator and not df.filter(~compile_filter(validator, Ctx(df))).isEmpty():
            raise ValueError("a document failed validation")
        self.store.insert(name, df, ordered)

    def find(self, name: str, *args: Any, **kw: Any) -> DataFrame:
        return find(self[name], *args, **kw)

    def aggregate(self, name: str, pipeline: list[dict[str, Any]]) -> DataFrame:
        return aggregate(self[name], pipeline, self.store)

    def update(self, name: str, filter: dict[str, Any], change: Any, **kw: Any) -> None:
        self.store.save(name, updates.update(self.store[name], filter, change, **kw))

    def delete(self, name: str, filter: dict[str, Any], limit: int = 0) -> None:
        self.store.save(name, updates.delete(self.store[name], filter, limit))

    def find_and_modify(self, name: str, filter: dict[str, Any], change: Any = None, remove: bool = False, new: bool = False, sort: dict | None = None, upsert: bool = False):
        """The document before (or after) the change, as a row."""
        df = self.store[name]
        before = find(df, filter, sort=sort, limit=1).first()
        if remove:
            if before is not None:
                self.delete(name, {"_id": before["_id"]})
            return before
        if before is None and not upsert:
            return None
        target = {**filter, "_id": before["_id"]} if before is not None else filter
        self.update(name, target, change, multi=False, upsert=upsert)
        if not new:
            return before
        return find(self.store[name], {"_id": before["_id"]} if before is not None else filter, limit=1).first()

    def bulk_write(self, name: str, operations: list[dict[str, Any]], ordered: bool = True) -> dict[str, Any]:
        """Operations applied in order to one plan, which is written once; the counts and errors of all.

        An insert whose ``_id`` is taken fails: ordered writes stop there and keep what
        came before, unordered ones go on.
        """
        df = self.store[name]
        out: dict[str, Any] = {"inserted": 0, "matched": 0, "deleted": 0, "upserted": 0, "errors": []}
        for i, op in enumerate(operations):
            ((kind, spec),) = op.items()
            if kind in ("insertOne", "insert"):
                new = Pipeline(self.spark).documents([spec["document"]])
                if "_id" in df.columns and "_id" in new.columns and not df.join(new, "_id", "left_semi").isEmpty():
                    out["errors"].append({"index": i, "message": "duplicate key: _id"})
                    if ordered:
                        break
                    continue
                out["inserted"] += 1
                df = df.unionByName(new, allowMissingColumns=True)
            elif kind in ("updateOne", "updateMany", "replaceOne", "update"):
                change = spec.get("update", spec.get("replacement"))
                hits = count(df, spec["filter"], limit=0 if kind == "updateMany" else 1)
                out["matched"] += hits
                out["upserted"] += int(not hits and spec.get("upsert", False))
                df = updates.update(df, spec["filter"], change, multi=kind == "updateMany", upsert=spec.get("upsert", False))
            elif kind in ("deleteOne", "deleteMany", "delete"):
                out["deleted"] += count(df, spec["filter"], limit=1 if kind == "deleteOne" else 0)
                df = updates.delete(df, spec["filter"], 1 if kind == "deleteOne" else 0)
            else:
                raise ValueError(f"unknown operation {kind}")
        self.store.save(name, df)
        return out
