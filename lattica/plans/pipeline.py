"""Aggregation pipelines: stages folded into one DataFrame plan.

The only rewrites done here are those Catalyst cannot see: a lookup that is
unwound at once becomes a plain join, a lookup that is only tested for emptiness
a semi or anti join, and a correlated sub-pipeline one join (see the joins
module). Everything else is left to the optimizer.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import Ctx
from ..operators import geo, grouping, joins, rows, windows
from ..operators.accumulators import Order, sort_keys
from .filters import compile_filter

Collections = Mapping[str, DataFrame]


class PipelineError(ValueError):
    """A malformed or unsupported pipeline."""


_STAGES: dict[str, Callable] = {}

#: Recognised, and refused as they are in the reference semantics.
REFUSED = {
    "$changeStream", "$changeStreamSplitLargeEvent", "$search", "$searchMeta", "$vectorSearch", "$listSearchIndexes", "$listSessions",
    "$listSampledQueries", "$queryStats", "$shardedDataDistribution", "$listCatalog", "$setVariableFromSubPipeline", "$listCachedAndActiveUsers",
}


def stage(*names: str):
    """Register ``(run, df, spec, order, part, ctx) -> (df, order)``; also the way to add one's own."""

    def add(f):
        for n in names:
            _STAGES[n] = f
        return f

    return add


def stages() -> list[str]:
    return sorted(_STAGES)


class Pipeline:
    """Runs pipelines over named collections."""

    def __init__(self, spark: SparkSession, collections: Collections | None = None, save: Callable[[str, DataFrame], None] | None = None, merge=None):
        self.spark, self.collections, self.save, self.merge = spark, {} if collections is None else collections, save, merge

    def get(self, name: str) -> DataFrame:
        try:
            return self.collections[name]
        except KeyError:
            raise PipelineError(f"no collection {name}") from None

    def documents(self, docs: list[dict[str, Any]]) -> DataFrame:
        ctx = Ctx(self.spark.range(1))
        from ..functions.core import literal

        parts = [self.spark.range(1).select(*[literal(v, ctx).col.alias(k) for k, v in d.items()]) for d in docs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def shared(self) -> str:
        """The folder that the driver and all executors share, from ``spark.checkpoint.dir``."""
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            where = self.spark.conf.get("spark.checkpoint.dir", None)
            if where is None:
                if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                    raise PipelineError("set spark.checkpoint.dir to a folder that all executors share")
                where = tempfile.mkdtemp(prefix="lattica-")  # one process: its own folder will do
            sc.setCheckpointDir(where)
        return sc.getCheckpointDir()

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """The rows written once to the shared folder, without the plan that made them."""
        self.shared()
        return df.checkpoint()

    def run(self, df: DataFrame | None, spec: list[dict[str, Any]]) -> DataFrame:
        spec = list(spec)
        if df is None:
            if not spec or "$documents" not in spec[0]:
                raise PipelineError("a pipeline without a collection starts with $documents")
            df = self.documents(spec.pop(0)["$documents"])
        return self.fold(df, spec)[0]

    def fold(self, df: DataFrame, spec: list[dict[str, Any]], order: Order | None = None, part: str | None = None, ctx: Ctx | None = None):
        names = []
        for s in spec:
            if not isinstance(s, dict) or len(s) != 1:
                raise PipelineError("a stage is a document with one key")
            names.append(next(iter(s)))
        for i, n in enumerate(names):
            if n in ("$out", "$merge") and i != len(names) - 1:
                raise PipelineError(f"{n} must be the last stage")
        vars_ = ctx.vars if ctx is not None else {}
        i = 0
        while i < len(spec):
            name, value = names[i], spec[i][names[i]]
            if name == "$lookup" and part is None:
                done = self._peephole(df, value, spec[i + 1 : i + 3])
                if done is not None:
                    df, used = done
                    i += 1 + used
                    continue
            if name in REFUSED:
                raise PipelineError(f"{name} is not supported")
            if name not in _STAGES:
                raise PipelineError(f"unrecognized stage {name}")
            df, order = _STAGES[name](self, df, value, order, part, Ctx(df, vars_))
            i += 1
        return df, order

    def _peephole(self, df: DataFrame, spec: dict[str, Any], after: list[dict[str, Any]]):
        """(df, stages used after the lookup) if it fuses with what follows."""
        if "pipeline" in spec or not after or "localField" not in spec:
            return None
        foreign, name = self.get(spec["from"]), spec["as"]
        from ..functions.core import path

        if isinstance(path(spec["localField"], Ctx(df)).type, _array()) or isinstance(path(spec["foreignField"], Ctx(foreign)).type, _array()):
            return None
        nxt = after[0]
        if "$unwind" in nxt:
            u = nxt["$unwind"] if isinstance(nxt["$unwind"], dict) else {"path": nxt["$unwind"]}
            if u["path"] == f"${name}" and not u.get("includeArrayIndex"):
                keep = u.get("preserveNullAndEmptyArrays", False)
                return joins.lookup_flat(df, foreign, spec["localField"], spec["foreignField"], name, keep), 1
        if "$match" in nxt and list(nxt["$match"]) == [name] and len(after) > 1:
            test, drop = nxt["$match"][name], after[1]
            gone = drop.get("$unset") == name or drop.get("$unset") == [name] or drop.get("$project") == {name: 0}
            some = test in ({"$ne": []}, {"$not": {"$size": 0}})
            none = test in ({"$size": 0}, {"$eq": []}, [])
            if gone and (some or none):
                return joins.lookup_exists(df, foreign, spec["localField"], spec["foreignField"], some), 2
        return None


def _array():
    from pyspark.sql.types import ArrayType

    return ArrayType


def _limit_within(df: DataFrame, order: Order | None, part: str, ctx: Ctx, lo: int, hi: int | None) -> DataFrame:
    from ..operators.accumulators import default_order

    place = F.row_number().over(Window.partitionBy(part).orderBy(*sort_keys(ctx, default_order(ctx, order))))
    rows_ = df.withColumn("__place", place).filter(F.col("__place") > lo)
    if hi is not None:
        rows_ = rows_.filter(F.col("__place") <= hi)
    return rows_.drop("__place")


@stage("$match")
def _match(run, df, spec, order, part, ctx):
    out = df.filter(compile_filter(spec, ctx))
    d = geo.near_order(df, spec)
    return (out.orderBy(d) if d is not None else out), order


@stage("$project")
def _project(run, df, spec, order, part, ctx):
    return rows.project(df, spec, ctx), _kept(order, spec)


def _kept(order: Order | None, spec: dict[str, Any]) -> Order | None:
    """The order after a projection, if its keys are still there as they were."""
    if order and all(spec.get(k.split(".")[0], 0 if any(spec.values()) else 1) in (1, True) for k, _ in order):
        return order
    return None if order and any(v for k, v in spec.items() if k != "_id") else order


@stage("$addFields", "$set")
def _add_fields(run, df, spec, order, part, ctx):
    return rows.add_fields(df, spec, ctx), order


@stage("$unset")
def _unset(run, df, spec, order, part, ctx):
    return rows.unset(df, spec), order


@stage("$replaceRoot")
def _replace_root(run, df, spec, order, part, ctx):
    return rows.replace_root(df, spec["newRoot"], ctx), None


@stage("$replaceWith")
def _replace_with(run, df, spec, order, part, ctx):
    return rows.replace_root(df, spec, ctx), None


@stage("$redact")
def _redact(run, df, spec, order, part, ctx):
    return rows.redact(df, spec), order


@stage("$unwind")
def _unwind(run, df, spec, order, part, ctx):
    return rows.unwind(df, spec), order


@stage("$group")
def _group(run, df, spec, order, part, ctx):
    return grouping.group(df, spec, order, part, ctx), None


@stage("$bucket")
def _bucket(run, df, spec, order, part, ctx):
    return grouping.bucket(df, spec, order), [("_id", 1)]


@stage("$bucketAuto")
def _bucket_auto(run, df, spec, order, part, ctx):
    return grouping.bucket_auto(df, spec, order), [("_id", 1)]


@stage("$sortByCount")
def _sort_by_count(run, df, spec, order, part, ctx):
    return grouping.sort_by_count(df, spec), [("count", -1), ("_id", 1)]


@stage("$count")
def _count(run, df, spec, order, part, ctx):
    return grouping.count(df, spec, part), None


@stage("$sort")
def _sort(run, df, spec, order, part, ctx):
    if any(isinstance(v, dict) for v in spec.values()):
        raise PipelineError("$sort by $meta is not offered: texts have no score")
    keys = [(k, 1 if v > 0 else -1) for k, v in spec.items()]
    if not keys:
        return df, order
    if len(keys) > 32:
        raise PipelineError("$sort takes at most 32 keys")
    if "_id" in df.columns and all(k != "_id" for k, _ in keys) and rows_orderable(df):
        keys = [*keys, ("_id", 1)]
    return (df if part else df.orderBy(*sort_keys(ctx, keys))), keys


def rows_orderable(df: DataFrame) -> bool:
    from ..operators.accumulators import orderable

    return orderable(df.schema["_id"].dataType)


@stage("$limit")
def _limit(run, df, spec, order, part, ctx):
    if not isinstance(spec, int) or spec < 1:
        raise PipelineError("$limit takes a positive integer")
    if spec > grouping.MOST_HELD:  # a full sort instead of a heap of that size in every task
        run.spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", grouping.MOST_HELD)
    return (_limit_within(df, order, part, ctx, 0, spec) if part else df.limit(spec)), order


@stage("$skip")
def _skip(run, df, spec, order, part, ctx):
    if not isinstance(spec, int) or spec < 0:
        raise PipelineError("$skip takes a non-negative integer")
    return (_limit_within(df, order, part, ctx, spec, None) if part else df.offset(spec)), order


@stage("$sample")
def _sample(run, df, spec, order, part, ctx):
    return grouping.sample(df, spec["size"]), None


@stage("$facet")
def _facet(run, df, spec, order, part, ctx):
    """Every facet is one row with an array; rows of one are put side by side."""
    df = df.cache()
    out = None
    for name, sub in spec.items():
        if any(next(iter(s)) in ("$facet", "$out", "$merge", "$geoNear", "$collStats", "$documents") for s in sub):
            raise PipelineError(f"a stage of facet {name} is not allowed there")
        found, o = run.fold(df, sub, order)
        one = found.agg(joins._ordered(found, o).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out, None


@stage("$lookup")
def _lookup(run, df, spec, order, part, ctx):
    if "pipeline" not in spec:
        return joins.lookup_equal(df, run.get(spec["from"]), spec["localField"], spec["foreignField"], spec["as"], run.checkpoint), order
    foreign = run.get(spec["from"]) if "from" in spec else None
    return joins.lookup_pipeline(df, foreign, spec, ctx, run.fold, compile_filter, run.documents, run.checkpoint), order


@stage("$graphLookup")
def _graph_lookup(run, df, spec, order, part, ctx):
    return joins.graph_lookup(df, run.get(spec["from"]), spec, compile_filter, run.checkpoint), order


@stage("$unionWith")
def _union_with(run, df, spec, order, part, ctx):
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = run.run(run.get(spec["coll"]) if "coll" in spec else None, spec.get("pipeline") or [])
    return joins.union_with(df, other), None


@stage("$setWindowFields")
def _set_window_fields(run, df, spec, order, part, ctx):
    keys = [(k, 1 if v > 0 else -1) for k, v in (spec.get("sortBy") or {}).items()]
    return windows.set_window_fields(df, spec), keys or order


@stage("$fill")
def _fill(run, df, spec, order, part, ctx):
    return windows.fill(df, spec), order


@stage("$densify")
def _densify(run, df, spec, order, part, ctx):
    return grouping.densify(df, spec), [(spec["field"], 1)]


@stage("$geoNear")
def _geo_near(run, df, spec, order, part, ctx):
    return geo.geo_near(df, spec, compile_filter), [(spec["distanceField"], 1)]


@stage("$collStats")
def _coll_stats(run, df, spec, order, part, ctx):
    return df.agg(F.count(F.lit(1)).alias("count")), None


@stage("$_internalInhibitOptimization")
def _no_op(run, df, spec, order, part, ctx):
    return df, order


@stage("$out")
def _out(run, df, spec, order, part, ctx):
    if run.save is None:
        raise PipelineError("$out needs a store to write to")
    run.save(spec if isinstance(spec, str) else spec["coll"], df)
    return df.limit(0), None


@stage("$merge")
def _merge(run, df, spec, order, part, ctx):
    if run.merge is None:
        raise PipelineError("$merge needs a store to write to")
    run.merge(df, {"into": spec} if isinstance(spec, str) else spec)
    return df.limit(0), None


