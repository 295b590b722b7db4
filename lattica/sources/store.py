"""Collections as folders of Parquet, and the operators that write them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

CURRENT = "CURRENT"


class Store(Mapping):
    """Named collections under one folder, each ``name.parquet``.

    A collection holds its rows in snapshots, and a file ``CURRENT`` names the one
    that counts; replacing that file is the only step of a save that readers see, so
    a save that dies on the way changes nothing. The snapshot before the current one
    stays until the next save, for plans that still read it. A plain folder of
    Parquet without that file is a collection too.

    Change events that a stream has delivered wait in ``.name.events`` and are
    applied when the collection is read, until ``compact`` folds them in.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def events_path(self, name: str) -> str:
        return f"{self.root}/.{name}.events"

    def _current(self, name: str) -> str | None:
        """The folder that holds a collection's rows."""
        at = files.read_text(self.spark, f"{self.path(name)}/{CURRENT}")
        if at is not None:
            return f"{self.path(name)}/{at}"
        return self.path(name) if files.exists(self.spark, self.path(name)) else None

    def base(self, name: str) -> DataFrame:
        """A collection without the events that wait."""
        at = self._current(name)
        if at is None:
            raise KeyError(name)
        return self.spark.read.parquet(at)

    def pending(self, name: str) -> DataFrame | None:
        """The events that wait to be folded in."""
        at = self.events_path(name)
        batches = [b for b in files.names(self.spark, at) if b.startswith("batch-") and files.exists(self.spark, f"{at}/{b}/_SUCCESS")]
        return self.spark.read.parquet(*[f"{at}/{b}" for b in batches]) if batches else None

    def __getitem__(self, name: str) -> DataFrame:
        events = self.pending(name)
        if events is None:
            return self.base(name)
        from ..streaming.cdc import apply_events, empty_target

        return apply_events(self.base(name) if self._current(name) else empty_target(events), events)

    def __iter__(self) -> Iterator[str]:
        for n in files.names(self.spark, self.root):
            if n.endswith(".parquet"):
                yield n.removesuffix(".parquet")

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def save(self, name: str, df: DataFrame) -> None:
        """Replace a collection: a new snapshot is written whole, then made the current one."""
        before = files.read_text(self.spark, f"{self.path(name)}/{CURRENT}")
        fresh = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path(name)}/{fresh}")
        files.write_text(self.spark, f"{self.path(name)}/{CURRENT}", fresh)
        files.remove(self.spark, self.events_path(name))  # what the new rows were made from
        for old in files.names(self.spark, self.path(name)):
            if old.startswith(("snapshot-", "part-")) and old not in (before, fresh) and before is not None:
                files.remove(self.spark, f"{self.path(name)}/{old}")

    def insert(self, name: str, df: DataFrame, ordered: bool = True) -> None:
        """Append documents; a duplicate ``_id`` is an error, or is skipped if unordered."""
        if self.pending(name) is not None:
            self.save(name, self[name])
        if "_id" in df.columns:
            known = self[name].select("_id") if name in self else df.select("_id").limit(0)
            if ordered:
                if not df.join(known, "_id", "left_semi").isEmpty() or df.count() != df.select("_id").distinct().count():
                    raise ValueError("duplicate key: _id")
            else:
                df = df.dropDuplicates(["_id"]).join(known, "_id", "left_anti")
        if self._current(name) is None:
            return self.save(name, df)
        df.write.mode("append").parquet(self._current(name))

    def drop(self, name: str) -> None:
        """Take a collection away; ``undrop`` brings the one dropped last back."""
        if files.exists(self.spark, self.path(name)):
            if self.pending(name) is not None:
                self.save(name, self[name])
            n = 1 + max((int(x.split("-")[0]) for x in files.names(self.spark, f"{self.root}/.dropped")), default=0)
            fs, at = files.file_system(self.spark, f"{self.root}/.dropped")
            fs.mkdirs(at)
            files.move(self.spark, self.path(name), f"{self.root}/.dropped/{n:08d}-{name}")

    def dropped(self) -> list[str]:
        """Names of collections that can be brought back, in the order they were dropped."""
        return [x.split("-", 1)[1] for x in files.names(self.spark, f"{self.root}/.dropped")]

    def undrop(self, name: str) -> None:
        found = [x for x in files.names(self.spark, f"{self.root}/.dropped") if x.split("-", 1)[1] == name]
        if not found:
            raise KeyError(name)
        if files.exists(self.spark, self.path(name)):
            raise ValueError(f"a collection {name} exists")
        files.move(self.spark, f"{self.root}/.dropped/{found[-1]}", self.path(name))

    def purge_dropped(self) -> None:
        files.remove(self.spark, f"{self.root}/.dropped")

    def merge(self, df: DataFrame, spec: dict[str, Any]) -> None:
        name = spec["into"]
        self.save(name, merge(self[name] if name in self else df.limit(0), df, spec))


def merge(target: DataFrame, source: DataFrame, spec: dict[str, Any], pipeline: Callable[[DataFrame, list], DataFrame] | None = None) -> DataFrame:
    """The target after ``$merge``: one full outer join on the keys."""
    on = spec.get("on", "_id")
    on = [on] if isinstance(on, str) else on
    matched, missing = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    names = list(dict.fromkeys([*target.columns, *source.columns]))
    t = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("t"), F.lit(True).alias("in_t"))
    s = source.select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("s"), F.lit(True).alias("in_s"))
    cond = None
    for k in on:
        c = F.col("t").getField(k) == F.col("s").getField(k)
        cond = c if cond is None else cond & c
    both = t.join(s, cond, "full_outer")
    in_t, in_s = F.col("in_t").isNotNull(), F.col("in_s").isNotNull()
    if matched == "fail":
        both = both.withColumn("s", F.when(in_t & in_s, F.raise_error(F.lit("$merge: a document matched"))).otherwise(F.col("s")))
    if missing == "fail":
        both = both.withColumn("s", F.when(in_s & ~in_t, F.raise_error(F.lit("$merge: a document did not match"))).otherwise(F.col("s")))
    if missing == "discard":
        both = both.filter(in_t)
    cols = []
    for n in names:
        old = F.col("t").getField(n) if n in target.columns else F.lit(None)
        new = F.col("s").getField(n) if n in source.columns else None
        if isinstance(matched, list):
            pick = F.when(in_t, old).otherwise(new if new is not None else F.lit(None))
        elif matched == "keepExisting":
            pick = F.when(in_t, old).otherwise(new if new is not None else F.lit(None))
        elif matched == "replace":
            pick = F.when(in_s, new if new is not None else F.lit(None)).otherwise(old)
        else:  # fields of the source win, others stay
            pick = F.when(in_s, new).otherwise(old) if new is not None else old
        cols.append(pick.alias(n))
    if not isinstance(matched, list):
        return both.select(*cols)
    from dataclasses import replace

    from ..functions.core import Ctx, Ex, compile_expr
    from ..plans.pipeline import Pipeline

    run = Pipeline(target.sparkSession)
    hit = both.filter(in_t & in_s)
    rows = hit.select(*[F.col("t").getField(c).alias(c) for c in target.columns], F.col("s").alias("__new"))
    ctx = Ctx(rows)
    bound = {"new": Ex(F.col("__new"), source.schema, ctx)}
    if spec.get("let"):  # seen from the incoming document, which $$new then names only if it is given
        given = replace(ctx, root=bound["new"])
        let = {k: compile_expr(v, replace(given, vars=bound)) for k, v in spec["let"].items()}
        rows = rows.withColumns({f"__let_{k}": e.col for k, e in let.items()})
        ctx = Ctx(rows)
        bound |= {k: Ex(F.col(f"__let_{k}"), e.type, ctx) for k, e in let.items()}
    done = run.fold(rows, matched, ctx=Ctx(rows, bound))[0]
    done = done.drop(*[c for c in done.columns if c == "__new" or c.startswith("__let_")])
    return both.filter(~(in_t & in_s)).select(*cols).unionByName(done, allowMissingColumns=True)
