"""Change events applied to a collection, in batch and from a stream.

An event has ``op`` (i, u, d or n), ``ts`` (its place in the order), ``_id`` and
``o`` (the new document or the changed fields). A batch is reduced to the last
state of each ``_id`` before it touches the target, so one full outer join
applies it; applying the same batch again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store


def unpacked(events: DataFrame) -> DataFrame:
    """Events with those of a transaction (a column ``ops`` of events) put in their places."""
    if "ops" not in events.columns:
        return events
    inner = events.filter("ops is not null").select(F.col("ts").alias("__ts"), F.posexplode("ops").alias("__at", "__e"))
    names = [c for c in events.columns if c not in ("ops", "ts")]
    have = inner.schema["__e"].dataType.fieldNames()
    each = inner.select(F.struct("__ts", "__at").alias("ts"), *[(F.col("__e").getField(c) if c in have else F.lit(None)).alias(c) for c in names])
    plain = events.filter("ops is null").select(F.struct(F.col("ts").alias("__ts"), F.lit(-1).alias("__at")).alias("ts"), *[F.col(c) for c in names])
    return plain.unionByName(each)


def latest(events: DataFrame) -> DataFrame:
    """One row for each _id: its last operation, whether it was made anew, and each field's last change.

    Updates only carry changed fields (others are null) and may name removed ones in
    ``unset``, so each field takes the last value after the last insert or delete; a
    field is null here if nothing touched it, else a struct with its value ``v``.
    """
    events = unpacked(events)
    fields = events.schema["o"].dataType.fieldNames()
    events = events.filter("op <> 'n'")
    w = Window.partitionBy("_id")
    reset = F.max(F.when(F.col("op") != "u", F.col("ts"))).over(w)
    live = events.withColumn("__reset", reset).filter("__reset is null or ts >= __reset")
    out = []
    for f in fields:
        value = F.col("o").getField(f)
        touched = value.isNotNull()
        if "unset" in events.columns:
            touched = touched | F.coalesce(F.array_contains("unset", f), F.lit(False))
        out.append(F.max_by(F.struct(value.alias("v")), F.when(touched & (F.col("op") != "d"), F.col("ts"))).alias(f))
    kind = F.max_by("op", "ts").alias("__last")
    fresh = F.max((F.col("op") == "i").cast("int")).alias("__fresh")
    return live.groupBy("_id").agg(kind, fresh, *out)


def empty_target(events: DataFrame) -> DataFrame:
    """A collection without rows, of the events' fields."""
    return events.select("_id", "o.*").limit(0)


def apply_events(target: DataFrame, events: DataFrame) -> DataFrame:
    """The target after the events; updates of rows that are not there are ignored."""
    last = latest(events)
    fields = [c for c in last.columns if not c.startswith("__") and c != "_id"]
    names = list(dict.fromkeys([*target.columns, *fields]))
    t, s = target.withColumn("__t", F.lit(True)).alias("t"), last.alias("s")
    both = t.join(s, F.col("t._id") == F.col("s._id"), "full_outer")
    there, fresh = F.col("__t").isNotNull(), F.coalesce(F.col("__fresh") == 1, F.lit(False))
    keep = F.when(F.col("__last").isNull(), there).otherwise((F.col("__last") != "d") & (there | fresh))
    cols: list[Column] = []
    for n in names:
        old = F.col(f"t.{n}") if n in target.columns else F.lit(None)
        if n == "_id":
            cols.append(F.coalesce(F.col("t._id"), F.col("s._id")).alias("_id"))
        elif n in fields:
            new = F.col(f"s.`{n}`")
            cols.append(F.when(fresh | new.isNotNull(), new.getField("v")).otherwise(old).alias(n))
        else:
            cols.append(F.when(fresh, F.lit(None)).otherwise(old).alias(n))
    return both.filter(keep).select(*cols)


def apply_stream(events: DataFrame, store: Store, name: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 64):
    """Apply a stream of events to a stored collection.

    A batch only writes its events beside the collection, under its own number, so
    its cost does not grow with the collection and a batch delivered again replaces
    itself. Readers apply what waits in the order of ``ts``, so a late event never
    overwrites a newer state that waits too. Every ``compact_every`` batches what waits is
    folded into the collection, after which older events than those count as new.
    """

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{store.events_path(name)}/batch-{n:012d}")
        if n % compact_every == compact_every - 1:
            compact(store, name)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def compact(store: Store, name: str) -> None:
    """Fold the events that wait into the collection."""
    if store.pending(name) is not None:
        store.save(name, store[name])


def initial_sync(store: Store, name: str, copy: DataFrame, events: DataFrame, since: int) -> None:
    """Copy a collection, then catch up with the events from ``since``, the place in the order where the copy began.

    Events that the copy has seen already are applied again without harm: the last state of each _id decides.
    """
    ts = F.col("ts.__ts") if "ops" in events.columns else F.col("ts")
    late = unpacked(events).filter(ts >= since)
    store.save(name, apply_events(copy, late))


def follow(spark, path: str, schema, pipeline: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """New rows of a growing folder of Parquet, as a stream."""
    out = spark.readStream.schema(schema).parquet(path)
    return pipeline(out) if pipeline else out


def _watched(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with its watermark, which takes times with a zone only."""
    if not late or not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, time: str, size: str, by: list[str], late: str | None = None, slide: str | None = None, **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows, alike in batch and stream; ``late`` sets the watermark of a stream."""
    events = _watched(events, time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggs)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Session windows: runs of events no further apart than the gap."""
    events = _watched(events, time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggs)
