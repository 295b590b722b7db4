"""Exact dedup over an extendible-hash index (DataFrame functions only).

A text's key is its 64-bit hash. A directory of hash prefixes is doubled until
no bucket holds more keys than its capacity; only overfull buckets get another
bit, so the directory follows the data. Runs of neighbouring buckets with about
equal numbers of keys go to one owner task each. Keys seen once are settled from
the counts alone. Keys that several rows share form chains: their texts, and
only theirs, are sent to the owner of their bucket, which compares them byte for
byte. Before that, equal texts are added up within each map task and then within
SALTS parts, so of a text that makes up a third of all rows the owner gets SALTS
rows. The index is written to the shared folder, each owner's chains in key order.

Results for odd inputs: a null text counts as empty; equal texts are equal
bytes, nothing is normalised; among equal texts the largest ``doc_id`` stays;
a null ``doc_id`` is smaller than any other and a group of nothing but null ids
keeps all its rows; rows that repeat both id and text are one document read
twice and share a verdict; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import flagged, maybe_in
from .scratch import Scratch

#: Bits beyond which no bucket is split: with a capacity of a thousandth of the keys its 2**12 cells are far below it.
MAX_DEPTH = 12
#: Parts that equal texts are added up in before they go to their owner.
SALTS = 8


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")
    )


def directory(keys: DataFrame, capacity: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directory of an extendible-hash index over the column ``h`` of distinct keys.

    Returns one row per finest cell: cell, depth (bits its bucket uses), bucket
    (its prefix at that depth) and keys (number in the bucket). A bucket is split
    as long as it holds more than ``capacity`` keys and bits are left.
    """
    cell = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    cells = keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    # at most 2**max_depth cells; every depth's totals come from them
    levels = cells.select(
        "cell", "keys", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    ).withColumn("bucket", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    totals = levels.groupBy("depth", "bucket").agg(F.sum("keys").alias("keys"))
    if capacity is None:
        capacity = max(1024, -(-keys.count() // 1024))
    fits = totals.filter((F.col("keys") <= capacity) | (F.col("depth") == max_depth))
    return (
        levels.drop("keys")
        .join(fits, ["depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket", "keys")).alias("b"))
        .select("cell", "b.depth", "b.bucket", "b.keys")
    )


def owners(entries: DataFrame, tasks: int) -> DataFrame:
    """The directory (at most 2**MAX_DEPTH rows) with the owner of each bucket: runs of buckets with about equal numbers of keys."""
    buckets = entries.groupBy("depth", "bucket").agg(F.min("cell").alias("start"), F.max("keys").alias("keys"))
    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.coalesce(F.sum("keys").over(before), F.lit(0)) / F.sum("keys").over(whole)
    owned = buckets.select("depth", "bucket", F.floor(share * tasks).cast("int").alias("owner"))
    return entries.join(F.broadcast(owned), ["depth", "bucket"])


def build_index(spark: SparkSession, docs: DataFrame, scratch: Scratch, capacity: int | None = None) -> DataFrame:
    """Classes of texts that more than one row has, in key order within each owner.

    Columns: owner, depth and bucket (directory entry), h and n (hash and bytes),
    sha, keep_id (largest id) and group_size.
    """
    keyed = _keyed(docs)
    keys = scratch.table("keys", keyed.groupBy("h", "n").agg(F.count(F.lit(1)).alias("rows")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = scratch.table("directory", owners(directory(keys.select("h").distinct(), capacity), tasks))
    chained = keys.filter("rows > 1").select("h")
    suspects = maybe_in(keyed, F.col("h"), chained, F.col("h")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    largest, rows = F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    summed = suspects.groupBy("h", "n", "text", "salt").agg(largest, rows)
    cell = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    sent = summed.withColumn("cell", cell).join(F.broadcast(entries.drop("keys")), "cell").drop("cell", "salt")
    at_owner = sent.repartition(tasks, "owner")  # the grouping below needs no other exchange
    chains = at_owner.groupBy("owner", "depth", "bucket", "h", "n", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chains = chains.filter("group_size > 1").withColumn("sha", F.sha2("text", 256)).drop("text")
    out = scratch.table("index", chains.sortWithinPartitions("owner", "h", "n", "sha"))
    scratch.drop("keys")
    return out


def exact_dedup(spark: SparkSession, docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(spark, docs, Scratch(spark, "exact-dedup"), capacity)
    rows = _keyed(docs).select("doc_id", "h", "n", F.sha2("text", 256).alias("sha"))
    found = rows.join(index.drop("owner", "depth", "bucket"), ["h", "n", "sha"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts whose key has no chain pass without a shuffle; only the others are joined.
    """
    index = build_index(spark, docs, Scratch(spark, "exact-dedup"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col("doc_id").alias("__id"),
        F.xxhash64(text).alias("h"),
        text.alias("__text"),
    )
    rows = flagged(rows, F.col("h"), index, F.col("h"), "__chained")
    alone = rows.filter("not __chained").select("__doc.*")
    rest = rows.filter("__chained").withColumn("n", F.octet_length("__text")).withColumn("sha", F.sha2("__text", 256)).drop("__text")
    left, right = rest.alias("rest"), index.select("h", "n", "sha", "keep_id").alias("index")
    at = [F.col(f"rest.{c}") == F.col(f"index.{c}") for c in ("h", "n", "sha")]
    at = at[0] & at[1] & at[2] & ~F.col("rest.__id").eqNullSafe(F.col("index.keep_id"))
    return alone.unionByName(left.join(right, at, "left_anti").select("__doc.*"))
