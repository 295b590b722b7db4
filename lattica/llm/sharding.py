"""Sharding by a weighted hash tree (DataFrame functions only).

Shards are leaves of a tree of regions and racks. From the root, a row draws
one child at a time: every child gets ``-ln(u) / weight`` with ``u`` hashed from
the row's key and the child's name, and the smallest draw wins. A child's draw
depends on nothing but its own name and weight, so a change of weight moves
rows only into or out of the subtree whose weight changed. A shard that joins
does so in a region of its own, so it takes rows only into itself.

Results for odd inputs: a null text has no bytes (size 1, checksum of nothing);
a null ``doc_id`` is a key like any other; repeated rows share a shard and get
slots of their own; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Slots are numbered in so many pieces per shard, side by side.
PIECES = 4096


def tree(n_shards: int, racks: int = 2, per_rack: int = 2) -> list:
    """Nested (name, children) pairs; a leaf is (name, shard, weight)."""
    per_region = racks * per_rack
    out = []
    for region in range(0, n_shards, per_region):
        members = range(region, min(region + per_region, n_shards))
        children = []
        for rack in range(members.start, members.stop, per_rack):
            shards = range(rack, min(rack + per_rack, members.stop))
            leaves = [(f"shard{s}", s, 1.0) for s in shards]
            children.append((f"rack{rack // per_rack}", leaves))
        out.append((f"region{region // per_region}", children))
    return out


def grow(nodes: list, shard: int, weight: float = 1.0) -> list:
    """The tree with one more shard, alone in a new region."""
    return [*nodes, (f"region+{shard}", [(f"rack+{shard}", [(f"shard{shard}", shard, weight)])])]


def reweigh(nodes: list, weights: dict[int, float]) -> list:
    """The tree with other weights for some shards."""
    return [
        (n[0], n[1], weights.get(n[1], n[2])) if len(n) == 3 else (n[0], reweigh(n[1], weights))
        for n in nodes
    ]


def _weight(node: tuple) -> float:
    return node[2] if len(node) == 3 else sum(map(_weight, node[1]))


def shard_of(key: Column, nodes: list) -> Column:
    """The shard that a row with this key descends to; weights of zero get nothing."""
    nodes = [n for n in nodes if _weight(n) > 0]
    if not nodes:
        raise ValueError("a tree needs a shard of positive weight")
    leaf = [F.lit(n[1]) if len(n) == 3 else shard_of(key, n[1]) for n in nodes]
    if len(nodes) == 1:
        return leaf[0]
    draws = []
    for i, node in enumerate(nodes):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node[0])), 11) + F.lit(0.5)) / F.lit(2.0**53)
        draws.append(F.struct((-F.log(u) / F.lit(float(_weight(node)))).alias("d"), F.lit(i).alias("i")))
    pick = F.least(*draws)["i"]
    out = leaf[-1]
    for i in range(len(nodes) - 2, -1, -1):
        out = F.when(pick == i, leaf[i]).otherwise(out)
    return out


def shard(spark: SparkSession, docs: DataFrame, nodes: list | None = None, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    Slots are gapless from 0 within a shard. They are numbered in PIECES pieces
    per shard by the key's hash: each piece is sorted by itself, and the pieces'
    counts (a bounded table) give the offsets, so no shard meets in one task.
    """
    nodes = nodes or tree(n_shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null"))
    grown = grow(nodes, n_shards)
    piece = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("piece")), F.lit(PIECES)).cast("int")
    rows = rows.select(
        "*",
        shard_of(key, nodes).cast("int").alias("shard"),
        shard_of(key, grown).cast("int").alias("grown_shard"),
        piece.alias("piece"),
    )
    rows = Scratch(spark, "sharding").table("rows", rows)
    sizes = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    # at most shards * PIECES offsets
    return numbered.join(F.broadcast(offsets), ["shard", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"),
        "grown_shard",
    )
