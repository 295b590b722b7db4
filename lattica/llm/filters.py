"""A broadcast filter of bounded size for semi-joins that would otherwise move whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and of the largest filter as powers of two: 1 MB and 128 MB.
LEAST_BITS, MOST_BITS = 23, 30


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """The rows with a boolean column: whether their 64-bit key may be among the wanted ones.

    False is certain; True still needs an exact join. The filter has at least eight bits
    for each wanted row up to 2**MOST_BITS, which bounds what is broadcast; beyond that it
    lets more through, for the exact join to settle.
    """
    bits_wanted = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(1 << bits_wanted)) + 1

    bits = (
        wanted.select(slot(wanted_key).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("__part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))
    )
    names = rows.columns
    at = rows.withColumn("__part", F.bitmap_bucket_number(slot(key))).withColumn("__at", F.bitmap_bit_position(slot(key)))
    found = at.join(F.broadcast(bits), "__part", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(__at % 8 as int)")) == 1, F.lit(False))
    return found.select(*[F.col(f"`{n}`") for n in names], hit.alias(name))


def maybe_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key may be among the wanted ones, and none that is missing there."""
    return flagged(rows, key, wanted, wanted_key, "__maybe").filter("__maybe").drop("__maybe")
