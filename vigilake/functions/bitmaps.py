"""Bitmaps of fixed size that go in front of joins, so that few rows without a partner are moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 22


def bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> Column:
    """A scalar subquery: 2**bits bits as an array of longs, set at the keys.  Its size does not depend on theirs."""
    have = keys.select(F.pmod(F.col(key), F.lit(1 << bits)).alias("slot")).selectExpr(
        "slot div 64 as id", "shiftleft(1L, cast(slot % 64 as int)) as bit")
    words = keys.sparkSession.range(1 << (bits - 6)).join(have.groupBy("id").agg(F.bit_or("bit").alias("bit")), "id", "left")
    whole = words.groupBy((F.col("id") / 1024).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit")))).alias("w"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("part", F.col("w.bit").alias("w")))).alias("a")).select(
        F.flatten(F.col("a.w")).alias("bits")).scalar()


def in_bitmap(bits_column: Column, key: Column, bits: int = BITMAP_BITS) -> Column:
    """True for every key of the bitmap and for few others, as long as the keys are fewer than the bits."""
    slot = F.pmod(key, F.lit(1 << bits))
    word = F.element_at(bits_column, (F.floor(slot / 64) + 1).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
