"""Bitmaps of bounded size for map-side choices: they may let too much through, never too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 1 << 25


def bitmap_slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))


def bitmap_words(keys: DataFrame, *columns: str) -> DataFrame:
    """word, mask: the 32-bit words of the bitmap that have a bit set, at most BITMAP_BITS / 32 rows."""
    slots = keys.select(bitmap_slot(*columns).alias("slot")).groupBy(F.expr("slot div 32").alias("word"))
    return slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("mask"))


def with_mark(rows: DataFrame, columns: tuple[str, ...], keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: false where ``columns`` are certainly not among ``keys`` (of the same names and
    types). The bitmap's words are broadcast: at most BITMAP_BITS / 32 rows of two longs, whatever the size of ``keys``."""
    words = F.broadcast(bitmap_words(keys, *columns)).select(F.col("word").alias("word__"), F.col("mask").alias("mask__"))
    slot = bitmap_slot(*columns)
    both = rows.join(words, F.col("word__") == F.floor(slot / 32), "left")
    bit = F.coalesce(F.getbit("mask__", F.pmod(slot, F.lit(32)).cast("int")), F.lit(0)) == 1
    return both.select(*rows.columns, bit.alias(mark))
