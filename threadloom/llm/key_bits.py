"""Rows whose key surely is not among given keys, told apart without a shuffle by a bitmap of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.session import stage_table

CELLS = 1 << 26  # bits of the whole map: 8 MiB are broadcast at most (and a key per page), whatever the number of keys
AGG_BITS = 15  # log2 of the bits of one of Spark's bitmaps
PAGE_BITS = 10  # of a page as it is broadcast: each row looked up copies one


def _cell(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(CELLS))


def key_bits(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(page, bits): a bit for the hash of each key. Keys are dealt by place first, so tasks send keys, never maps."""
    cell, size = _cell(columns), 1 << PAGE_BITS - 3
    dealt = keys.select(F.shiftright(cell, AGG_BITS).alias("place"),
                        cell.bitwiseAND(F.lit((1 << AGG_BITS) - 1)).alias("bit")).repartition("place")
    maps = dealt.groupBy("place").agg(F.bitmap_construct_agg("bit").alias("map"))
    pages = maps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((1 << AGG_BITS - PAGE_BITS) - 1)))).select(
        (F.shiftleft("place", AGG_BITS - PAGE_BITS) + F.col("k")).alias("page"),
        F.substring("map", F.col("k") * size + 1, F.lit(size)).alias("bits"))
    return stage_table(pages.where(F.col("bits") != F.lit(bytearray(size))), name)


def by_bits(rows: DataFrame, bits: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose bit is set: all whose key is among the keys, and some others. ``left_anti``: surely not among them.

    With many more keys than ``CELLS`` most bits are set and few rows are left out; none is ever lost.
    """
    cell = _cell(columns)
    bit = cell.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))
    byte = F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.shiftright(cell, PAGE_BITS) == F.col("page")) & is_set, how)
