"""Bitmaps of keys: which rows may have one of many keys, without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a bitmap, bits for each key, and bits in all at most (32 MB as a broadcast).
ROW_BITS = 32768
EACH, MOST = 16, 1 << 28


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap_of(keys: DataFrame, key: str, most: int = MOST) -> tuple[DataFrame, int]:
    """Rows (_row, _bits) of a bitmap of all keys, and its size; beyond ``most`` bits it fills up and tells less, never wrongly."""
    bits = min(most, max(ROW_BITS, 1 << (keys.count() * EACH).bit_length()))
    at = _place(F.col(key), bits)
    return keys.groupBy(F.floor(at / ROW_BITS).alias("_row")).agg(F.bitmap_construct_agg(at % ROW_BITS).alias("_bits")), bits


def with_mark(df: DataFrame, key: str, bitmap: tuple[DataFrame, int], mark: str) -> DataFrame:
    """``df`` with ``mark``: false where the key is certainly none of the bitmap's; null keys are none."""
    rows, bits = bitmap
    at = _place(F.col(key), bits)
    bit = at % ROW_BITS
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_row", F.floor(at / ROW_BITS)).join(F.broadcast(rows), "_row", "left")  # MOST bits at most
    held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1, F.lit(False))
    return found.withColumn(mark, held & F.col(key).isNotNull()).drop("_row", "_bits")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is none of ``keys``: rows that the bitmap clears pass as they are read, only the others are joined."""
    marked = with_mark(df, key, bitmap_of(keys.filter(F.col(key).isNotNull()), key), "_may")
    clear = marked.filter("NOT _may").drop("_may")
    rest = marked.filter("_may").drop("_may").join(keys.select(key).distinct(), key, "left_anti")
    return clear.select(*df.columns).unionByName(rest.select(*df.columns))
