"""Allocation bitmaps: binary columns, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_positions(bitmap: Column, bits: Column) -> Column:
    """Ascending positions of set bits, of which the bitmap has `bits`."""
    places = F.filter(F.sequence(F.lit(0), F.octet_length(bitmap) * 8 - 1), lambda i: i < bits)
    at = lambda i: F.conv(F.hex(F.substring(bitmap, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.filter(places, lambda i: at(i).bitwiseAND(F.call_function("shiftleft", F.lit(1), i % 8)) != 0)
    return F.when(F.octet_length(bitmap) > 0, found).otherwise(F.array().cast("array<int>"))


def count_set(bitmap: Column, bits: Column) -> Column:
    return F.size(set_positions(bitmap, bits))


def highest_set(bitmap: Column, bits: Column) -> Column:
    return F.array_max(set_positions(bitmap, bits))


def lowest_clear(bitmap: Column, bits: Column) -> Column:
    return F.array_min(F.array_except(F.when(bits > 0, F.sequence(F.lit(0), bits - 1)).otherwise(F.array().cast("array<int>")), set_positions(bitmap, bits)))


def summarise(allocation: DataFrame, keys: list[str], block: str = "block_no", used: str = "used") -> DataFrame:
    """Of an allocation table: used blocks, the highest used and the lowest free one."""
    return allocation.groupBy(*keys).agg(F.count_if(F.col(used)).alias("used_blocks"), F.max(F.when(F.col(used), F.col(block))).alias("highest_used"), F.min(F.when(~F.col(used), F.col(block))).alias("lowest_free"))
