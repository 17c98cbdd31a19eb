"""Copies between filesystems: what the target can hold, what is dropped, and the space it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("unix_mode", "owner", "resource_fork", "type_code", "symlinks", "dos_attributes", "dates")
#: Which axes a family of filesystems can hold.
FAMILIES = {
    "ext": "unix_mode owner symlinks dates", "xfs": "unix_mode owner symlinks dates", "ufs": "unix_mode owner symlinks dates",
    "efs": "unix_mode owner symlinks dates", "jfs": "unix_mode owner symlinks dates", "btrfs": "unix_mode owner symlinks dates",
    "hfsplus": "unix_mode owner resource_fork type_code symlinks dates", "hfs": "resource_fork type_code dates", "mfs": "resource_fork type_code dates",
    "fat": "dos_attributes dates", "exfat": "dos_attributes dates", "ntfs": "dos_attributes dates", "prodos": "type_code dates", "affs": "dates", "cpm": "",
}


def capabilities(spark: SparkSession) -> DataFrame:
    """(fs_type, and a boolean for every axis)."""
    return spark.createDataFrame([(fs, *(a in held.split() for a in AXES)) for fs, held in FAMILIES.items()], ", ".join(["fs_type string", *(f"{a} boolean" for a in AXES)]))


def translate(entries: DataFrame, caps: DataFrame, columns: dict[str, str]) -> DataFrame:
    """entries (with fs_type, the target's) whose columns are null where the target cannot hold their axis, and `dropped`, the
    axes that were lost. caps is one row for each of a few filesystems."""
    joined = entries.join(F.broadcast(caps), "fs_type", "left")
    lost = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~F.coalesce(F.col(axis), F.lit(False)), axis) for c, axis in columns.items())))
    kept = [F.when(F.coalesce(F.col(columns[c]), F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns]
    return joined.select(*kept, F.array_sort(F.array_distinct(lost)).alias("dropped"))


def space(entries: DataFrame, keys: list[str], unit: int = 512, forks: bool = True) -> DataFrame:
    """Bytes that entries take: every fork in whole units, and a unit for each directory."""
    whole = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / unit) * unit
    of_file = whole("size") + (whole("resource_fork_size") if forks else 0)
    return entries.groupBy(*keys).agg(F.sum(F.when(F.col("kind") == "directory", F.lit(unit)).otherwise(of_file)).cast("long").alias("bytes"))


def statistics(copied: DataFrame) -> DataFrame:
    """Counts of a copy from (kind, state, dropped, size)."""
    counts = [F.count_if((F.col("kind") == k) & (F.col("state") == "copied")).alias(f"{k}s") for k in ("file", "directory", "symlink")]
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("skipped", "replaced", "failed")]
    drops = [F.count_if(F.array_contains("dropped", a)).alias(f"dropped_{a}") for a in AXES]
    return copied.agg(*counts, *states, *drops, F.coalesce(F.sum(F.when(F.col("state") == "copied", F.col("size"))), F.lit(0)).alias("bytes"))
