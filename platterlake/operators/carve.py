"""Carving: maximal runs of printable text, from whole values by a regular expression, from blocks by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.names import text_kind

MIN_RUN, MAX_ENTRIES = 64, 4096
#: Consecutive numbers that one task looks at together.
SEGMENT = 1 << 20


def text_bytes(text: Column) -> Column:
    """How many characters of a value are text for carving: tab, line ends and printable ASCII."""
    return F.length(F.regexp_replace(text, r"[^\t\n\r -~]", "")).cast("long")


def text_runs(rows: DataFrame, key: str, text: str, least: int = MIN_RUN, entries: int | None = MAX_ENTRIES) -> DataFrame:
    """(key, ordinal, run, kind, truncated): the first `entries` runs of tab, line ends and printable ASCII of every value."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([\\t\\n\\r -~]{{{least},}})"), 1)
    shown = runs if entries is None else F.slice(runs, 1, entries)
    found = rows.select(key, F.size(runs).alias("n"), F.posexplode(shown).alias("ordinal", "run"))
    truncated = F.lit(False) if entries is None else F.col("n") > entries
    return found.select(key, "ordinal", "run", text_kind(F.col("run")).alias("kind"), truncated.alias("truncated"))


def islands(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """keys, value, first, last and n of maximal runs of equal values over consecutive rows."""
    w = Window.partitionBy(*keys).orderBy(place)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.withColumn("__change", change).withColumn("run", F.sum("__change").over(w))
    return runs.groupBy(*keys, "run", value).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))


def block_runs(blocks: DataFrame, keys: list[str], place: str, flag: str, least: int = 1, segment: int = SEGMENT) -> DataFrame:
    """keys, start and length of maximal runs of consecutive numbers whose flag is set; works on sparse tables.

    Runs are found within segments of the numbers, so one image's blocks are spread over many tasks; only runs that touch
    the border of a segment meet again, to be joined with their neighbours.
    """
    cut = F.floor(F.col(place) / segment)
    used = blocks.where(F.col(flag)).withColumn("__segment", cut)
    island = F.col(place) - F.row_number().over(Window.partitionBy(*keys, "__segment").orderBy(place))
    found = used.withColumn("__island", island).groupBy(*keys, "__segment", "__island").agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("length"))
    found = found.select(*keys, "start", "length")
    border = (F.col("start") % segment == 0) | ((F.col("start") + F.col("length")) % segment == 0)
    w = Window.partitionBy(*keys).orderBy("start")
    fresh = F.when(F.lag(F.col("start") + F.col("length")).over(w) == F.col("start"), 0).otherwise(1)
    joined = found.where(border).withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w)).groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return found.where(~border).unionByName(joined.drop("__run")).where(F.col("length") >= least)
