"""Compaction: live blocks only, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block numbers ranked, or made, by one task at a time.
SEGMENT = 1 << 20


def live(blocks: DataFrame, allocation: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that the allocation marks as used."""
    return blocks.join(allocation.where("used").select(*keys), keys, "left_semi")


def expand(totals: DataFrame, used: DataFrame, image: str = "image_id") -> DataFrame:
    """A row for every block of an image (image, blocks); bytes are null where no used block has them.

    Numbers are made in two steps, SEGMENT at a time and dealt out in between, so no row holds those of a whole image.
    """
    last = F.col("blocks") - 1
    segments = totals.where("blocks > 0").select(image, "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SEGMENT))).alias("segment"))
    first = F.col("segment") * SEGMENT
    every = segments.repartition(image, "segment").select(image, F.explode(F.sequence(first, F.least(first + SEGMENT - 1, last))).alias("block_no"))
    return every.join(used, [image, "block_no"], "left")


def renumber(allocation: DataFrame, keys: list[str], block: str = "block_no") -> DataFrame:
    """keys, block and new_block: the place of each live block once packed.

    Blocks are ranked within segments of their numbers; a segment starts at the count of all before it, so no task ranks a
    whole image.
    """
    live = allocation.where("used").select(*keys, block, F.floor(F.col(block) / SEGMENT).alias("__segment"))
    counts = live.groupBy(*keys, "__segment").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__segment", before.alias("__first"))
    n = F.row_number().over(Window.partitionBy(*keys, "__segment").orderBy(block)) - 1
    return live.withColumn("__n", n).join(starts, [*keys, "__segment"]).select(*keys, block, (F.col("__n") + F.col("__first")).cast("long").alias("new_block"))


def fragmentation(extents: DataFrame, keys: list[str], file: str = "path") -> DataFrame:
    """files, fragmented and percent (float; null where no file has data) from extents."""
    per_file = extents.groupBy(*keys, file).agg(F.count_if(F.col("block_count") > 0).alias("n"))
    some, many = F.count_if(F.col("n") > 0), F.count_if(F.col("n") > 1)
    return per_file.groupBy(*keys).agg(some.alias("files"), many.alias("fragmented"), (100 * many / F.nullif(some, F.lit(0))).cast("float").alias("percent"))


def sizes(extents: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """used, last_data_byte and packed bytes of a volume (keys, total, unit); without extents its total is the last byte."""
    found = extents.groupBy(*keys).agg(F.sum("length").alias("used"), F.max(F.col("start") + F.col("length")).alias("last"))
    joined = volumes.join(found, keys, "left")
    return joined.select(*keys, F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("last", "total").alias("last_data_byte"), (F.ceil(F.coalesce("used", F.lit(0)) / F.col("unit")) * F.col("unit")).alias("packed"))


def minimum_size(volumes: DataFrame, cheap: Column, expensive: Column, allow_expensive: bool) -> DataFrame:
    """minimum and state: an expensive minimum is deferred unless it is allowed, and then not even planned."""
    value = F.coalesce(cheap, expensive) if allow_expensive else cheap
    return volumes.withColumn("minimum", value).withColumn("state", F.when(value.isNotNull(), "known").otherwise("unknown" if allow_expensive else "deferred"))


def export_usage(partitions: DataFrame, output_bytes: Column, resizing: bool) -> DataFrame:
    """Bytes that an export needs: working space only where partitions are resized, and the output."""
    counted = F.when(~F.col("is_extended") & (F.coalesce(F.col("type_byte"), F.lit(0)) != 0xEE), F.col("size_bytes")).otherwise(0)
    work = F.sum(counted) + (1 << 20) if resizing else F.lit(0).cast("long")
    return partitions.groupBy("image_id").agg(work.alias("work"), F.max(output_bytes).alias("output")).withColumn("total", F.col("work") + F.col("output"))
