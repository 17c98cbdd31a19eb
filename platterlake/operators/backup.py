"""Backups as jobs over blocks: live blocks, hashed and written; and the check that they can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions import digests

METADATA = """version INT, created STRING, source_device STRING, source_size_bytes DECIMAL(20,0), partition_table_type STRING,
checksum_type STRING, compression_type STRING, split_size_mib INT, sector_by_sector BOOLEAN, layout STRING,
alignment STRUCT<first_partition_lba: BIGINT, alignment_sectors: BIGINT, heads: INT, sectors_per_track: INT>,
partitions ARRAY<STRUCT<index: INT, type_name: STRING, start_lba: BIGINT, original_size_bytes: BIGINT, imaged_size_bytes: BIGINT,
minimum_size_bytes: BIGINT, is_logical: BOOLEAN, checksum: STRING, compressed_files: ARRAY<STRING>>>,
bad_sectors ARRAY<STRUCT<partition: INT, sector: BIGINT, lba: BIGINT, timestamp: STRING>>"""


def write_blocks(blocks: DataFrame, path: str, keep_zeros: bool = False) -> None:
    """Blocks (image_id, part_index, block_no, bytes) as Parquet, a folder for each partition; blocks of zeros are left out."""
    rows = blocks if keep_zeros else blocks.where(~digests.is_zero(F.col("bytes")))
    rows.repartition("image_id", "part_index", F.floor(F.col("block_no") / 65536)).sortWithinPartitions("block_no").write.partitionBy("image_id", "part_index").option("compression", "zstd").parquet(path)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each metadata.json; every field may be absent."""
    return spark.read.schema(METADATA).option("multiLine", True).json(folder)


def partitions_of(metadata: DataFrame) -> DataFrame:
    return metadata.select("source_device", "partition_table_type", F.inline_outer("partitions"))


def manifest(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of every stream of blocks."""
    return digests.of_chunks(blocks, keys, "block_no", "bytes")


def verify(expected: DataFrame, found: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """keys and state (ok, damaged, missing or unexpected) of digests against those that were stored."""
    a = expected.select(*keys, F.lower(digest).alias("want"))
    b = found.select(*keys, F.lower(digest).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("got"), "ok").otherwise("damaged")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): every row as JSON, for results of any size."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def envelope(rows: DataFrame, status: str = "ok") -> DataFrame:
    """One JSON result: schema version, status and the rows, which one task holds; json_lines has no such bound."""
    return rows.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(status).alias("status"), F.collect_list(F.struct(*rows.columns)).alias("result"))).alias("envelope"))


def require_flat(df: DataFrame) -> None:
    """An error where a column is nested, which no CSV holds."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    if nested:
        raise ValueError(f"nested columns need JSON: {', '.join(nested)}")


def write_flat(df: DataFrame, path: str, tabs: bool = False) -> None:
    require_flat(df)
    df.write.option("header", True).option("sep", "\t" if tabs else ",").csv(path)


def backup_name(size: Column, label: Column, stem: Column, at: Column) -> Column:
    """SIZE-LABEL-time, of which what is null is left out; the label falls back to the source's stem."""
    from platterlake.functions.names import sanitize
    from platterlake.functions.sizes import format_size_short

    chosen = F.coalesce(F.nullif(sanitize(F.trim(label)), F.lit("")), sanitize(stem))
    return F.concat_ws("-", format_size_short(size), chosen, F.date_format(at, "yyyy-MM-dd-HHmm"))
