"""Images as tables. Only ranges of a file are read: tables and directories, and contents where they are asked for.

Every partition of every image is a task's work of its own. Stores that pyarrow does not know are read whole by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

from platterlake.shipping import ship
from platterlake.sources import archives, containers, filesystems, journal, partitions, ranged, sniff
from platterlake.sources.entries import ALLOCATION, CATALOG, LINKS, PROBLEMS

BLOCKS = "image_id string, block_no bigint, bytes binary"
_PARTS = "path string, part_index int, start bigint, size bigint"


def _reader(data):
    return lambda at, size: data[at : at + size].ljust(size, b"\0")


def _partition_rows(path: str, data) -> Iterator[tuple]:
    disk = containers.opened(data, path)
    for row in partitions.partitions(_reader(disk), len(disk)):
        yield (path, *row)


def _volumes(path: str, data, only: int | None = None) -> Iterator[tuple]:
    """(path, part_index, start, size) of what holds entries; an archive is one volume, -1."""
    if archives.kind_of(data):
        yield (path, -1, 0, len(data))
        return
    for _, index, *_, start, size, _, _, extended in _partition_rows(path, data):
        if not extended and (only is None or index == only):
            yield (path, index, start, size)


def _volume_rows(path: str, index: int, start: int, size: int, data, contents: bool, limit: int | None) -> Iterator[tuple]:
    if index < 0:
        kind = archives.kind_of(data)
        for e in archives.READERS[kind](bytes(data[:]), contents):
            yield e.row(path, 0, kind)
        return
    fs, found = filesystems.entries(ranged.View(containers.opened(data, path), start, size), contents, limit)
    for e in found:
        yield e.row(path, index, fs)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("array<struct<start:bigint,blocks:bigint>>", "x").split(", ")]


def _in_parts(rows: Iterator[tuple], names: list[str], count: int = 2000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == count:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, length, content) of all files under a path. Spark lists them; content is null where ranges can be read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    first = found.select("path").first()
    whole = first is not None and not ranged.reachable(first["path"])
    return found.select("path", "length", "content") if whole else found.select("path", "length", F.lit(None).cast("binary").alias("content"))


def _source(path: str, content: bytes | None):
    return ranged.open_file(path) if content is None else content


def _mapped(files: DataFrame, rows, schema: str) -> DataFrame:
    """rows(path, source) of every file."""
    names = _names(schema)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from _in_parts(rows(path, _source(path, content)), names)

    return files.select("path", "content").mapInPandas(each, schema)


def read_partitions(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The partition relation of all images under a path."""
    return _mapped(_files(spark, path, glob), _partition_rows, partitions.SCHEMA)


def read_entries(spark: SparkSession, path: str, contents: bool = False, glob: str | None = None, carve_limit: int | None = None, partition: int | None = None) -> DataFrame:
    """The catalog of every volume of all images and archives under a path; carve_limit: bytes of an unknown volume scanned for
    text, None for all; partition: only that of each image."""
    return _by_volume(spark, path, glob, partition, lambda *volume: _volume_rows(*volume, contents, carve_limit), filesystems.SCHEMA, 200 if contents else 2000)


def read_allocation(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Runs of used and of free blocks of every volume whose driver reads its map: FAT, ext, HFS, HFS+ and NTFS."""

    def rows(name: str, index: int, start: int, size: int, data) -> Iterator[tuple]:
        if index >= 0:
            fs, unit, runs = filesystems.allocation(ranged.View(containers.opened(data, name), start, size))
            yield from ((name, index, fs, unit, *run) for run in runs)

    return _by_volume(spark, path, glob, None, rows, ALLOCATION)


def read_catalog(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The catalog records of every HFS and HFS+ volume: folders, files and threads, with the folders' stored valences."""
    return _by_volume(spark, path, glob, None, _of_volume(filesystems.catalog), CATALOG)


def read_links(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Inodes with their stored links, and names with what they name, of every EFS, UFS and XFS volume."""
    return _by_volume(spark, path, glob, None, _of_volume(filesystems.links), LINKS)


def read_problems(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """What the drivers' own checks find wrong with volumes: those of AFFS."""
    return _by_volume(spark, path, glob, None, _of_volume(filesystems.problems), PROBLEMS)


def read_journal(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The sectors that a replay of every HFS+ volume's journal writes, for diff.overlay."""
    return _by_volume(spark, path, glob, None, _of_volume(journal.transactions), journal.SCHEMA, 200)


def _of_volume(read):
    def rows(name: str, index: int, start: int, size: int, data) -> Iterator[tuple]:
        if index >= 0:
            yield from ((name, index, *r) for r in read(ranged.View(containers.opened(data, name), start, size)))

    return rows


def _by_volume(spark: SparkSession, path: str, glob: str | None, partition: int | None, rows, schema: str, count: int = 2000) -> DataFrame:
    """rows(path, part_index, start, size, source) of every volume, each in a task's work of its own."""
    files = _files(spark, path, glob)
    volumes = _mapped(files, lambda name, data: _volumes(name, data, partition), _PARTS).repartition("path", "part_index")
    dealt = volumes.join(files.select("path", "content"), "path") if _whole(files) else volumes.withColumn("content", F.lit(None).cast("binary"))
    names = _names(schema)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, index, start, size, content in zip(*(batch[c] for c in ("path", "part_index", "start", "size", "content")), strict=True):
                yield from _in_parts(rows(name, index, start, size, _source(name, content)), names, count)

    return dealt.select("path", "part_index", "start", "size", "content").mapInPandas(each, schema)


def _whole(files: DataFrame) -> bool:
    first = files.select("path").first()
    return first is not None and not ranged.reachable(first["path"])


def probe(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, container, scheme, fs_type) of image files. Of a file that no rule knows as a floppy only the first
    68 KiB, the partition tables and the last sector are read."""

    def rows(name: str, data) -> Iterator[tuple]:
        kind = containers.name_of(data, name)
        yield (name, len(data), kind, partitions.detect(_reader(data)), sniff.filesystem_of(data))

    return _mapped(_files(spark, path, glob), rows, "path string, length bigint, container string, scheme string, fs_type string")


def read_blocks(spark: SparkSession, path: str, size: int = 65536, glob: str | None = None) -> DataFrame:
    """(image_id, block_no, bytes) of the disks in containers under a path, without blocks of zeros. Ranges of SPAN blocks of
    an image are tasks of their own."""
    files = _files(spark, path, glob)
    if _whole(files):
        return _mapped(files, lambda name, data: _block_rows(name, containers.opened(data, name), size), BLOCKS)
    spans = _mapped(files, lambda name, data: ((name, k) for k in range(-(-len(containers.opened(data, name)) // (size * SPAN)))), "path string, span bigint")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, k in zip(batch["path"], batch["span"], strict=True):
                yield from _in_parts(_block_rows(name, containers.opened(ranged.open_file(name), name), size, k * SPAN, SPAN), _names(BLOCKS), 64)

    return spans.repartition("path", "span").mapInPandas(each, BLOCKS)


#: Blocks of an image that one task reads in a row.
SPAN = 1 << 12


def _block_rows(name: str, disk, size: int, first: int = 0, count: int | None = None) -> Iterator[tuple]:
    last = -(-len(disk) // size)
    for n in range(first, last if count is None else min(last, first + count)):
        part = bytes(disk[n * size : (n + 1) * size])
        if part.count(0) != len(part):
            yield (name, n, part)


def _entry_rows(path: str, data, contents: bool, only: int | None = None, limit: int | None = None) -> Iterator[tuple]:
    for volume in _volumes(path, data, only):
        yield from _volume_rows(*volume, data, contents, limit)


class _ImageReader(DataSourceReader):
    def __init__(self, options: dict, rows, path_at: int | None):
        self.options, self.rows, self.prefix, self.path_at = options, rows, "", path_at

    def pushFilters(self, filters):
        """Prefixes of paths are applied before rows leave the reader; everything else stays with Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and self.path_at is not None and f.attribute == ("path",):
                self.prefix = f.value
            yield f

    def partitions(self):
        """A split for every file; folders are listed by pyarrow, so that it reads the stores that open_file does."""
        from pyarrow import fs

        path = self.options["path"]
        scheme = path.split("://")[0] if "://" in path else ""
        store, inner = fs.FileSystem.from_uri(path.replace(f"{scheme}:", f"{ranged.KNOWN[scheme]}:", 1)) if scheme in ranged.KNOWN else (fs.LocalFileSystem(), path.removeprefix("file://"))
        info = store.get_file_info(inner)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        head = f"{scheme}://" if scheme in ranged.KNOWN else ""
        return [InputPartition(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file]

    def read(self, partition):
        for row in self.rows(partition.value, ranged.open_file(partition.value)):
            if not self.prefix or row[self.path_at].startswith(self.prefix):
                yield row


class DiskPartitions(DataSource):
    """spark.read.format("diskpart"): partition tables of images in a folder that every machine sees."""

    @classmethod
    def name(cls):
        return "diskpart"

    def schema(self):
        return partitions.SCHEMA

    def reader(self, schema):
        return _ImageReader(self.options, _partition_rows, None)


class FilesystemEntries(DataSource):
    """spark.read.format("fsentries"): catalogs; options partition (a number), contents (true or false) and carve_limit (bytes)."""

    @classmethod
    def name(cls):
        return "fsentries"

    def schema(self):
        return filesystems.SCHEMA

    def reader(self, schema):
        contents, only = self.options.get("contents", "false").lower() == "true", self.options.get("partition")
        limit = self.options.get("carve_limit")
        return _ImageReader(self.options, lambda p, d: _entry_rows(p, d, contents, None if only is None else int(only), None if limit is None else int(limit)), 3)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it hand filters to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (DiskPartitions, FilesystemEntries):
        spark.dataSource.register(source)


def clonezilla_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """(device, start, size, type, fs) from the text files of a saved disk."""
    lines = spark.read.text(f"{folder}/*-pt.sf").where(F.col("value").rlike(r"^/dev/\S+ *: "))
    value = lambda key: F.regexp_extract("value", rf"{key}= *([0-9A-Za-z-]+)", 1)
    table = lines.select(F.regexp_extract("value", r"^/dev/(\S+) *:", 1).alias("device"), value("start").cast("long").alias("start"), value("size").cast("long").alias("size"), value("(?:type|Id)").alias("type"))
    kinds = spark.read.text(f"{folder}/dev-fs.list").where(~F.col("value").rlike("^#")).select(F.regexp_extract("value", r"^/dev/(\S+)\s+(\S+)", 1).alias("device"), F.regexp_extract("value", r"^/dev/(\S+)\s+(\S+)", 2).alias("fs"))
    return table.join(kinds, "device", "left")
