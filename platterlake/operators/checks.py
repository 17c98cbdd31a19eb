"""Integrity checks. Every check is a query whose rows are issues: (image_id, severity, code, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def issue(rows: DataFrame, code: str, message: Column, severity: str = "error", image: str = "image_id") -> DataFrame:
    return rows.select(F.col(image).cast("string").alias("image_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.cast("string").alias("message"))


def orphans(rows: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known.select(F.col(known_key or key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def counts_differ(parents: DataFrame, key: str, stored: str, children: DataFrame, parent_key: str) -> DataFrame:
    """Parents whose stored count is not the number of their children, with `found`."""
    found = children.groupBy(F.col(parent_key).alias("__k")).agg(F.count(F.lit(1)).alias("found"))
    joined = parents.join(found, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where(F.col(stored) != F.col("found"))


def overlaps(rows: DataFrame, keys: list[str], start: str, stop: str, tie: str) -> DataFrame:
    """Rows that begin before an earlier one of their keys ends, with `before`: the largest end so far."""
    so_far = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.max(stop).over(so_far)).where(F.col(start) < F.col("before"))


def out_of_order(rows: DataFrame, keys: list[str], place: str, key: str) -> DataFrame:
    """Rows whose key is not above that of the row before them, with `previous`."""
    previous = F.lag(key).over(Window.partitionBy(*keys).orderBy(place))
    return rows.withColumn("previous", previous).where(F.col("previous") >= F.col(key))


def broken_links(nodes: DataFrame, keys: list[str], place: str, node: str, forward: str, back: str) -> DataFrame:
    """Nodes of a chain whose neighbour does not link back."""
    w = Window.partitionBy(*keys).orderBy(place)
    rows = nodes.withColumn("next_node", F.lead(node).over(w)).withColumn("next_back", F.lead(back).over(w))
    return rows.where(~F.col("next_node").eqNullSafe(F.col(forward)) | (F.col("next_node").isNotNull() & ~F.col("next_back").eqNullSafe(F.col(node))))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def bitmap_differences(computed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and problem: of a referenced block that is marked free, or a marked one that nothing references."""
    a = computed.select(*keys).distinct().withColumn("referenced", F.lit(True))
    b = stored.select(*keys).distinct().withColumn("marked", F.lit(True))
    both = a.join(b, keys, "full")
    problem = F.when(F.col("marked").isNull(), "referenced_but_free").when(F.col("referenced").isNull(), "marked_but_unreferenced")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def replica_differences(copies: DataFrame, primary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, expected, found) of replicas that differ from the primary row of their image; null equals null."""
    first = primary.select(F.col("image_id"), *(F.col(f).alias(f"p_{f}") for f in fields))
    joined = copies.join(first, "image_id")
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").cast("string").alias("expected"), F.col(f).cast("string").alias("found")) for f in fields))
    return joined.select("image_id", key, F.inline(cells)).where(~F.col("expected").eqNullSafe(F.col("found")))


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict(images: DataFrame, issues: DataFrame) -> DataFrame:
    """errors, warnings and is_clean of every image; only errors count against it."""
    found = issues.groupBy("image_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = images.select(F.col("image_id").cast("string").alias("image_id")).distinct().join(found, "image_id", "left")
    return joined.select("image_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("is_clean"))


def check_catalog(directories: DataFrame, threads: DataFrame, entries: DataFrame) -> DataFrame:
    """Issues of a catalog tree.

    directories: (image_id, cnid, parent, name, valence); threads: (image_id, cnid, parent, name); entries: (image_id, cnid,
    parent, name, kind).
    """
    key = ["image_id", "cnid"]
    text = lambda label, c: F.concat(F.lit(f"{label} "), F.col(c).cast("string"))
    missing = issue(directories.join(threads.select(*key), key, "left_anti"), "MissingDirThread", text("directory", "cnid"))
    loose = issue(threads.join(directories.select(*key), key, "left_anti"), "OrphanedThread", text("thread", "cnid"))
    homes = directories.select("image_id", F.col("cnid").alias("parent"))
    lost = issue(entries.join(homes, ["image_id", "parent"], "left_anti"), "MissingParent", text("entry", "cnid"))
    t = threads.select("image_id", "cnid", F.col("parent").alias("t_parent"), F.col("name").alias("t_name"))
    differ = issue(directories.join(t, key).where(~F.struct("parent", "name").eqNullSafe(F.struct("t_parent", "t_name"))), "ThreadParentNameMismatch", text("directory", "cnid"))
    children = entries.groupBy("image_id", F.col("parent").alias("cnid")).agg(F.count(F.lit(1)).alias("found"))
    valence = directories.join(children, key, "left").where(F.col("valence") != F.coalesce("found", F.lit(0)))
    twice = issue(duplicates(entries, key), "DuplicateCnid", text("entry", "cnid"))
    return report([missing, loose, lost, differ, issue(valence, "ParentValenceMismatch", text("directory", "cnid")), twice])


def catalog_relations(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What check_catalog takes, from catalog records (image_id, part_index, record, cnid, parent, name, valence) of volumes."""
    rows = catalog.withColumn("image_id", F.concat("image_id", F.lit("@"), F.col("part_index").cast("string")))
    folders = rows.where("record = 'directory'").select("image_id", "cnid", "parent", "name", "valence")
    threads = rows.where("record = 'directory thread'").select("image_id", "cnid", "parent", "name")
    # the root folder lies below the number 1, which no folder has
    entries = rows.where("record IN ('directory', 'file') AND parent != 1").select("image_id", "cnid", "parent", "name", F.col("record").alias("kind"))
    return folders, threads, entries


def check_blocks(entries: DataFrame, allocation: DataFrame, span: int = 1 << 15) -> DataFrame:
    """Issues of files' extents: blocks that a volume's map calls free, and blocks that two files have.

    entries: (image_id, part_index, path, extents); allocation: (image_id, part_index, start, blocks, used). Ranges meet in the
    spans of block numbers that they touch, so no task sees a whole volume.
    """
    key = ["image_id", "part_index", "span"]
    spans = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / span), F.floor((F.col(a) + F.col(n) - 1) / span)))
    held = entries.select("image_id", "part_index", "path", F.inline("extents")).where("blocks > 0").select("image_id", "part_index", "path", "start", "blocks", spans("start", "blocks").alias("span"))
    free = allocation.where("NOT used").select("image_id", "part_index", F.col("start").alias("a"), F.col("blocks").alias("n"), spans("start", "blocks").alias("span"))
    wrong = held.join(free, key).where((F.col("start") < F.col("a") + F.col("n")) & (F.col("a") < F.col("start") + F.col("blocks")))
    unmapped = issue(wrong.select("image_id", "part_index", "path", "start").distinct(), "ReferencedButFree", F.concat(F.lit("extent "), F.col("start").cast("string"), F.lit(" of "), F.col("path")))
    w = Window.partitionBy(*key).orderBy("start", "path").rowsBetween(Window.unboundedPreceding, -1)
    twice = held.withColumn("before", F.max(F.col("start") + F.col("blocks")).over(w)).where(F.col("start") < F.col("before"))
    shared = issue(twice.select("image_id", "part_index", "path", "start").distinct(), "OverlappingExtents", F.concat(F.lit("extent "), F.col("start").cast("string"), F.lit(" of "), F.col("path")))
    return report([unmapped, shared])


def check_links(links: DataFrame) -> DataFrame:
    """Issues of inodes whose stored links are not as many as the names that lead to them.

    links: (image_id, part_index, record, inode, links, child), rows of inodes and of names.
    """
    key = ["image_id", "part_index"]
    names = links.where("record = 'name'").groupBy(*key, F.col("child").alias("inode")).agg(F.count(F.lit(1)).alias("found"))
    stored = links.where("record = 'inode'").select(*key, "inode", "links").distinct()
    both = stored.join(names, [*key, "inode"], "full").withColumn("found", F.coalesce("found", F.lit(0)))
    text = F.concat(F.lit("inode "), F.col("inode").cast("string"), F.lit(" has "), F.coalesce(F.col("links").cast("string"), F.lit("no")), F.lit(" links and "), F.col("found").cast("string"), F.lit(" names"))
    return issue(both.where(~F.col("links").eqNullSafe(F.col("found"))), "LinkCountMismatch", text)


def check_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Issues of all volumes of the images under a path: catalogs of HFS and HFS+, blocks where a map is read, links of EFS, UFS
    and XFS, and what the drivers' own checks find."""
    from platterlake.sources import readers

    catalog = check_catalog(*catalog_relations(readers.read_catalog(spark, path, glob)))
    blocks = check_blocks(readers.read_entries(spark, path, glob=glob), readers.read_allocation(spark, path, glob))
    return report([catalog, blocks, check_links(readers.read_links(spark, path, glob)), readers.read_problems(spark, path, glob).select("image_id", "severity", "code", "message")])
