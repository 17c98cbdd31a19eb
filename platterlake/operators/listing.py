"""Listings: order, counts, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.staging import settled


def sort_listing(rows: DataFrame, key: Column, is_dir: Column, ordinal: Column, descending: bool = False) -> DataFrame:
    """Folders first in both directions; ties in the order of input, reversed where descending."""
    return rows.orderBy(is_dir.desc(), *((key.desc_nulls_last(), ordinal.desc()) if descending else (key.asc_nulls_first(), ordinal)))


def tree_counts(entries: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Directories, and everything else counted as files."""
    return entries.groupBy(*keys).agg(F.count_if(F.col(kind) == "directory").alias("directories"), F.count_if(F.col(kind) != "directory").alias("files"))


def closure(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth, path) of a forest by pointer doubling: rounds in the logarithm of its depth.

    Edges whose parent is absent are roots. Nodes on a cycle, or below one, are left out: in a round that finishes no node,
    only these remain.
    """
    nodes = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = nodes.select(F.col("node").alias("k")).distinct()
    state = settled(nodes.join(known, F.col("parent") == F.col("k"), "left").select("node", F.col("k").alias("up"), F.array("node").alias("path")))
    left = state.where("up IS NOT NULL").count()
    while left:
        above = state.select(F.col("node").alias("n"), F.col("up").alias("up2"), F.col("path").alias("p2"))
        moved = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("n")).select("node", F.col("up2").alias("up"), F.concat("p2", "path").alias("path"))
        state = settled(state.where("up IS NULL").union(moved))
        before, left = left, state.where("up IS NOT NULL").count()
        if left == before:
            break
    return state.where("up IS NULL").select("node", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path")


def tree_text(entries: DataFrame) -> DataFrame:
    """(image_id, path, line): a listing's lines in depth-first order, two spaces for every level."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != "")) - 1
    return entries.select("image_id", "path", F.concat(F.repeat(F.lit("  "), depth), "name", F.when(F.col("kind") == "directory", "/").otherwise("")).alias("line")).orderBy("image_id", F.split("path", "/"))


def select_range(rows: DataFrame, order: list[Column], first: Column, last: Column) -> DataFrame:
    """Rows between those that satisfy `first` and those that satisfy `last`, in the order of unique keys.

    Two bounds are aggregated and compared with; nothing is ranked, so no task sees all rows.
    """
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    keyed = rows.withColumn("__key", key)
    either = keyed.where(first | last).agg(F.min("__key").alias("__a"), F.max("__key").alias("__b"))  # one row
    return keyed.join(F.broadcast(either), F.col("__key").between(F.col("__a"), F.col("__b"))).drop("__key", "__a", "__b")


def _stem_and_ending(name: Column) -> tuple[Column, Column]:
    """The text before the last dot, and the dot and what follows; no ending where either part is empty."""
    split = name.rlike(r"(?s)\A.+\.[^.]+\z")
    return F.when(split, F.regexp_extract(name, r"(?s)\A(.+)\.[^.]+\z", 1)).otherwise(name), F.when(split, F.regexp_extract(name, r"(\.[^.]+)\z", 1)).otherwise("")


def unique_names(rows: DataFrame, folder: str, name: str, ordinal: str) -> DataFrame:
    """Names that a folder already has get the suffix ~1, ~2 and so on before their ending, the first that is free, in the
    order of `ordinal`.

    Only names alike but for such suffixes compete. Where none of these has a suffix of its own, the rank among equal names is
    the suffix; only groups in which one has are walked row by row.
    """
    from pyspark.sql import Window

    stem, ending = _stem_and_ending(F.col(name))
    bare = F.regexp_replace(stem, r"(?:~[0-9]+)+\z", "")
    keyed = rows.withColumn("__key", F.concat(bare, ending)).withColumn("__suffixed", bare != stem)
    odd = settled(keyed.where("__suffixed").select(F.col(folder).alias("__f"), F.col("__key").alias("__k")).distinct())
    here = F.col(folder).eqNullSafe(F.col("__f")) & F.col("__key").eqNullSafe(F.col("__k"))
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(ordinal)) - 1
    plain = keyed.join(odd, here, "left_anti").withColumn("unique_name", F.when(n > 0, F.concat(stem, F.lit("~"), n.cast("string"), ending)).otherwise(F.col(name)))

    def walk(frame):
        taken, out = set(), []
        frame = frame.sort_values(ordinal, kind="stable")
        for text in frame[name]:
            if text is not None and text in taken:
                head, dot, tail = text.rpartition(".")
                head, tail = (head, dot + tail) if head and tail else (text, "")
                k = 1
                while f"{head}~{k}{tail}" in taken:
                    k += 1
                text = f"{head}~{k}{tail}"
            taken.add(text)
            out.append(text)
        return frame.assign(unique_name=out)

    some = keyed.join(odd, here, "left_semi")
    schema = ", ".join(f"`{c}` {t}" for c, t in some.dtypes) + ", unique_name string"
    walked = some.groupBy(folder, "__key").applyInPandas(walk, schema)
    return plain.unionByName(walked).drop("__key", "__suffixed")
