"""Edits as tables: a change log folded over a catalog, and scripts of tagged operations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.staging import settled

#: Operations of a script and the fields each must have.
OPERATIONS = {"mkdir": ("path",), "put": ("path", "source"), "rm": ("path",), "format": ("fs",), "bless": ("path",), "chmeta": ("path",), "setrsrc": ("path", "source")}


def under(path: str, root: str):
    """Whether a path is a root or below it."""
    return (F.col(path) == F.col(root)) | F.startswith(F.col(path), F.concat(F.col(root), F.lit("/")))


VALUES = ("kind", "size", "mode")
_BEFORE = -(1 << 63)


def _ancestors(path: str):
    """A path and all that it lies below."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def fates(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """(origin, born, path, since, until): the paths that every entry had, in which edits. until is null for the last one of
    an entry that is still there.

    An entry is told by its first path and the edit that made it. Every round finds, by equality joins on the entries'
    ancestors, the next edit that moves or ends each entry; there are as many rounds as one entry has moves, and only entries
    that edits touch take part.
    """
    is_move, is_end = F.col("op") == "rename", F.col("op") == "delete"
    moves = edits.where(is_move | is_end).select(F.col("path").alias("root"), F.struct("seq", F.lit(True).alias("below"), F.when(is_move, F.col("new_path")).alias("to"), F.col("path").alias("old")).alias("event"))
    # what is made at a path, or moved there, takes the place of the entry itself, not of what lies below
    taken = edits.where((F.col("op") == "create") | is_move).select(F.when(is_move, F.col("new_path")).otherwise(F.col("path")).alias("root"), F.struct("seq", F.lit(False).alias("below"), F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("old")).alias("event"))
    events = settled(moves.unionByName(taken).distinct())
    made = edits.where("op = 'create'").select(F.col("path").alias("origin"), F.col("seq").cast("long").alias("born"))
    open_ = entries.select(F.col("path").alias("origin"), F.lit(_BEFORE).alias("born")).unionByName(made).select("*", F.col("origin").alias("path"), F.col("born").alias("since"))
    done = []
    while True:
        chain = open_.select("*", F.explode(_ancestors("path")).alias("root"))
        hits = chain.join(events, "root").where((F.col("event.seq") > F.col("since")) & (F.col("event.below") | (F.col("root") == F.col("path"))))
        # a deletion or a move names the entry's place at that time; of one edit, what it takes away comes first
        nexts = settled(hits.groupBy("origin", "born", "path", "since").agg(F.min("event").alias("e")))
        done.append(open_.join(nexts.select("origin", "born"), ["origin", "born"], "left_anti").select("origin", "born", "path", "since", F.lit(None).cast("long").alias("until")))
        if nexts.isEmpty():
            break
        done.append(nexts.select("origin", "born", "path", "since", F.col("e.seq").cast("long").alias("until")))
        rest = F.expr("substring(path, length(e.old) + 1)")
        open_ = settled(nexts.where("e.to IS NOT NULL").select("origin", "born", F.concat("e.to", rest).alias("path"), F.col("e.seq").cast("long").alias("since")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def apply_edits(entries: DataFrame, edits: DataFrame, values: tuple[str, ...] = VALUES) -> DataFrame:
    """entries (path and values) after edits (seq, op, path, new_path and the same values), applied in the order of seq.

    op: create, set, delete or rename, the last two with all that lies below the path at that time. values: the columns that
    create and set give, such as kind, size and mode, or types, creators, dates and link targets; set keeps what it leaves
    null. What is created at a path, or moved there, replaces the entry there, and what folders have in common when one is
    moved onto another is the later arrival's; seq must not repeat for what concerns one entry. Otherwise an edit of a path that
    does not exist then changes nothing. The result is a new version, so a failed edit leaves the old one.
    """
    life = settled(fates(entries, edits))
    first = entries.select(F.col("path").alias("origin"), F.lit(_BEFORE).alias("born"), *values).unionByName(edits.where("op = 'create'").select(F.col("path").alias("origin"), F.col("seq").cast("long").alias("born"), *values))
    sets = edits.where("op = 'set'").select("path", F.col("seq").cast("long").alias("seq"), *(F.col(c).alias(f"n_{c}") for c in values))
    told = life.join(sets, "path").where((F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
    last = told.groupBy("origin", "born").agg(*(F.max_by(f"n_{c}", F.when(F.col(f"n_{c}").isNotNull(), F.col("seq"))).alias(f"n_{c}") for c in values))
    there = life.where("until IS NULL").groupBy("path").agg(F.max(F.struct("since", "born", "origin")).alias("e"))
    alive = there.select("path", "e.origin", "e.born")
    joined = first.join(alive, ["origin", "born"]).join(last, ["origin", "born"], "left")
    return joined.select("path", *(F.coalesce(f"n_{c}", c).alias(c) for c in values))


def space_delta(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """added and freed bytes of a change log: what create makes, and what deletions remove of the entries from before, with
    all that lies below the deleted paths."""
    gone = edits.where("op = 'delete'").select(F.col("path").cast("string").alias("root"))
    old = entries.select(F.col("path").cast("string").alias("path"), "size")
    dead = old.withColumn("root", F.explode(_ancestors("path"))).join(gone, "root", "left_semi").select("path", "size").distinct()
    none = F.lit(0).cast("long")
    both = edits.where("op = 'create'").select(F.col("size").alias("added"), none.alias("freed")).union(dead.select(none, "size"))
    return both.agg(F.coalesce(F.sum("added"), none).alias("added"), F.coalesce(F.sum("freed"), none).alias("freed"))


def script(spark: SparkSession, text: str) -> DataFrame:
    """(seq, op, path, args as JSON) of a script, an array of operations tagged by `op`; an error for one that is not valid."""
    rows = []
    for seq, step in enumerate(json.loads(text)):
        op = step.get("op")
        if op not in OPERATIONS:
            raise ValueError(f"operation {seq}: no such op {op!r}")
        if absent := [f for f in OPERATIONS[op] if f not in step]:
            raise ValueError(f"operation {seq}: {op} needs {', '.join(absent)}")
        rows.append((seq, op, step.get("path"), json.dumps(step, sort_keys=True)))
    return spark.createDataFrame(rows, "seq long, op string, path string, args string")


def script_for(files: DataFrame) -> DataFrame:
    """(step): JSON operations that make a tree of (path, kind): folders before what they hold."""
    step = F.when(F.col("kind") == "directory", F.to_json(F.struct(F.lit("mkdir").alias("op"), "path"))).otherwise(F.to_json(F.struct(F.lit("put").alias("op"), "path", F.col("path").alias("source"))))
    return files.select("path", "kind", step.alias("step")).orderBy(F.col("kind") != "directory", F.size(F.split("path", "/")), "path")
