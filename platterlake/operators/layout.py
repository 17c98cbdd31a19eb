"""Layouts: where partitions go. Rows feed back into the next one, so an image's few partitions are folded in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.sizes import SECTOR, align_up


def _folded(rows: DataFrame, order: Column, fields: list[str], start: Column, step) -> DataFrame:
    """image_id and `out`, an array that step(state, row) makes, row by row in the order. state has at and out."""
    row = F.struct(order.alias("o"), *fields)
    gathered = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return gathered.select("image_id", F.aggregate("rows", start, step)["out"].alias("out"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows and the sum of a value up to each of them, in the order within their keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def size_choices(partitions: DataFrame, choices: DataFrame, key: str, default: str = "original") -> DataFrame:
    """partitions and choice: what is chosen for their key in (key, choice), else the default."""
    return partitions.join(choices.select(F.col(key).alias("__key"), F.col("choice").alias("__choice")), F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("choice", F.coalesce("__choice", F.lit(default))).drop("__key", "__choice")


def resize_plan(partitions: DataFrame, alignment_sectors: int = 0) -> DataFrame:
    """(image_id, part_index, old_start, new_start, new_size, move_delta, fits), bytes, of primary partitions in their order.

    partitions: (image_id, part_index, start_byte, size_bytes, new_size or null, disk_size). Every change of size, and the
    padding that alignment adds, shifts all that follows.
    """
    if alignment_sectors == 0:  # nothing feeds back: a running sum, which needs no row gathered
        w = Window.partitionBy("image_id").orderBy("start_byte", "part_index").rowsBetween(Window.unboundedPreceding, -1)
        size = F.coalesce("new_size", "size_bytes")
        shift = F.coalesce(F.sum(size - F.col("size_bytes")).over(w), F.lit(0))
        plan = partitions.withColumn("move_delta", shift).withColumn("size_", size)
        return plan.select("image_id", "part_index", F.col("start_byte").alias("old_start"), (F.col("start_byte") + F.col("move_delta")).alias("new_start"), F.col("size_").alias("new_size"), "move_delta", (F.col("start_byte") + F.col("move_delta") + F.col("size_") <= F.col("disk_size")).alias("fits"))
    kind = "array<struct<part_index:int,old_start:bigint,new_start:bigint,new_size:bigint,move_delta:bigint,fits:boolean>>"
    zero = F.struct(F.lit(0).cast("long").alias("shift"), F.array().cast(kind).alias("out"))

    def step(s, r):
        size = F.coalesce(r["new_size"], r["size_bytes"])
        raw = r["start_byte"] + s["shift"]
        at = align_up(raw, alignment_sectors * SECTOR)
        one = F.struct(r["part_index"].cast("int").alias("part_index"), r["start_byte"].alias("old_start"), at.alias("new_start"), size.alias("new_size"), (at - r["start_byte"]).alias("move_delta"), (at + size <= r["disk_size"]).alias("fits"))
        return F.struct((s["shift"] + size - r["size_bytes"] + at - raw).alias("shift"), F.concat(s["out"], F.array(one)).cast(kind).alias("out"))

    plan = _folded(partitions, F.struct("start_byte", "part_index"), ["part_index", "start_byte", "size_bytes", "new_size", "disk_size"], zero, step)
    return plan.select("image_id", F.inline("out"))


def restore_layout(partitions: DataFrame, first_lba: int = 2048, alignment_sectors: int = 2048, gpt: bool = False) -> DataFrame:
    """(image_id, part_index, new_lba, size): primaries in table order, then logicals by start, each behind a sector of its own.

    partitions: (image_id, part_index, start_lba, is_logical, size); a GPT's begin at sector 34 or later.
    """
    first = max(first_lba, 34) if gpt else first_lba
    kind = "array<struct<part_index:int,new_lba:bigint,size:bigint>>"
    zero = F.struct(F.lit(first).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(s, r):
        # the first logical one follows the container's aligned start; each has a sector before it
        at = align_up(F.when(r["is_logical"], F.when(r["first_logical"], align_up(s["at"], alignment_sectors)).otherwise(s["at"]) + 1).otherwise(s["at"]), alignment_sectors)
        one = F.struct(r["part_index"].cast("int").alias("part_index"), at.alias("new_lba"), r["size"].alias("size"))
        return F.struct((at + F.floor(r["size"] / SECTOR)).alias("at"), F.concat(s["out"], F.array(one)).cast(kind).alias("out"))

    w = Window.partitionBy("image_id", "is_logical").orderBy("start_lba", "part_index")
    rows = partitions.withColumn("first_logical", F.col("is_logical") & (F.row_number().over(w) == 1))
    order = F.struct("is_logical", F.when(F.col("is_logical"), F.col("start_lba")).otherwise(F.col("part_index").cast("long")).alias("k"))
    return _folded(rows, order, ["part_index", "is_logical", "first_logical", "size"], zero, step).select("image_id", F.inline("out"))


def keep_positions(partitions: DataFrame) -> DataFrame:
    """The layout of tables whose partitions stay where they are: only sizes change, and `collides` tells of the next start."""
    following = F.lead("start_lba").over(Window.partitionBy("image_id").orderBy("start_lba", "part_index"))
    return partitions.withColumn("collides", F.col("start_lba") * SECTOR + F.col("size") > following * SECTOR)


def detect_alignment(partitions: DataFrame) -> DataFrame:
    """(image_id, first_lba, kind, sectors) from the starts of partitions."""
    found = partitions.groupBy("image_id").agg(F.min("start_lba").alias("first_lba"), F.bool_and(F.col("start_lba") % 2048 == 0).alias("modern"), F.count(F.lit(1)).alias("n"), F.collect_set("start_lba").alias("starts"))
    # Euclid's steps for two 64-bit numbers never exceed 93
    divide = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))), lambda s: s["a"])
    gcd = F.aggregate("starts", F.lit(0).cast("long"), divide)
    custom = (F.col("n") >= 2) & (gcd > 1)
    kind = F.when(F.col("first_lba") == 63, "dos").when(F.col("modern"), "modern").when(custom, "custom").otherwise("none")
    sectors = F.when(F.col("first_lba") == 63, F.lit(16065)).when(F.col("modern"), F.lit(2048)).when(custom, gcd).otherwise(F.lit(1))
    return found.select("image_id", "first_lba", kind.alias("kind"), sectors.cast("long").alias("sectors"))


def validate(partitions: DataFrame, disk_size: Column) -> DataFrame:
    """(image_id, part_index, problem): overlaps with the one before, or an end behind the disk's."""
    rows = partitions.where(~F.col("is_extended")).withColumn("stop_lba", F.col("start_lba") + F.floor(F.col("size_bytes") / SECTOR))
    before = F.max("stop_lba").over(Window.partitionBy("image_id").orderBy("start_lba", "part_index").rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(F.col("stop_lba") * SECTOR > disk_size, "beyond the disk").when(F.col("start_lba") < before, "overlaps")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("image_id", "part_index", "problem")


def with_gaps(segments: DataFrame, total: Column) -> DataFrame:
    """Segments (image_id, offset, length, source) and, between and behind them, rows whose source is null."""
    w = Window.partitionBy("image_id").orderBy("offset")
    ends = segments.withColumn("stop", F.col("offset") + F.col("length")).withColumn("next", F.coalesce(F.lead("offset").over(w), total)).withColumn("n", F.row_number().over(w))
    after = ends.where("next > stop").select("image_id", F.col("stop").alias("offset"), (F.col("next") - F.col("stop")).alias("length"), F.lit(None).cast("string").alias("source"))
    ahead = ends.where("n = 1 AND offset > 0").select("image_id", F.lit(0).cast("long").alias("offset"), F.col("offset").alias("length"), F.lit(None).cast("string").alias("source"))
    return segments.select("image_id", "offset", "length", F.col("source").cast("string").alias("source")).union(after).union(ahead)


def apply_table_edits(partitions: DataFrame, edits: DataFrame) -> DataFrame:
    """Partitions after edits (image_id, seq, kind, part_index, value): the last edit of each kind wins; deletion removes."""
    ranked = edits.withColumn("n", F.row_number().over(Window.partitionBy("image_id", "part_index", "kind").orderBy(F.col("seq").desc()))).where("n = 1")
    kinds = ["resize", "move", "type", "delete", "bootable"]
    wide = ranked.groupBy("image_id", "part_index").pivot("kind", kinds).agg(F.first("value"))
    joined = partitions.join(wide, ["image_id", "part_index"], "left").where("delete IS NULL")
    return joined.select("image_id", "part_index", F.coalesce("move", "start_lba").alias("start_lba"), F.coalesce("resize", "size_bytes").alias("size_bytes"), F.coalesce("type", "type_byte").alias("type_byte"), F.coalesce(wide["bootable"] != 0, partitions["bootable"]).alias("bootable"), "is_extended")
