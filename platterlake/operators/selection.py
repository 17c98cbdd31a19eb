"""Which partitions, files and devices an operation takes, and the names that fit where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition type bytes, type strings and names of unpartitioned volumes whose filesystems can be listed.
BROWSABLE_BYTES = (0x01, 0x04, 0x06, 0x07, 0x0B, 0x0C, 0x0E, 0x11, 0x14, 0x16, 0x1B, 0x1C, 0x1E, 0x83, 0xA0, 0xA1, 0xA8, 0xAF)
BROWSABLE_STRINGS = ("Apple_HFS", "Apple_HFSX", "Apple_HFS+", "Apple_UNIX_SVR2", "Apple_UNIX_SRVR2", "Apple_PRODOS", "Apple_ProDOS", "0FC63DAF-8483-4772-8E79-3D69D8477DE4", "Amiga-NDOS", "lisafs")
BROWSABLE_VOLUMES = (
    "FAT", "HFS", "HFS+", "NTFS", "exFAT", "ProDOS", "DOS 3.3", "XFS", "ext", "btrfs", "EFS", "MFS", "ADFS", "ANDOS", "QDOS", "human68k", "Amiga-NDOS", "Alto BFS", "Pilot/Cedar", "lisafs", "Unknown",
)
#: Files that a conversion to a format takes (True) or leaves (False), by their endings; other formats take all.
TAKEN = {"chd-cd": (True, ("iso", "cue")), "bin-cue": (True, ("chd",)), "chd": (False, ("cue", "bin")), "chd-dvd": (False, ("cue", "bin")), "xdf": (True, ("xdf", "hdm", "dim", "d88")), "hdm": (True, ("xdf", "hdm", "dim", "d88"))}


def _amiga(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"\A(?:DOS\\[0-7]|[PS]FS\\[023]|PDS\\3|muFS)\z") & ~kind.isin("PFS\\0", "PFS\\2", "SFS\\3"), F.lit(False))


def browsable(byte: Column, kind: Column, name: Column) -> Column:
    """Whether a partition's files can be listed: by its type byte, its type's text, a FAT name, or, without a table, its volume."""
    by_text = F.coalesce(kind.isin(*BROWSABLE_STRINGS), F.lit(False)) | _amiga(kind)
    volume = (byte == 0) & name.isin(*BROWSABLE_VOLUMES)
    return F.coalesce(byte.isin(*BROWSABLE_BYTES), F.lit(False)) | by_text | F.coalesce(F.lower(name).contains("fat") | volume, F.lit(False))


def checkable(byte: Column, kind: Column) -> Column:
    """Whether a partition's filesystem has a checker."""
    return F.coalesce(byte == 0xAF, F.lit(False)) | F.coalesce((kind == "Apple_HFS") | kind.rlike(r"\ADOS\\[0-7]\z"), F.lit(False))


def classic_hfs(byte: Column, kind: Column, name: Column) -> Column:
    """HFS, but not its successor."""
    some = F.coalesce(F.lower(kind) == "apple_hfs", F.lit(False)) | (byte == 0xAF) | ((byte == 0) & (name == "HFS"))
    return F.coalesce(some & ~name.rlike(r"HFS[+X]"), F.lit(False))


#: What a partition of an ambiguous type byte may hold.
AMBIGUOUS = {0x07: ("ntfs", "exfat"), 0x83: ("ext", "btrfs", "xfs", "reiserfs", "ufs", "jfs", "efs")}


def resolved(byte: Column, filesystem: Column) -> Column:
    """The filesystem of a partition whose type byte names several, by what its volume was taken for; an error where it is none
    of them. Other type bytes leave it to the volume."""
    out = filesystem
    for value, names in AMBIGUOUS.items():
        said = F.raise_error(F.concat(F.lit(f"a partition of type {value:02x} holds "), F.coalesce(filesystem, F.lit("nothing known")))).cast("string")
        out = F.when(byte == value, F.when(filesystem.isin(*names), filesystem).otherwise(said)).otherwise(out)
    return out


def typed(files: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """files with the type and aux that (ending, type, aux) gives for their names' endings, in any case of letters; null without one."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    of = dictionary.select(F.lower(F.ltrim(F.col("ending"), F.lit("."))).alias("__ending"), "type", "aux")
    return files.withColumn("__e", ending).join(of, F.col("__e") == F.col("__ending"), "left").drop("__e", "__ending")


def apple_hfs(head: Column) -> Column:
    """struct(fs_type, offset) of an Apple_HFS partition's first bytes: HFS+ may lie within an old-style volume."""
    from platterlake.sources.sniff import at, number

    wrapped = (at(head, 1024, 2) == "4244") & (at(head, 1148, 2) == "482B")
    start = number(head, 1024 + 28, 2) * 512 + number(head, 1024 + 126, 2) * number(head, 1024 + 20, 4)
    kind = F.when(at(head, 1024, 2).isin("482B", "4858") | wrapped, "hfsplus").when(at(head, 1024, 2) == "4244", "hfs").otherwise("unknown")
    return F.struct(kind.alias("fs_type"), F.when(wrapped, start).otherwise(F.lit(0).cast("long")).alias("offset"))


def removable(devices: DataFrame, only: bool) -> DataFrame:
    """Devices (path, name, size_bytes, removable, read_only, system_disk, bus_protocol, media_name, mount_points), all or the removable ones."""
    shown = devices.select("path", "name", "size_bytes", "removable", "read_only", "system_disk", "bus_protocol", "media_name", "mount_points")
    return shown.where("removable") if only else shown


def taken(paths: DataFrame, target: str, path: str = "path") -> DataFrame:
    """Files that a conversion to a format takes, by path: no dotfiles, and the endings that the format asks for."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    keep = ~F.startswith(name, F.lit("."))
    if target in TAKEN:
        wanted, endings = TAKEN[target]
        keep &= ending.isin(*endings) if wanted else ~ending.isin(*endings)
    return paths.where(keep).orderBy(path)


def scan_folder(spark: SparkSession, folder: str, target: str = "raw") -> DataFrame:
    """(path, length, modificationTime) of a folder's own files that a conversion takes. Spark lists them and reads none."""
    return taken(spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime"), target)


def modified_text(when: Column) -> Column:
    """A host file's time in the session's zone."""
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def preflight(members: DataFrame, valid: Column, symlinks: bool, path: str = "path") -> DataFrame:
    """One row of counts of what an import would meet in an archive's members (path, kind).

    Unsafe paths are passed over. valid: whether every component of a member's path is a name that the target holds.
    """
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    safe = members.where((F.size(parts) > 0) & ~F.array_contains(parts, "..") & ~F.startswith(path, F.lit("/")))
    fork = F.startswith(F.element_at(parts, -1), F.lit("._"))
    rows = safe.select("kind", fork.alias("fork"), valid.alias("valid"))
    plain = ~F.col("fork")
    links = plain & F.col("valid") & (F.col("kind") == "symlink")
    return rows.agg(
        F.count_if(plain & (F.col("kind") == "directory")).alias("dirs"), F.count_if(plain & F.col("valid") & (F.col("kind") == "file")).alias("files"), F.count_if(links).alias("symlinks"),
        F.count_if(links & F.lit(not symlinks)).alias("symlinks_dropped"), F.count_if(F.col("fork")).alias("appledouble"), F.count_if(plain & ~F.col("valid")).alias("invalid_names"),
        F.count_if(plain & F.col("valid") & ~F.col("kind").isin("directory", "file", "symlink")).alias("other_unsupported"),
    )


def fitted(name: Column, stem: int, ending: int, forbidden: str = r"[\x00-\x1f/]") -> Column:
    """A name of at most so many letters before and behind its last dot, both cut where a forbidden letter stands; null where
    nothing is left of what stands before."""
    dotted = name.rlike(r"(?s)\A.+\.[^.]+\z")
    parts = F.when(dotted, F.regexp_extract(name, r"(?s)\A(.+)\.[^.]+\z", 1)).otherwise(name), F.when(dotted, F.regexp_extract(name, r"\.([^.]+)\z", 1)).otherwise("")
    cut = [F.substring(F.regexp_extract(p, rf"(?s)\A((?:(?!{forbidden}).)*)", 1), 1, n) for p, n in zip(parts, (stem, ending), strict=True)]
    return F.when(cut[0] != "", F.when(cut[1] != "", F.concat(cut[0], F.lit("."), cut[1])).otherwise(cut[0]))


def by_policy(rows: DataFrame, name: str, valid: Column, policy: str, short: Column, folder: str, ordinal: str) -> DataFrame:
    """rows with `new_name`: names that the target holds stay; of others `truncate` makes free ones, `skip` drops the row, and
    `error` raises."""
    from platterlake.operators.listing import unique_names

    if policy == "skip":
        return rows.where(valid).withColumn("new_name", F.col(name))
    if policy == "error":
        said = F.raise_error(F.concat(F.lit("not a name of the target: "), F.col(name))).cast("string")
        return rows.withColumn("new_name", F.when(valid, F.col(name)).otherwise(said))
    if policy != "truncate":
        raise ValueError(f"no such policy: {policy}")
    fit = rows.withColumn("__base", F.when(valid, F.col(name)).otherwise(short))
    return unique_names(fit, folder, "__base", ordinal).withColumnRenamed("unique_name", "new_name").drop("__base")
