"""Images built of the driver's rows and read back: filesystems, containers, partition tables and archives."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.operators import checks, diff
from platterlake.plans.common import Registry, read
from platterlake.sources import archives, compactpro, containers, filesystems, floppies, journal, partitions, samples, stuffit
from platterlake.sources.entries import LINKS, Entry, runs_of_bits

R = Registry()

#: A nation's file: its name again and again.
_CONTENT = "repeat(n_name, CAST(n_nationkey * 40 AS INT))"


def _files(spark, sf_dir) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return nation.select(F.col("n_regionkey").cast("string").alias("image_id"), F.concat(F.lit("F"), F.col("n_nationkey").cast("string"), F.lit(".TXT")).alias("name"), F.expr(_CONTENT).cast("binary").alias("content"))


_LISTED = "image_id string, fs string, path string, kind string, size long, md5 string"


def _listing(spark, sf_dir, made) -> DataFrame:
    """made: from the files of an image (a folder's name and {name: bytes}) to a filesystem's name and its entries."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("name")
        fs, found = made(f"R{key[0]}", {n: bytes(c) for n, c in zip(frame["name"], frame["content"], strict=True)})
        rows = [(key[0], fs, e.path, e.kind, e.size, None if e.content is None else hashlib.md5(e.content.rstrip(b"\0\x1a")).hexdigest()) for e in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTED.split(", ")])

    return _files(spark, sf_dir).groupBy("image_id").applyInPandas(each, _LISTED)


def _tree(folder: str, files: dict[str, bytes]) -> dict:
    return {f"/{folder}": None} | {f"/{folder}/{n}": b for n, b in files.items()}


def _sql(fs: str, path: str, size: str = "length(c)", folders: bool = True) -> str:
    rows = f"SELECT CAST(n_regionkey AS VARCHAR) AS image_id, '{fs}' AS fs, {path} AS path, 'file' AS kind, CAST({size} AS BIGINT) AS size, md5(c) AS md5 FROM (SELECT *, {_CONTENT} AS c, 'F' || n_nationkey || '.TXT' AS f FROM nation)"
    return rows + (f" UNION ALL SELECT CAST(r_regionkey AS VARCHAR), '{fs}', '/R' || r_regionkey, 'directory', 0, NULL FROM region" if folders else "")


_IN_FOLDER, _FLAT = "'/R' || n_regionkey || '/' || f", "'/' || f"
#: Writers of volumes by the filesystem that they must be taken for.
_TREES = {"fat": samples.fat12, "ext": samples.ext, "ntfs": samples.ntfs, "hfsplus": samples.hfsplus, "hfs": samples.hfs, "os9": samples.os9, "affs": samples.affs, "iso9660": samples.iso9660, "efs": samples.efs, "ufs": samples.ufs, "xfs": samples.xfs}
_FLATS = {
    "exfat": (samples.exfat, _FLAT, "length(c)"), "prodos": (samples.prodos, _FLAT, "length(c)"), "cbmdos": (samples.d64, _FLAT, "length(c)"), "applesdos33": (samples.apple_dos, _FLAT, "(length(c) + 255) // 256 * 256"),
    "acorndfs": (samples.acorn_dfs, "'/$.' || f", "length(c)"), "ataridos": (samples.atari_dos, _FLAT, "length(c)"), "rsdos": (samples.rsdos, _FLAT, "length(c)"), "dragondos": (samples.dragon_dos, _FLAT, "length(c)"),
    "mfs": (samples.mfs, _FLAT, "length(c)"), "human68k": (samples.human68k, _FLAT, "length(c)"),
}


def _register_volumes() -> None:
    for fs, write in _TREES.items():

        def trees(spark, sf_dir, write=write):
            return _listing(spark, sf_dir, lambda folder, files: filesystems.entries(write(_tree(folder, files)), True))

        trees.__name__ = f"volume_{fs}"
        R.add(_sql(fs, _IN_FOLDER))(trees)
    for fs, (write, path, size) in _FLATS.items():

        def flats(spark, sf_dir, write=write):
            return _listing(spark, sf_dir, lambda _, files: filesystems.entries(write(files), True))

        flats.__name__ = f"volume_{fs}"
        R.add(_sql(fs, path, size, False))(flats)


_register_volumes()


@R.add(_sql("prodos", _FLAT, folders=False))
def volume_prodos_in_dos_order(spark, sf_dir):
    """A disk whose sectors are in another filesystem's order, also as recorded bits."""
    return _listing(spark, sf_dir, lambda _, files: filesystems.entries(containers.opened(samples.woz(samples.dos_ordered(samples.prodos(files))), "x.woz"), True))


@R.add(_sql("affs", _IN_FOLDER))
def volume_affs_with_headers(spark, sf_dir):
    return _listing(spark, sf_dir, lambda folder, files: filesystems.entries(samples.affs(_tree(folder, files), fast=False), True))


@R.add(_sql("ext", _IN_FOLDER))
def volume_ext_with_block_maps(spark, sf_dir):
    return _listing(spark, sf_dir, lambda folder, files: filesystems.entries(samples.ext(_tree(folder, files), extents=False), True))


@R.add(_sql("xfs", _IN_FOLDER))
def volume_xfs_version_4(spark, sf_dir):
    """Folders in blocks, without types of files."""
    return _listing(spark, sf_dir, lambda folder, files: filesystems.entries(samples.xfs(_tree(folder, files), 4, short=False), True))


@R.add(_sql("ufs", _IN_FOLDER))
def volume_ufs_big_endian(spark, sf_dir):
    return _listing(spark, sf_dir, lambda folder, files: filesystems.entries(samples.ufs(_tree(folder, files), False, ">"), True))


@R.add(_sql("cpm", _FLAT, "(length(c) + 127) // 128 * 128", False))
def volume_cpm(spark, sf_dir):
    return _listing(spark, sf_dir, lambda _, files: ("cpm", floppies.CpM(samples.cpm(files)).entries(True)))


@R.add(_sql("tar", _IN_FOLDER))
def archive_tar(spark, sf_dir):
    def made(folder, files):
        data = archives.write_tar([Entry(f"/{folder}", "directory"), *(Entry(f"/{folder}/{n}", "file", content=b) for n, b in files.items()), Entry(f"/{folder}/._x", "file", content=b"fork")])
        kind = archives.kind_of(data)
        return kind, archives.READERS[kind](data, True)

    return _listing(spark, sf_dir, made)


@R.add(_sql("compactpro", _IN_FOLDER))
def archive_compactpro(spark, sf_dir):
    return _listing(spark, sf_dir, lambda folder, files: ("compactpro", archives.READERS["compactpro"](compactpro.write_compactpro(_tree(folder, files)), True)))


def _register_stuffit() -> None:
    for method, name in ((0, "stored"), (1, "runs"), (3, "huffman")):

        def made(spark, sf_dir, method=method):
            return _listing(spark, sf_dir, lambda folder, files: ("stuffit", archives.READERS["stuffit"](stuffit.write_stuffit(_tree(folder, files), method), True)))

        made.__name__ = f"archive_stuffit_{name}"
        R.add(_sql("stuffit", _IN_FOLDER))(made)


_register_stuffit()


def _register_archives() -> None:
    for kind, write in (("macbinary", archives.write_macbinary), ("binhex", archives.write_binhex)):

        def one(spark, sf_dir, write=write):
            def made(_, files):
                found = [write(n, b"TEXT", b"ttxt", b, b"fork") for n, b in files.items()]
                (name,) = {archives.kind_of(d) for d in found}
                return name, (e for d in found for e in archives.READERS[name](d, True))

            return _listing(spark, sf_dir, made)

        one.__name__ = f"archive_{kind}"
        R.add(_sql(kind, _FLAT, "length(c)", False))(one)


_register_archives()


@R.add("SELECT n_name, sha256(n_name) AS finder, sha256(repeat(n_name, 9)) AS resource FROM nation")
def archive_appledouble(spark, sf_dir):
    def each(batches):
        for batch in batches:
            rows = []
            for name in batch["n_name"]:
                parts = archives.appledouble(archives.write_appledouble(name.encode(), name.encode() * 9))
                rows.append((name, hashlib.sha256(parts[9]).hexdigest(), hashlib.sha256(parts[2]).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_name", "finder", "resource"])

    return read(spark, sf_dir, "nation").select("n_name").mapInPandas(each, "n_name string, finder string, resource string")


@R.add("SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(65536 * (n_nationkey + 1) AS BIGINT) AS location, CAST(length(t) AS BIGINT) AS size, md5(t) AS md5 FROM (SELECT *, rpad(n_name, 70, n_name) AS t FROM nation)")
def volume_carved(spark, sf_dir):
    """Text at the places of a volume that no driver knows, told by a row's number; one run crosses a window's end."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        disk = bytearray(b"\1" * (2 << 20))
        for n, text in zip(frame["n_nationkey"], frame["text"], strict=True):
            disk[65_536 * (n + 1) : 65_536 * (n + 1) + len(text)] = text.encode()
        _, found = filesystems.entries(bytes(disk), True)
        rows = [(key[0], e.location, e.size, hashlib.md5(e.content).hexdigest()) for e in found if e.path != "/disk"]
        return pd.DataFrame(rows, columns=["image_id", "location", "size", "md5"])

    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("image_id"), "n_nationkey", F.expr("rpad(n_name, 70, n_name)").alias("text"))
    return rows.groupBy("image_id").applyInPandas(each, "image_id string, location long, size long, md5 string")


#: A disk of a table's rows, and the writers of containers that must give it back; Commodore and CPC disks have a size of their own.
_DISK = "left(repeat(t, 40), {size})"
_ROWS = "(SELECT string_agg(rpad(n_name, 512, '.'), '' ORDER BY n_nationkey) AS t FROM nation)"
_BOXES = {
    "raw": (bytes, 131_072), "vhd_fixed": (samples.raw_vhd, 131_072), "vhd_dynamic": (samples.dynamic_vhd, 131_072), "qcow2": (samples.qcow2, 131_072), "vmdk": (samples.vmdk, 131_072), "2mg": (samples.twomg, 131_072),
    "dc42": (samples.dc42, 131_072), "msa": (samples.msa, 92_160), "dmg": (samples.dmg, 131_072), "chd": (samples.chd, 131_072), "partclone": (samples.partclone, 131_072), "edsk": (samples.edsk, 184_320), "g64": (samples.g64, 174_848), "woz": (samples.woz, 143_360),
}


def _register_containers() -> None:
    for kind, (write, size) in _BOXES.items():

        def box(spark, sf_dir, write=write, size=size, kind=kind):
            def each(batches):
                for batch in batches:
                    found = [containers.flat(write(text.encode()), "x.img") for text in batch["disk"]]
                    yield pd.DataFrame([(kind, len(d), hashlib.sha256(d).hexdigest()) for d in found], columns=["container", "size", "sha256"])

            rows = read(spark, sf_dir, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.rpad("n_name", 512, ".").alias("t")))).alias("r"))  # 25 rows
            disk = F.substring(F.repeat(F.array_join("r.t", ""), F.lit(40)), 1, size)
            return rows.select(disk.alias("disk")).mapInPandas(each, "container string, size long, sha256 string")

        box.__name__ = f"container_{kind}"
        R.add(f"SELECT '{kind}' AS container, CAST({size} AS BIGINT) AS size, sha256({_DISK.format(size=size)}) AS sha256 FROM {_ROWS}")(box)


_register_containers()


_TABLE = "image_id string, part_index int, scheme string, type_name string, start_lba long, size_bytes long, bootable boolean"
#: Nations as partitions of their region's disk, in the order of their numbers.
_PARTS = "(SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)"


def _partitioned(spark, sf_dir, made) -> DataFrame:
    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_nationkey")
        data = made([(int(n), name) for n, name in zip(frame["n_nationkey"], frame["n_name"], strict=True)])
        get = lambda at, size: data[at : at + size].ljust(size, b"\0")
        rows = [(key[0], i, scheme, name, start, size, boot) for i, scheme, name, _, _, start, _, size, boot, *_ in partitions.partitions(get, 1 << 40)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _TABLE.split(", ")])

    return read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("image_id"), "n_nationkey", "n_name").groupBy("image_id").applyInPandas(each, _TABLE)


@R.add(f"SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(k AS INTEGER) AS part_index, 'mbr' AS scheme, CASE WHEN n_nationkey % 2 = 0 THEN 'FAT16' ELSE 'Linux' END AS type_name, CAST(2048 * (n_nationkey + 1) AS BIGINT) AS start_lba, CAST(1024 * (n_nationkey + 7) AS BIGINT) AS size_bytes, k = 1 AS bootable FROM {_PARTS} WHERE k < 4")
def table_mbr(spark, sf_dir):
    return _partitioned(spark, sf_dir, lambda rows: partitions.write_mbr([(0x06 if n % 2 == 0 else 0x83, 2048 * (n + 1), 2 * (n + 7), k == 1) for k, (n, _) in enumerate(rows[:4])]))


@R.add(f"SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(k AS INTEGER) AS part_index, 'gpt' AS scheme, CASE WHEN n_nationkey % 2 = 0 THEN 'Basic data' ELSE n_name END AS type_name, CAST(2048 * (n_nationkey + 1) AS BIGINT) AS start_lba, CAST(1024 * (n_nationkey + 7) AS BIGINT) AS size_bytes, false AS bootable FROM {_PARTS}")
def table_gpt(spark, sf_dir):
    def made(rows):
        kinds = ("EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", "00000000-0000-4000-8000-00000000000{}")
        first, _ = partitions.write_gpt([(kinds[n % 2].format(n % 10), 2048 * (n + 1), 2 * (n + 7), name) for n, name in rows], 1 << 20)
        if wrong := partitions.check_gpt(lambda at, size: first[at : at + size]):
            raise ValueError(wrong[0])
        return first

    return _partitioned(spark, sf_dir, made)


@R.add(f"SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(k + 1 AS INTEGER) AS part_index, 'apm' AS scheme, n_name AS type_name, CAST(2048 * (n_nationkey + 1) AS BIGINT) AS start_lba, CAST(1024 * (n_nationkey + 7) AS BIGINT) AS size_bytes, false AS bootable FROM {_PARTS} UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 0, 'apm', 'Apple', 1, 63 * 512, false FROM region")
def table_apm(spark, sf_dir):
    return _partitioned(spark, sf_dir, lambda rows: partitions.write_apm([(name, "Apple_HFS", 2048 * (n + 1), 2 * (n + 7)) for n, name in rows], 1 << 20))


_USED = "image_id string, fs string, used long, total long"


def _allocated(spark, sf_dir, write) -> DataFrame:
    """Used and all blocks of each region's volume."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("name")
        fs, _, runs = filesystems.allocation(write(_tree(f"R{key[0]}", {n: bytes(c) for n, c in zip(frame["name"], frame["content"], strict=True)})))
        runs = list(runs)
        return pd.DataFrame([(key[0], fs, sum(n for _, n, used in runs if used), sum(n for _, n, _ in runs))], columns=[c.split()[0] for c in _USED.split(", ")])

    return _files(spark, sf_dir).groupBy("image_id").applyInPandas(each, _USED)


@R.add(f"SELECT CAST(n_regionkey AS VARCHAR) AS image_id, 'fat' AS fs, CAST(sum((length(c) + 511) // 512) + 1 AS BIGINT) AS used, CAST(2847 AS BIGINT) AS total FROM (SELECT *, {_CONTENT} AS c FROM nation) GROUP BY 1")
def allocation_fat(spark, sf_dir):
    """A cluster of 512 bytes for every part of a file, and one for the folder."""
    return _allocated(spark, sf_dir, samples.fat12)


@R.add("SELECT 'bits' AS kind, p_partkey, CAST(bit_count(p_partkey & 65535) AS BIGINT) AS used FROM part")
def allocation_runs(spark, sf_dir):
    """Runs of a bitmap of sixteen bits, whose set ones add up to its population count."""

    def each(batches):
        for batch in batches:
            found = [sum(n for _, n, used in runs_of_bits(int(k & 65535).to_bytes(2, "big"), 16, high_first=True) if used) for k in batch["p_partkey"]]
            yield pd.DataFrame({"kind": "bits", "p_partkey": batch["p_partkey"], "used": found})

    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey")).mapInPandas(each, "kind string, p_partkey long, used long")


@R.add("""WITH j AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seq FROM nation),
w AS (SELECT n_regionkey, 100 + n_nationkey % 3 AS sector, n_name, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY seq DESC) AS n FROM j WHERE seq < 4)
SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(sector AS BIGINT) AS block, md5(rpad(n_name, 512, '.')) AS md5 FROM w WHERE n = 1""")
def journal_of_volumes(spark, sf_dir):
    """A nation is a transaction of its region's journal; the fourth is damaged, so three are replayed, and later ones win."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_nationkey")
        writes = [[(100 + n % 3, name.ljust(512, ".").encode())] for n, name in zip(frame["n_nationkey"].tolist(), frame["n_name"], strict=True)]
        return pd.DataFrame([(key[0], *t) for t in journal.transactions(samples.journaled(writes, bad=(4,)))], columns=["image_id", "seq", "sector", "bytes", "good"])

    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("image_id"), "n_nationkey", "n_name")
    found = rows.groupBy("image_id").applyInPandas(each, "image_id string, seq long, sector long, bytes binary, good boolean")
    writes = found.withColumnRenamed("sector", "block")
    none = writes.limit(0).select("image_id", "block", "bytes")
    return diff.overlay(none, writes, ("image_id",)).select("image_id", "block", F.md5("bytes").alias("md5"))


def _linked(spark, sf_dir, write, hurt) -> DataFrame:
    """The inodes and names of each region's volume, after a fault was planted."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("name")
        disk = bytearray(write(_tree(f"R{key[0]}", {n: bytes(c) for n, c in zip(frame["name"], frame["content"], strict=True)})))
        hurt(disk)
        return pd.DataFrame([(key[0], 0, *r) for r in filesystems.links(bytes(disk))], columns=[c.split()[0] for c in LINKS.split(", ")])

    return _files(spark, sf_dir).groupBy("image_id").applyInPandas(each, LINKS)


@R.add("SELECT CAST(r_regionkey AS VARCHAR) AS image_id, 'error' AS severity, 'LinkCountMismatch' AS code, 'inode 4 has 9 links and 1 names' AS message FROM region")
def check_ufs(spark, sf_dir):
    """The first file of every volume is made to store nine links."""
    return checks.check_links(_linked(spark, sf_dir, samples.ufs, lambda disk: disk.__setitem__(80 * 1024 + 4 * 256 + 2, 9)))


@R.add("SELECT CAST(r_regionkey AS VARCHAR) AS image_id, 'error' AS severity, 'LinkCountMismatch' AS code, 'inode 66 has 9 links and 1 names' AS message FROM region")
def check_xfs(spark, sf_dir):
    return checks.check_links(_linked(spark, sf_dir, samples.xfs, lambda disk: disk.__setitem__(8 * 4096 + 2 * 512 + 19, 9)))


@R.add("SELECT CAST(r_regionkey AS VARCHAR) AS image_id, 'error' AS severity, 'LinkCountMismatch' AS code, 'inode 3 has 9 links and 2 names' AS message FROM region")
def check_efs(spark, sf_dir):
    """The folder of every volume, which its parent and itself name."""
    return checks.check_links(_linked(spark, sf_dir, samples.efs, lambda disk: disk.__setitem__(2 * 512 + 3 * 128 + 3, 9)))


@R.add("SELECT CAST(r_regionkey AS VARCHAR) AS image_id, code FROM region, (VALUES ('BadChecksum'), ('WrongParent')) AS v(code)")
def check_affs(spark, sf_dir):
    """The parent of every volume's folder is made a wrong one, which its checksum tells too."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        disk = bytearray(samples.affs(_tree(f"R{key[0]}", {n: bytes(c) for n, c in zip(frame["name"], frame["content"], strict=True)})))
        disk[512 * 882 + 503] ^= 1
        return pd.DataFrame([(key[0], code) for _, code, _ in filesystems.problems(bytes(disk))], columns=["image_id", "code"])

    return _files(spark, sf_dir).groupBy("image_id").applyInPandas(each, "image_id string, code string")


QUERIES, ORACLE_SQL = R.queries, R.sql
