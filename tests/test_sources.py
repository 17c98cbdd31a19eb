import gzip
import shutil
import subprocess

import pytest

from platterlake.sources import archives, containers, filesystems, partitions, ranged, readers, sniff
from platterlake.sources.filesystems import Entry
from pyspark.sql import functions as F
from platterlake.sources import samples as images

FILES = {"/HELLO.TXT": b"Hello, FAT!", "/SUBDIR": None, "/SUBDIR/NESTED.TXT": b"nested file" * 200, "/EMPTY.DAT": b""}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    volume = images.fat12(FILES)
    disk = images.mbr([(0x01, 63, volume, True), (0x83, 3000, b"plain text of a volume without a filesystem, long enough to be carved out of it".ljust(1024, b"\0"), False)], 2 << 20)
    (top / "floppy.img").write_bytes(volume)
    (top / "disk.img").write_bytes(disk)
    (top / "disk.vhd").write_bytes(images.dynamic_vhd(disk))
    (top / "disk.img.gz").write_bytes(gzip.compress(disk))
    (top / "files.tar").write_bytes(archives.write_tar([Entry("/a", "directory"), Entry("/a/b.txt", "file", content=b"in a tar"), Entry("/a/l", "symlink", symlink_target="b.txt"), Entry("/a/._b.txt", "file", content=b"x")]))
    return str(top)


def test_containers_give_the_same_bytes():
    disk = images.mbr([(0x06, 63, images.fat12(FILES), False)], 3 << 20)
    track = images.fat12(FILES)[: 9 * 512 * 160]
    for data, path, want in (
        (disk, "a.img", disk), (images.dynamic_vhd(disk), "a.vhd", disk), (images.qcow2(disk), "a.qcow2", disk), (gzip.compress(images.qcow2(disk)), "a.gz", disk),
        (images.msa(track), "a.msa", track), (b"\x96\x02\x00\x00\x80\x00".ljust(16, b"\0") + disk[:92160], "a.atr", disk[:92160]),
    ):
        assert containers.flat(data, path) == want


def test_partition_schemes():
    volume = images.fat12(FILES)
    read = lambda d: readers._reader(d)
    disk = images.mbr([(0x01, 63, volume, True)], 2 << 20)
    rows = list(partitions.partitions(read(disk), len(disk)))
    assert [(r[0], r[1], r[2], r[5], r[7], r[8]) for r in rows] == [(0, "mbr", "FAT12", 63, len(volume), True)]
    disk = images.gpt([("EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", 2048, volume, "data")], 4 << 20)
    assert [(r[1], r[2], r[5]) for r in partitions.partitions(read(disk), len(disk))] == [("gpt", "Basic data", 2048)]
    disk = images.apm([("Apple", "Apple_partition_map", 1, 63), ("MacOS", "Apple_HFS", 64, 1000)], 1 << 20)
    assert [(r[2], r[4], r[5]) for r in partitions.partitions(read(disk), len(disk))] == [("Apple", "Apple_partition_map", 1), ("MacOS", "Apple_HFS", 64)]
    assert [(r[1], r[7]) for r in partitions.partitions(read(volume), len(volume))] == [("none", len(volume))]


def test_logical_partitions_end_with_a_broken_chain():
    import struct

    disk = bytearray(images.mbr([(0x05, 100, bytes(512 * 400), False)], 1 << 20))
    for here, following in ((100, 50), (150, 0)):
        struct.pack_into("<B3xB3xII", disk, here * 512 + 446, 0, 0x06, 1, 10)
        if following:
            struct.pack_into("<B3xB3xII", disk, here * 512 + 462, 0, 0x05, following, 20)
        disk[here * 512 + 510 : here * 512 + 512] = b"\x55\xaa"
    rows = list(partitions.mbr(readers._reader(bytes(disk))))
    assert [(r[0], r[5], r[9], r[10]) for r in rows] == [(0, 100, False, True), (4, 101, True, False), (5, 151, True, False)]
    disk[150 * 512 + 510] = 0
    assert [r[0] for r in partitions.mbr(readers._reader(bytes(disk)))] == [0, 4]


def test_entries_of_every_image(spark, folder):
    found = readers.read_entries(spark, folder, contents=True, glob="*").collect()
    by = {}
    for r in found:
        by.setdefault((r.image_id.rsplit("/", 1)[1], r.part_index), {})[r.path] = r
    for image, part in (("floppy.img", 0), ("disk.img", 0), ("disk.vhd", 0), ("disk.img.gz", 0)):
        rows = by[image, part]
        assert {p: None if r.kind == "directory" else bytes(r.content) for p, r in rows.items()} == FILES
        assert rows["/HELLO.TXT"].fs_type == "fat" and rows["/HELLO.TXT"].modified == "2025-01-01 12:00:00"
    assert bytes(by["disk.img", 1]["/text-0000000000.txt"].content).startswith(b"plain text")
    tar = by["files.tar", 0]
    assert set(tar) == {"/a", "/a/b.txt", "/a/l"} and tar["/a/l"].symlink_target == "b.txt" and bytes(tar["/a/b.txt"].content) == b"in a tar"


def test_data_sources_push_prefixes(spark, folder):
    readers.register(spark)
    rows = spark.read.format("fsentries").option("partition", 0).load(f"{folder}/disk.img").where(F.col("path").startswith("/SUB"))
    assert sorted(r.path for r in rows.select("path").collect()) == ["/SUBDIR", "/SUBDIR/NESTED.TXT"]
    assert spark.read.format("diskpart").load(f"{folder}/disk.img").count() == 2


def test_partitions_blocks_and_probe(spark, folder):
    parts = readers.read_partitions(spark, folder, "disk.*").collect()
    assert sorted((r.image_id.rsplit("/", 1)[1], r.part_index, r.type_name) for r in parts) == [(n, i, t) for n in ("disk.img", "disk.img.gz", "disk.vhd") for i, t in ((0, "FAT12"), (1, "Linux"))]
    blocks = readers.read_blocks(spark, folder, 4096, "disk.*").groupBy("block_no").agg(F.count_distinct("bytes").alias("n"), F.count(F.lit(1)).alias("images")).collect()
    assert blocks and all(r.n == 1 and r.images == 3 for r in blocks)
    probed = {r.path.rsplit("/", 1)[1]: (r.container, r.scheme, r.fs_type) for r in readers.probe(spark, folder).collect()}
    assert probed["floppy.img"] == ("raw", "none", "fat") and probed["disk.img"][:2] == ("raw", "mbr") and probed["disk.vhd"][0] == "vhd-dynamic" and probed["files.tar"][0] == "tar"


def test_sniff_rules_agree(spark):
    cases = {"xfs": (0, b"XFSB"), "ntfs": (3, b"NTFS    "), "hfs": (1024, b"BD"), "hfsplus": (1024, b"H+"), "mfs": (1024, b"\xd2\xd7"), "ext": (1080, b"\x53\xef"), "btrfs": (65600, b"_BHRfS_M"), "jfs": (32768, b"JFS1"), "affs": (0, b"DOS\3"), "efs": (540, b"\x00\x07\x29\x59")}
    rows = []
    for name, (at, magic) in cases.items():
        data = bytearray(70_000)
        data[at : at + len(magic)] = magic
        rows.append((name, bytes(data)))
    wrapped = bytearray(rows[2][1])
    wrapped[1148:1150] = b"H+"
    rows.append(("hfsplus", bytes(wrapped)))
    got = spark.createDataFrame(rows, "name string, data binary").select("name", sniff.filesystem(F.col("data")).alias("found")).collect()
    assert [r.name for r in got] == [r.found for r in got] == [sniff.filesystem_of(d) for _, d in rows]


class Counted(ranged.Source):
    """A sparse disk of given pieces that counts what is read of it."""

    def __init__(self, size, pieces):
        self.size, self.pieces, self.taken = size, pieces, 0

    def __len__(self):
        return self.size

    def read(self, start, size):
        self.taken += size
        out = bytearray(size)
        for at, piece in self.pieces:
            low, high = max(start, at), min(start + size, at + len(piece))
            if low < high:
                out[low - start : high - start] = piece[low - at : high - at]
        return bytes(out)


def test_only_ranges_of_large_images_are_read():
    volume = images.fat12(FILES)
    start = 5 << 30
    disk = images.gpt([("EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", 2048, b"", "data")], 1 << 20)
    table = bytearray(disk[:34 * 512])
    import struct

    struct.pack_into("<QQ", table, 1024 + 32, start // 512, start // 512 + len(volume) // 512)
    big = Counted(8 << 30, [(0, bytes(table)), (start, volume)])
    found = [e for v in readers._volumes("x.img", big) for e in readers._volume_rows(*v, big, True, None)]
    assert {r[3]: r[-1] for r in found if r[6] == "file"} == {p: b for p, b in FILES.items() if b is not None}
    assert big.taken < 4 << 20
    assert sniff.filesystem_of(big) is None and partitions.detect(readers._reader(big)) == "gpt"


def test_files_are_read_by_blocks(tmp_path):
    data = bytes(range(256)) * 4096
    (tmp_path / "a b.bin").write_bytes(data)
    f = ranged.open_file(f"file://{tmp_path}/a%20b.bin")
    assert len(f) == len(data) and f[5:9] == data[5:9] and f[65530:65550] == data[65530:65550] and f[-3:] == data[-3:] and f[len(data) - 1] == data[-1] and f[:] == data
    assert f[len(data) :] == b"" and ranged.View(f, 10, 20)[5:] == data[15:30] and ranged.reachable("s3a://b/k") and not ranged.reachable("viewfs://x/y")


def test_carving_joins_runs_across_windows():
    import random

    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab\0\1") if rnd.random() < 0.1 else 97 for _ in range(5000))
    whole = list(filesystems.Carve(data, 10).runs())
    assert whole and all(list(filesystems.Carve(data, 10).runs(w)) == whole for w in (1, 7, 64, 999))


def test_floppies_are_told_by_size_and_structure(spark):
    cases = []

    def disk(name, size, *pieces):
        data = bytearray(size)
        for at, piece in pieces:
            data[at : at + len(piece)] = piece
        cases.append((name, bytes(data)))

    disk("ataridos", 92_160, (359 * 128, b"\2" + (707).to_bytes(2, "little") + (600).to_bytes(2, "little")))
    disk(None, 92_161, (359 * 128, b"\2" + (707).to_bytes(2, "little") + (600).to_bytes(2, "little")))
    disk("dragondos", 40 * 18 * 256, (20 * 18 * 256 + 0xFC, bytes([40, 18, 215, 237])))
    disk("cbmdos", 174_848, (0x16500, b"\x12\x01A"), (0x165A5, b"2A"))
    disk("acorndfs", 102_400, (262, b"\1\x90"))
    disk("os9", 35 * 18 * 256, (0, (630).to_bytes(3, "big")), (4, b"\0\x4f\0\1"), (8, b"\0\0\2"), (512, b"\xbf"), (521, b"\0\0\0\x40"), (528, b"\0\0\3\0\7"))
    disk("rsdos", 35 * 18 * 256, (307 * 256, b"\xff" * 68), (308 * 256, b"\xff" * 32))
    disk("adfs", 4096, (0xDC0, bytes([9, 10, 2, 2, 15, 0, 0, 0, 0, 1])))
    disk("andos", 1024, (0xE0, b"ANDOS"))
    disk("qdos_mdv", 255 * 686, (10, b"\0\xff\xff\0MYCART    "))
    disk("applesdos33", 143_360, (0x11001, b"\x11\x0f\3"), (0x11027, b"\x7a"), (0x11034, b"\x23\x10\0\1"))
    got = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(cases)], "i int, d binary").select("i", sniff.filesystem(F.col("d")).alias("fs")).orderBy("i").collect()
    assert [r.fs for r in got] == [n for n, _ in cases] == [sniff.filesystem_of(d) for _, d in cases]


def test_other_filesystems():
    files = {"HELLO.TXT": b"Hello", "BIG": bytes(range(256)) * 11}
    for name, disk in (("prodos", images.prodos(files)), ("exfat", images.exfat({**files, "a rather long name.txt": b"x"}))):
        fs, found = filesystems.entries(disk, True)
        got = {e.path[1:]: e.content for e in found}
        assert fs == name and files.items() <= got.items() and len(got) == len(files) + (name == "exfat")


def test_ext_volumes():
    files = {"/subdir": None, "/hello.txt": b"Hello, ext!", "/subdir/nested.txt": b"nested file" * 3000}
    for extents in (True, False):
        fs, found = filesystems.entries(images.ext(files, [("/link.txt", "hello.txt")], extents), True)
        got = {e.path: e for e in found}
        assert fs == "ext" and set(got) == {*files, "/link.txt"} and got["/link.txt"].symlink_target == "hello.txt"
        assert got["/subdir/nested.txt"].content == files["/subdir/nested.txt"] and got["/hello.txt"].content == b"Hello, ext!"
        assert (got["/hello.txt"].mode, got["/hello.txt"].uid, got["/hello.txt"].gid, got["/hello.txt"].modified) == (0o100644, 1000, 100, "2024-01-01 00:00:00")


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="no mke2fs")
@pytest.mark.parametrize("kind", ["ext2", "ext4"])
def test_ext_volumes_of_the_system_tool(tmp_path, kind):
    top = tmp_path / "top"
    (top / "subdir").mkdir(parents=True)
    (top / "hello.txt").write_bytes(b"Hello, " + kind.encode())
    (top / "subdir" / "big.bin").write_bytes(bytes(range(256)) * 4000)
    (top / "link.txt").symlink_to("hello.txt")
    image = tmp_path / "v.img"
    subprocess.run(["mke2fs", "-q", "-t", kind, "-d", str(top), str(image), "8M"], check=True, capture_output=True, timeout=60)
    fs, found = filesystems.entries(image.read_bytes(), True)
    got = {e.path: e for e in found}
    assert fs == "ext" and {"/hello.txt", "/subdir", "/subdir/big.bin", "/link.txt", "/lost+found"} == set(got)
    assert got["/subdir/big.bin"].content == bytes(range(256)) * 4000 and got["/hello.txt"].content.endswith(kind.encode()) and got["/link.txt"].symlink_target == "hello.txt"


def test_ntfs_volumes():
    files = {"/Folder": None, "/Hello.txt": b"Hello, NTFS!", "/Folder/big.bin": bytes(range(256)) * 60}
    fs, found = filesystems.entries(images.ntfs(files), True)
    got = {e.path: e for e in found}
    assert fs == "ntfs" and {p: None if e.kind == "directory" else e.content for p, e in got.items()} == files
    assert got["/Hello.txt"].modified == "2024-01-01 00:00:00" and got["/Folder/big.bin"].extents == [(40, 4)]


def test_floppies_without_magic():
    files = {"HELLO": b"Hello", "BIG": bytes(range(1, 256)) * 7}
    for name, disk, path in (("cbmdos", images.d64(files), "/{}"), ("applesdos33", images.apple_dos(files), "/{}"), ("acorndfs", images.acorn_dfs(files), "/$.{}")):
        fs, found = filesystems.entries(disk, True)
        got = {e.path: e.content for e in found}
        assert fs == name and set(got) == {path.format(n) for n in files}
        assert all(got[path.format(n)].rstrip(b"\0") == body for n, body in files.items())


def test_macintosh_volumes():
    files = {"/Folder": None, "/Hello.txt": b"Hello, Mac!", "/Folder/Nested": bytes(range(256)) * 20}
    for name, disk in (("hfsplus", images.hfsplus(files)), ("hfs", images.hfs({k: v for k, v in files.items() if k != "/Folder/Nested"} | {"/Folder/Nested": b"n" * 700}))):
        fs, found = filesystems.entries(disk, True)
        got = {e.path: e for e in found}
        assert fs == name and set(got) == set(files) and got["/Folder"].kind == "directory"
        assert got["/Hello.txt"].content == b"Hello, Mac!" and got["/Hello.txt"].type_code == "TEXT" and got["/Hello.txt"].modified == "2024-01-01 00:00:00"
        assert got["/Folder/Nested"].content in (files["/Folder/Nested"], b"n" * 700) and got["/Folder/Nested"].size == len(got["/Folder/Nested"].content)
        if name == "hfsplus":
            assert (got["/Hello.txt"].mode, got["/Hello.txt"].uid) == (0o100644, 501)


def test_archives_round_trip():
    body = bytes(range(256)) * 9 + b"\x90\x90\x00" * 5
    made = archives.write_macbinary("Namé", b"TEXT", b"ttxt", body, b"fork")
    (e,) = archives.macbinary(made, True)
    assert archives.kind_of(made) == "macbinary" and (e.path, e.content, e.type_code, e.resource_fork_size) == ("/Namé", body, "TEXT", 4)
    made = archives.write_binhex("Name", b"TEXT", b"ttxt", body, b"fork")
    (e,) = archives.binhex(made, True)
    assert archives.kind_of(made) == "binhex" and (e.path, e.content, e.creator_code) == ("/Name", body, "ttxt")
    assert archives.appledouble(archives.write_appledouble(b"f" * 32, b"rsrc")) == {9: b"f" * 32, 2: b"rsrc"}
    assert archives.safe("/etc/x") is None and archives.safe("a/../b") is None and archives.safe("./a//b") == ["a", "b"]


def test_text_behind_ten_mebibytes_is_carved(spark, tmp_path):
    text = b"text far behind the first ten mebibytes of a volume that no driver knows, carved"
    (tmp_path / "big.img").write_bytes(bytes(11 << 20) + text + bytes(1 << 20))
    at = f"/text-{11 << 20:010x}.txt"
    found = {r.path: r for r in readers.read_entries(spark, str(tmp_path), contents=True).collect()}
    assert bytes(found[at].content) == text and "/truncated" not in found
    part = {r.path: r for r in readers.read_entries(spark, str(tmp_path), carve_limit=10 << 20).collect()}
    assert at not in part and (part["/truncated"].location, part["/truncated"].size) == (10 << 20, (2 << 20) + len(text))
    readers.register(spark)
    rows = lambda **o: {r.path for r in spark.read.format("fsentries").options(**o).load(str(tmp_path)).collect()}
    assert at in rows() and "/truncated" in rows(carve_limit=1 << 20)


def body(n, seed=0):
    import random

    return random.Random(n + seed).randbytes(n)


TREE = {"/DIR": None, "/HELLO.TXT": b"Hello there", "/DIR/BIG.BIN": body(9000), "/DIR/EMPTY": b"", "/ODD": body(777)}
FLAT = {"HELLO.TXT": b"Hello there", "BIG.BIN": body(5000), "ODD": body(777)}


@pytest.mark.parametrize(("name", "disk"), [("os9", images.os9(TREE)), ("affs", images.affs(TREE)), ("affs", images.affs(TREE | {"/HUGE": body(60_000)}, fast=False)), ("iso9660", images.iso9660(TREE)), ("efs", images.efs(TREE)), ("xfs", images.xfs(TREE)), ("xfs", images.xfs(TREE, 4)), ("xfs", images.xfs(TREE, short=False)), ("xfs", images.xfs(TREE, 4, short=False))])
def test_trees(name, disk):
    fs, found = filesystems.entries(disk, True)
    got = {e.path: e for e in found}
    want = TREE | ({"/HUGE": body(60_000)} if "/HUGE" in got else {})
    assert fs == name and {p: e.content for p, e in got.items()} == want
    assert got["/DIR"].kind == "directory" and got["/DIR/BIG.BIN"].size == 9000
    if name == "affs":
        assert got["/ODD"].modified == "1978-01-02 00:02:03"


@pytest.mark.parametrize("order", "<>")
def test_journals(order):
    from platterlake.sources import journal

    sector = lambda n: bytes([n]) * 512
    writes = [[(100, sector(1)), (200, sector(2))], [(100, sector(3))], [(300, sector(4))]]
    flat = [(k, n, b, True) for k, some in enumerate(writes, 1) for n, b in some]
    assert list(journal.transactions(images.journaled(writes, order=order))) == flat
    assert list(journal.transactions(images.journaled(writes, order=order, start=(64 << 10) - 5 * 512))) == flat  # around the ring's end
    assert list(journal.transactions(images.journaled(writes, bad=(2,), order=order))) == [*flat[:2], (2, 100, b"", False)]
    assert list(journal.transactions(images.fat12(FILES))) == []
    hurt = bytearray(images.journaled(writes, order=order))
    hurt[(64 << 10) + 20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(journal.transactions(bytes(hurt)))


def test_described_disks(tmp_path):
    disk = images.mbr([(0x06, 63, images.fat12(FILES), False)], 3 << 20)
    (tmp_path / "x-flat.vmdk").write_bytes(b"?" * 512 + disk[: 2 << 20])
    (tmp_path / "y.vmdk").write_bytes(images.vmdk(disk[2 << 20 :]))
    text = f'# Disk DescriptorFile\nversion=1\nRW {2 << 11} FLAT "x-flat.vmdk" 1\nRW 7 ZERO\nRW {1 << 11} SPARSE "y.vmdk"\n'
    (tmp_path / "x.vmdk").write_text(text)
    path = str(tmp_path / "x.vmdk")
    assert containers.flat(ranged.open_file(path), path) == disk[: 2 << 20] + bytes(7 * 512) + disk[2 << 20 :]


def test_compact_pro():
    from platterlake.sources import compactpro

    files = {"/a": b"x" * 300 + b"\x81\x82" * 3 + b"\x81" * 9, "/D": None, "/D/b": body(3000), "/D/E": None, "/D/E/c": b"", "/z": b"q"}
    made = compactpro.write_compactpro(files)
    assert archives.kind_of(made) == "compactpro" and archives.kind_of(b"\1" + bytes(200)) is None
    assert {e.path: e.content for e in archives.READERS["compactpro"](made, True)} == files
    hurt = bytearray(made)
    hurt[9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(compactpro.compactpro(bytes(hurt), True))


@pytest.mark.parametrize("method", [0, 1, 3])
def test_stuffit(method):
    from platterlake.sources import stuffit

    files = {"/a": b"x" * 300 + b"\x90\x90" + b"yy", "/D": None, "/D/b": body(4000), "/D/E": None, "/D/E/c": b"", "/z/": b"zz"} | {"/z2": b"q"}
    files.pop("/z/")
    made = stuffit.write_stuffit(files, method)
    assert archives.kind_of(made) == "stuffit"
    got = {e.path: e for e in archives.READERS["stuffit"](made, True)}
    assert {p: e.content for p, e in got.items()} == files and got["/a"].type_code == "TEXT" and got["/D"].kind == "directory" and got["/a"].modified == "2024-01-01 00:00:00"
    hurt = bytearray(made)
    hurt[-140 if method == 0 else 25] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(stuffit.stuffit(bytes(hurt), True))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wide", [True, False])
def test_ufs(wide, order):
    files = TREE | {"/HUGE": body(200_000)}
    fs, found = filesystems.entries(images.ufs(files, wide, order), True)
    got = {e.path: e for e in found}
    assert fs == "ufs" and {p: e.content for p, e in got.items()} == files
    assert (got["/ODD"].mode, got["/ODD"].uid, got["/ODD"].gid, got["/ODD"].modified) == (0o100644, 7, 8, "1970-01-02 00:00:00")


def test_xfs_trees_of_extents():
    from platterlake.sources.unix import Xfs

    disk = bytearray(images.xfs({"/big": body(40_000)}))
    xfs = Xfs(bytes(disk))
    inode = xfs._inode(xfs.ROOT + 1)
    records, at = inode["fork"][: 16 * inode["count"]], xfs._place(xfs.ROOT + 1 >> 3) + 512
    node = 400  # the records move to a leaf, which the inode names
    disk[node * 4096 : node * 4096 + 72 + len(records)] = b"BMA3" + (0).to_bytes(2, "big") + inode["count"].to_bytes(2, "big") + bytes(64) + records
    disk[at + 5] = 3
    fork = bytearray(512 - 176)
    fork[:4], most = b"\0\1\0\1", (512 - 176 - 4) // 16
    fork[4 + 8 * most : 12 + 8 * most] = node.to_bytes(8, "big")
    disk[at + 176 : at + 512] = fork
    assert {e.path: e.content for e in Xfs(bytes(disk)).entries(True)} == {"/big": body(40_000)}


@pytest.mark.parametrize(("name", "disk"), [("ataridos", images.atari_dos(FLAT)), ("rsdos", images.rsdos(FLAT)), ("dragondos", images.dragon_dos(FLAT)), ("mfs", images.mfs(FLAT)), ("human68k", images.human68k(FLAT | {"A LONG NAME 12345.X": b"x"}))])
def test_flat_volumes(name, disk):
    fs, found = filesystems.entries(disk, True)
    assert fs == name and {e.path[1:]: e.content for e in found} == FLAT | ({"A LONG NAME 12345.X": b"x"} if name == "human68k" else {})


def test_cpm_with_a_given_layout():
    from platterlake.sources.floppies import CpM

    files = {"A.COM": body(20_000), "B": body(300)}
    got = {e.path[1:]: e.content for e in CpM(images.cpm(files)).entries(True)}
    assert {n: c[: len(files[n])] for n, c in got.items()} == files and all(len(c) % 128 == 0 for c in got.values())


def test_more_containers_give_the_same_bytes():
    disk = images.mbr([(0x06, 63, images.fat12(FILES), False)], 3 << 20)
    small, flat = images.d64(FLAT), body(40 * 9 * 512)
    for made, path, want in (
        (images.raw_vhd(disk), "a.vhd", disk), (images.vmdk(disk), "a.vmdk", disk), (images.twomg(disk), "a.2mg", disk), (images.dc42(disk), "a.dsk", disk), (images.dmg(disk), "a.dmg", disk),
        (images.chd(disk), "a.chd", disk), (images.partclone(disk), "a.img", disk), (images.edsk(flat), "a.dsk", flat), (images.g64(small), "a.g64", small[: 683 * 256]),
        (images.woz(body(143_360)), "a.woz", body(143_360)), (images.dos_ordered(images.prodos(FLAT)), "a.dsk", images.prodos(FLAT)),
    ):
        assert containers.flat(made, path) == want, path
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as z:
        z.write(disk)
    assert containers.flat(out.getvalue().to_pybytes(), "a.lz4") == disk
    assert containers._adc(b"\x82abc\x00\x02\x41\x00\x05") == b"abcabc" + b"abcab"


def test_allocation_maps_and_checks(spark, tmp_path):
    from platterlake.operators import checks

    disk = bytearray(images.fat12(FILES))
    fs, unit, runs = filesystems.allocation(bytes(disk))
    runs = list(runs)
    used = sum(n for _, n, u in runs if u)
    assert (fs, unit) == ("fat", 512) and used == 1 + 1 + -(-len(FILES["/SUBDIR/NESTED.TXT"]) // 512) and sum(n for _, n, _ in runs) == 2847
    (tmp_path / "good.img").write_bytes(disk)
    assert checks.check_images(spark, str(tmp_path)).count() == 0
    first = next(e for e in filesystems.entries(bytes(disk))[1] if e.path == "/HELLO.TXT").extents[0][0]
    at = 512 + first * 3 // 2  # the cluster of a file of one cluster is called free
    pair = int.from_bytes(disk[at : at + 2], "little")
    disk[at : at + 2] = (pair & 0x000F if first & 1 else pair & 0xF000).to_bytes(2, "little")
    (tmp_path / "bad.img").write_bytes(disk)
    assert [(r.image_id.rsplit("/", 1)[1], r.code, r.message) for r in checks.check_images(spark, str(tmp_path)).collect()] == [("bad.img", "ReferencedButFree", f"extent {first} of /HELLO.TXT")]
    rows = readers.read_allocation(spark, str(tmp_path)).groupBy("image_id").agg(F.sum("blocks").alias("n")).collect()
    assert [r.n for r in rows] == [2847, 2847]


def test_catalog_records_feed_the_checks(spark, tmp_path):
    from platterlake.operators import checks

    (tmp_path / "mac.img").write_bytes(images.hfs({"/Folder": None, "/Folder/a": b"x", "/b": b"y"}))
    rows = readers.read_catalog(spark, str(tmp_path)).collect()
    assert {(r.record, r.name) for r in rows} == {("directory", "Folder"), ("file", "a"), ("file", "b")}
    codes = {r.code for r in checks.check_catalog(*checks.catalog_relations(readers.read_catalog(spark, str(tmp_path)))).collect()}
    # the sample has no threads, no root folder, and stores no valences
    assert codes == {"MissingDirThread", "MissingParent", "ParentValenceMismatch"}


def test_runs_of_bitmaps():
    import random

    from platterlake.sources.entries import runs_of_bits

    rnd = random.Random(2)
    for count in (0, 1, 8, 9, 40_001, 100_000):
        bits = [rnd.random() < 0.5 if rnd.random() < 0.1 else i % 5000 < 3000 for i in range(count)]
        for high in (False, True):
            raw = bytes(sum(b << (7 - k if high else k) for k, b in enumerate(bits[i : i + 8])) for i in range(0, count, 8))
            found = list(runs_of_bits(raw, count, 7, high))
            assert [u for _, n, u in found for _ in range(n)] == bits and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:]))


def test_a_sparse_image_of_five_gigabytes(spark, tmp_path):
    volume, start = images.fat12(FILES), 5 << 30
    first, last = partitions.write_gpt([("EBD0A0A2-B9E5-4433-87C0-68B6B72699C7", start // 512, len(volume) // 512, "data")], (start + len(volume)) // 512 + 34)
    with open(tmp_path / "big.img", "wb") as f:
        f.write(first)
        f.seek(start)
        f.write(volume)
        f.truncate(start + len(volume) + 34 * 512)
        f.seek(-len(last), 2)
        f.write(last)
    found = {r.path: r for r in readers.read_entries(spark, str(tmp_path), contents=True).collect()}
    assert {p: bytes(r.content) for p, r in found.items() if r.kind == "file"} == {p: b for p, b in FILES.items() if b is not None}
    assert [(r.scheme, r.start_byte) for r in readers.read_partitions(spark, str(tmp_path)).collect()] == [("gpt", start)]
    assert [(r.container, r.scheme, r["length"]) for r in readers.probe(spark, str(tmp_path)).collect()] == [("raw", "gpt", start + len(volume) + 34 * 512)]
