import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from platterlake.functions import bits, dates, digests, names, sizes
from platterlake.operators import backup, carve, checks, compaction, copying, diff, edits, glob, layout, listing, rates


def one(spark, **columns):
    return tuple(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def test_braces_and_globs(spark):
    assert glob.expand_braces("a{b,c{1,2}}d") == ["abd", "ac1d", "ac2d"] and glob.expand_braces(r"\{a,b\}") == [r"\{a,b\}"]
    paths = ["/a.txt", "/d/a.TXT", "/d/e/b.txt", "/d/e/c.doc", "/x[1].txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    found = lambda *a, **k: sorted(r.path for r in glob.select(rows, *a, **k).collect())
    assert found("*.txt") == sorted(p for p in paths if p.lower().endswith(".txt"))
    assert found("*.txt", ignore_case=False) == ["/a.txt", "/d/e/b.txt", "/x[1].txt"]
    assert found("/d/*") == ["/d/a.TXT"] and found("/d/**") == ["/d/a.TXT", "/d/e/b.txt", "/d/e/c.doc"]
    assert found("e/{b,c}.*", ["*.doc"]) == ["/d/e/b.txt"] and found(r"x\[?].txt") == ["/x[1].txt"] and found("[!a]*.txt") == ["/d/e/b.txt", "/x[1].txt"]
    assert found("/d/e/*", ignore_case=False) == ["/d/e/b.txt", "/d/e/c.doc"]


def test_paths_and_references():
    assert glob.split_path(r"/a\/b//c\x/") == ["a/b", r"c\x"] and glob.split_path(":A:B/C", True) == ["A", "B/C"]
    assert glob.image_ref("d@x/i.img@2") == glob.ImageRef("d@x/i.img", 2) and glob.image_ref("i.img").partition is None
    with pytest.raises(ValueError):
        glob.image_ref("i.img@0")


def test_default_partition(spark):
    schema = "image_id string, part_index int, is_extended boolean, type_string string"
    rows = [("a", 0, False, "Apple_partition_map"), ("a", 1, False, "Apple_Driver43"), ("a", 2, False, "Apple_HFS"), ("b", 0, True, None), ("b", 1, False, None)]
    assert {tuple(r) for r in glob.default_partition(spark.createDataFrame(rows, schema)).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(Exception, match="choose a partition of c"):
        glob.default_partition(spark.createDataFrame([("c", 0, False, None), ("c", 1, False, None)], schema)).collect()


def test_sizes(spark):
    assert [sizes.parse_size(t) for t in ("512", "4K", "1 MiB", "2g", "7B")] == [512, 4096, 1 << 20, 2 << 30, 7]
    for bad in ("1T", "", "-1", "1.5K"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    with pytest.raises(OverflowError):
        sizes.parse_size("99999999999G")
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1280, 1331, 1 << 20, 1572864, 5 << 40)], "n long")
    want = ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.3 KiB", "1.0 MiB", "1.5 MiB", "5.0 TiB"]
    assert [r[0] for r in rows.select(sizes.format_size(F.col("n"))).collect()] == want
    lit = lambda v: F.lit(v).cast("long")
    assert one(spark, a=sizes.min_plus_20(lit(1000), lit(10_000)), b=sizes.min_plus_20(lit(9_990), lit(10_000)), c=sizes.min_plus_20(lit(20), lit(10)), d=sizes.align_up(lit(513), 512), e=sizes.pick_block_size(lit(100 << 20)))[:5] == (1536, 10_000, 10, 1024, 2048)
    assert one(spark, a=sizes.lba_to_chs(lit(1008), lit(16), lit(63)))[0] == (1, 0, 1) and one(spark, a=sizes.lba_to_chs(lit(5), lit(0), lit(63)))[0] == (0, 0, 0)
    assert one(spark, a=sizes.eta_text(lit(3723)), b=sizes.eta_text(lit(61)), c=sizes.eta_text(lit(9))) == ("1h 2m", "1m 1s", "9s")


def test_names_and_dates(spark):
    lit = lambda v: F.lit(v).cast("long")
    assert one(spark, a=names.mode_string(lit(0o104755)), b=names.mode_string(lit(0o041777)), c=names.mode_string(lit(0o100644))) == ("-rwsr-xr-x", "drwxrwxrwt", "-rw-r--r--")
    assert one(spark, a=names.sanitize(F.lit("--a b/c:é--_d")), b=names.prodos_code(F.lit(4)), c=names.safe_path(F.lit("a/../b")), d=names.ostype(F.lit(b"TE\x01T"))) == ("a-b-c-_d", "$04", False, "TE.T")
    assert one(spark, a=names.guid_text(F.lit(bytes(range(16)))))[0] == "03020100-0504-0706-0809-0A0B0C0D0E0F"
    assert one(spark, a=dates.mac_text(lit(0)), b=dates.mac_text(lit(5)), c=dates.amiga_to_unix(F.lit(0), F.lit(0), F.lit(0)), d=dates.amiga_to_unix(F.lit(1), F.lit(1), F.lit(100))) == (None, "1970-01-01 00:00:00", 0, 252547262)
    assert one(spark, a=names.device_numbers(lit(0x801)))[0] == (8, 1) and one(spark, a=names.text_kind(F.lit(' {"a":1}\n{"a":2}\n')), b=names.text_kind(F.lit("[1]")), c=names.text_kind(F.lit("x")))[:3] == ("jsonl", "json", "txt")


def test_digests(spark):
    chunks = spark.createDataFrame([("a", 1, b"b" * 10), ("a", 0, b"a"), ("b", 0, None), ("a", 2, b"c")], "k string, seq int, bytes binary")
    found = {r.k: r for r in digests.of_chunks(chunks, ["k"]).collect()}
    body = b"a" + b"b" * 10 + b"c"
    assert found["a"].sha256 == hashlib.sha256(body).hexdigest() and found["a"].md5 == hashlib.md5(body).hexdigest() and found["a"]["size"] == 12 and found["b"]["size"] == 0
    assert digests.crc16(b"123456789") == 0x31C3
    block = (5).to_bytes(4, "big") + bytes(4) + (7).to_bytes(4, "big")
    total = digests.word_checksum(block, 1)
    assert (5 + 7 + total) & 0xFFFFFFFF == 0
    assert one(spark, a=digests.is_zero(F.lit(bytes(9))), b=digests.is_zero(F.lit(b"\0\1"))) == (True, False)


def test_bitmaps(spark):
    rows = spark.createDataFrame([(b"\x05\x80", 16), (b"\xff", 4), (b"", 0)], "b binary, n int")
    got = rows.select(bits.set_positions(F.col("b"), F.col("n")), bits.highest_set(F.col("b"), F.col("n")), bits.lowest_clear(F.col("b"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [([0, 2, 15], 15, 1), ([0, 1, 2, 3], 3, None), ([], None, None)]


def test_diff_and_conflicts(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, size int")
    a, b = make([("x", 1), ("y", None), ("z", 3), ("w", None)]), make([("x", 1), ("y", 2), ("n", 0), ("w", None)])
    states = {r.path: r.state for r in diff.compare(a, b, ["path"], ["size"]).collect()}
    assert states == {"x": "unchanged", "y": "modified", "z": "removed", "n": "added", "w": "unchanged"}
    pick = lambda p: sorted((r.path, r["size"]) for r in diff.resolve_conflicts(make([("x", 9), ("q", 1)]), make([("x", 1)]), ["path"], p).collect())
    assert pick("skip") == [("q", 1), ("x", 1)] and pick("force") == [("q", 1), ("x", 9)]
    with pytest.raises(FileExistsError):
        pick("error")
    journal = spark.createDataFrame([(1, 0, b"a", True), (2, 0, b"b", True), (3, 0, b"c", False), (4, 1, b"d", True)], "seq int, block int, bytes binary, good boolean")
    blocks = spark.createDataFrame([(0, b"o"), (1, b"p")], "block int, bytes binary")
    assert {(r.block, bytes(r.bytes)) for r in diff.overlay(blocks, journal).collect()} == {(0, b"b"), (1, b"p")}


def test_catalog_faults_give_their_codes(spark):
    dirs = [("i", 2, 1, "root", 2), ("i", 16, 2, "sub", 0)]
    threads, entries = [("i", 2, 1, "root"), ("i", 16, 2, "sub")], [("i", 16, 2, "sub", "directory"), ("i", 17, 2, "f", "file")]
    schema = ("image_id string, cnid int, parent int, name string, valence int", "image_id string, cnid int, parent int, name string", "image_id string, cnid int, parent int, name string, kind string")

    def codes(d=dirs, t=threads, e=entries):
        return {r.code for r in checks.check_catalog(*(spark.createDataFrame(x, s) for x, s in zip((d, t, e), schema))).collect()}

    assert codes() == set()
    assert codes(t=threads[:1]) == {"MissingDirThread"} and codes(t=[*threads, ("i", 99, 2, "x")]) == {"OrphanedThread"}
    assert codes(t=[threads[0], ("i", 16, 2, "SUB")]) == {"ThreadParentNameMismatch"} and codes(e=[*entries, ("i", 18, 55, "g", "file")]) == {"MissingParent"}
    assert codes(d=[("i", 2, 1, "root", 3), dirs[1]]) == {"ParentValenceMismatch"} and "DuplicateCnid" in codes(e=[*entries, ("i", 17, 16, "h", "file")])
    chain = spark.createDataFrame([("i", 0, 1, 2, None), ("i", 1, 2, 3, 1), ("i", 2, 3, None, 9)], "image_id string, place int, node int, forward int, back int")
    assert [r.node for r in checks.broken_links(chain, ["image_id"], "place", "node", "forward", "back").collect()] == [2]


def test_layouts(spark):
    rows = [("i", 0, 1 << 20, 1 << 20, (1 << 20) + 512, 10 << 20), ("i", 1, 2 << 20, 1 << 20, None, 10 << 20)]
    parts = spark.createDataFrame(rows, "image_id string, part_index int, start_byte long, size_bytes long, new_size long, disk_size long")
    plan = lambda a: sorted((r.part_index, r.new_start, r.move_delta, r.fits) for r in layout.resize_plan(parts, a).collect())
    assert plan(0) == [(0, 1 << 20, 0, True), (1, (2 << 20) + 512, 512, True)] and plan(2048) == [(0, 1 << 20, 0, True), (1, 3 << 20, 1 << 20, True)]
    logical = spark.createDataFrame([("i", 0, 63, False, 1 << 20), ("i", 5, 9000, True, 1 << 20), ("i", 4, 5000, True, 1 << 20)], "image_id string, part_index int, start_lba long, is_logical boolean, size long")
    assert [(r.part_index, r.new_lba) for r in layout.restore_layout(logical).collect()] == [(0, 2048), (4, 6144), (5, 10240)]
    starts = spark.createDataFrame([("d", 63), ("d", 4000), ("m", 2048), ("m", 6144), ("c", 128), ("c", 192), ("n", 7)], "image_id string, start_lba long")
    assert {(r.image_id, r.kind, r.sectors) for r in layout.detect_alignment(starts).collect()} == {("d", "dos", 16065), ("m", "modern", 2048), ("c", "custom", 64), ("n", "none", 1)}
    table = spark.createDataFrame([("i", 0, 10, 512, 6, False, False), ("i", 1, 20, 512, 6, False, False)], "image_id string, part_index int, start_lba long, size_bytes long, type_byte long, bootable boolean, is_extended boolean")
    log = spark.createDataFrame([("i", 1, "resize", 0, 1024), ("i", 2, "resize", 0, 2048), ("i", 3, "delete", 1, 1), ("i", 4, "bootable", 0, 1)], "image_id string, seq int, kind string, part_index int, value long")
    assert [tuple(r)[:6] for r in layout.apply_table_edits(table, log).collect()] == [("i", 0, 10, 2048, 6, True)]


def test_carving_and_compaction(spark):
    rows = spark.createDataFrame([(1, "x" * 70 + "\0" + "short" + "\0" + "y" * 64)], "id int, t string")
    assert [(r.ordinal, len(r.run)) for r in carve.text_runs(rows, "id", "t").collect()] == [(0, 70), (1, 64)]
    assert [r.truncated for r in carve.text_runs(rows, "id", "t", entries=1).collect()] == [True]
    used = spark.createDataFrame([("i", n, n not in (2, 3)) for n in range(6)], "image_id string, block_no long, used boolean")
    assert sorted((r.start, r.length) for r in carve.block_runs(used, ["image_id"], "block_no", "used").collect()) == [(0, 2), (4, 2)]
    assert sorted((r.start, r.length) for r in carve.block_runs(used, ["image_id"], "block_no", "used", segment=2).collect()) == [(0, 2), (4, 2)]
    dense = spark.range(40).selectExpr("'i' AS image_id", "id AS block_no", "id NOT IN (7, 20) AS used")
    assert sorted((r.start, r.length) for r in carve.block_runs(dense, ["image_id"], "block_no", "used", segment=4).collect()) == [(0, 7), (8, 12), (21, 19)]
    assert sorted((r.block_no, r.new_block) for r in compaction.renumber(used, ["image_id"]).collect()) == [(0, 0), (1, 1), (4, 2), (5, 3)]
    blocks = spark.createDataFrame([("i", n, bytes([n])) for n in range(6)], "image_id string, block_no long, bytes binary")
    live = compaction.live(blocks, used, ["image_id", "block_no"])
    back = compaction.expand(spark.createDataFrame([("i", 6)], "image_id string, blocks long"), live).orderBy("block_no").collect()
    assert [None if r.bytes is None else bytes(r.bytes) for r in back] == [b"\0", b"\1", None, None, b"\4", b"\5"]


def test_edits_scripts_and_copies(spark):
    schema = "path string, kind string, size long, mode int"
    entries = spark.createDataFrame([("/a", "directory", None, 1), ("/a/b", "file", 5, 1), ("/ab", "file", 6, 1), ("/c", "file", 7, 1)], schema)
    log = spark.createDataFrame([(1, "delete", "/a", None, None, None, None), (2, "set", "/ab", None, None, 9, None), (3, "rename", "/c", None, None, None, "/d"), (4, "create", "/n", "file", 1, 2, None)], "seq int, op string, path string, kind string, size long, mode int, new_path string")
    assert sorted(tuple(r) for r in edits.apply_edits(entries, log).collect()) == [("/ab", "file", 6, 9), ("/d", "file", 7, 1), ("/n", "file", 1, 2)]
    assert [r.op for r in edits.script(spark, '[{"op": "mkdir", "path": "/x"}, {"op": "rm", "path": "/y"}]').collect()] == ["mkdir", "rm"]
    for bad in ('[{"op": "nope"}]', '[{"op": "put", "path": "/x"}]'):
        with pytest.raises(ValueError):
            edits.script(spark, bad)
    rows = spark.createDataFrame([("fat", 420, 1), ("ext", 420, None)], "fs_type string, mode int, attr int")
    got = copying.translate(rows, copying.capabilities(spark), {"mode": "unix_mode", "attr": "dos_attributes"}).collect()
    assert sorted((r.fs_type, r.mode, r.attr, tuple(r.dropped)) for r in got) == [("ext", 420, None, ()), ("fat", None, 1, ("unix_mode",))]


def test_listing(spark):
    rows = spark.createDataFrame([("b", False, 0), ("A", False, 1), ("z", True, 2), ("a", False, 3)], "name string, d boolean, i int")
    order = lambda desc: [r.name for r in listing.sort_listing(rows, F.lower("name"), F.col("d"), F.col("i"), desc).collect()]
    assert order(False) == ["z", "A", "a", "b"] and order(True) == ["z", "b", "a", "A"]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 7), (7, 6)], "n long, p long")
    assert {(r.node, r.root, r.depth) for r in listing.closure(tree, "n", "p").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 5, 0)}


def test_deep_trees_are_whole(spark):
    chain = spark.range(500).selectExpr("id AS n", "CASE WHEN id > 0 THEN id - 1 END AS p")
    assert {(r.node, r.root, r.depth) for r in listing.closure(chain, "n", "p").collect()} == {(n, 0, n) for n in range(500)}


def test_names_are_made_unique_until_they_are_free(spark):
    names_ = ["a", "a", "a~1", "b.txt", "b.txt", "b.txt", "b~2.txt", "A", ".x", ".x", "c.", "c.", None, None, "a~1"]
    rows = spark.createDataFrame([("f", n, i) for i, n in enumerate(names_)] + [("g", "a", 99)], "folder string, name string, i int")
    got = [r.unique_name for r in listing.unique_names(rows, "folder", "name", "i").orderBy("i").collect()]
    assert got[:8] == ["a", "a~1", "a~1~1", "b.txt", "b~1.txt", "b~2.txt", "b~2~1.txt", "A"]
    assert got[8:12] == [".x", ".x~1", "c.", "c.~1"] and got[14:] == ["a~1~2", "a"]
    assert len(set(filter(None, got[:-1]))) == 13


def test_edits_apply_in_order(spark):
    schema = "path string, kind string, size long, mode int"
    log = "seq int, op string, path string, kind string, size long, mode int, new_path string"
    tree = [("/a", "directory", None, 1), ("/a/b", "file", 5, 1), ("/a/b.c", "file", 6, 1), ("/ab", "file", 7, 1), ("/z", "file", 8, 1)]

    def after(*edits_):
        return sorted(map(tuple, edits.apply_edits(spark.createDataFrame(tree, schema), spark.createDataFrame([(k, *e) for k, e in enumerate(edits_, 1)], log)).collect()))

    none = (None, None, None, None)
    assert after(("set", "/z", None, None, 9, None), ("set", "/z", None, 3, None, None))[-1] == ("/z", "file", 3, 9)
    assert after(("create", "/a/new", "file", 1, 1, None), ("delete", "/a", *none)) == [("/ab", "file", 7, 1), ("/z", "file", 8, 1)]
    assert after(("rename", "/a", None, None, None, "/q")) == [("/ab", "file", 7, 1), ("/q", "directory", None, 1), ("/q/b", "file", 5, 1), ("/q/b.c", "file", 6, 1), ("/z", "file", 8, 1)]
    assert after(("rename", "/a/b", None, None, None, "/t"), ("rename", "/z", None, None, None, "/a/b"), ("rename", "/t", None, None, None, "/z"))[1:3] == [("/a/b", "file", 8, 1), ("/a/b.c", "file", 6, 1)]
    assert after(("delete", "/z", *none), ("create", "/z", "file", 1, 2, None), ("set", "/z", None, None, 4, None))[-1] == ("/z", "file", 1, 4)
    assert after(("set", "/nothing", None, 1, 1, None), ("delete", "/none", *none)) == sorted(tree)
    assert after(("rename", "/ab", None, None, None, "/z"))[-1] == ("/z", "file", 7, 1)


def test_comparison_takes_the_last_of_repeated_paths(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, size int, n int")
    a, b = make([("x", 1, 0), ("x", 2, 1), (None, 3, 0)]), make([("x", 9, 0), ("x", 2, 1), (None, 3, 0)])
    assert sorted(map(tuple, diff.compare(a, b, ["path"], ["size"], "n").collect()), key=str) == [("x", "unchanged"), (None, "unchanged")]
    assert [r["size"] for r in diff.last_of(make([("x", 1, None), ("x", 2, 0)]), ["path"], "n").collect()] == [2]


def test_text_kinds_and_line_ends_in_globs(spark):
    texts = ['{"a":1}\n', '{"a":1}\n\n', '{"a":1}\n{', "\n{", "\n\n{", " [1]\n2", "x{\n1", " " * 200 + "{"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in rows.select("i", names.text_kind(F.col("t")).alias("k")).orderBy("i").collect()] == ["json", "json", "jsonl", "json", "jsonl", "json", "txt", "txt"]
    paths = spark.createDataFrame([("/en/a\n",), ("/en/a",), ("/en/a\nb",)], "path string")
    assert [r.path for r in glob.select(paths, "/en/?").collect()] == ["/en/a"] and glob.select(paths, "/en/*b").count() == 1


def test_rates_and_backups(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    samples = spark.createDataFrame([("k", at(0), 0, "a"), ("k", at(1), 100, "a"), ("k", at(12), 1200, "a"), ("k", at(13), 5, "b"), ("k", at(13.1), 6, "b")], "k string, ts timestamp, n long, stage string")
    assert [r.rate for r in rates.rolling_rate(samples, ["k"], "ts", "n", "stage").orderBy("ts").collect()] == [None, 100.0, None, None, None]
    blocks = spark.createDataFrame([("i", 0, n, bytes([n]) * 8) for n in range(4)], "image_id string, part_index int, block_no long, bytes binary")
    backup.write_blocks(blocks, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 3  # the block of zeros is left out
    want = backup.manifest(blocks.where("block_no > 0"), ["part_index"])
    assert [r.state for r in backup.verify(want, backup.manifest(back, ["part_index"]), ["part_index"]).collect()] == ["ok"]
    assert '"schema_version":1' in backup.envelope(spark.range(2)).first()[0]
    with pytest.raises(ValueError):
        backup.require_flat(spark.range(1).select(F.array("id").alias("a")))


def test_streams(spark, tmp_path):
    from platterlake.streaming import rates as streams

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    samples = spark.createDataFrame([("k", at(i), "s", 100 * i) for i in range(5)], "k string, ts timestamp, stage string, bytes long")
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.arriving(spark, str(tmp_path / "in"), "k string, ts timestamp, stage string, bytes long")
    query = streams.rolling(stream, "k").writeStream.format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted((r.bytes, r.rate) for r in spark.table("rolled").collect() if r.rate) == [(100 * i, 100.0) for i in range(1, 5)]
