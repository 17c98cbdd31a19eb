"""Scalars, checks and layouts over values built from the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from platterlake.functions import bits, dates, digests, names, sizes
from platterlake.operators import backup, carve, checks, compaction, copying, diff, edits, glob, layout, listing, selection
from platterlake.plans.common import Registry, read
from platterlake.sources import resource, sniff

R = Registry()

#: SQL: the bytes of an ASCII text, and the CRC-32 of a list of bytes, bit by bit.
_BYTES = "list_transform(range(1, length({t}) + 1), lambda i: CAST(ord(substr({t}, i, 1)) AS BIGINT))"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {b}), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT))), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _crc(text: str) -> str:
    return _CRC.format(b=_BYTES.format(t=text))


@R.add(f"SELECT c_custkey, lpad(printf('%x', {_crc('c_name')}), 8, '0') AS crc32, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def four_digests(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", *digests.four(F.col("c_name")))


@R.add("SELECT doc_id, sha256(substr(c, 11, 50)) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS c FROM documents)")
def range_digest(spark, sf_dir):
    plain = F.regexp_replace("text", "[^ -~]", "?")
    return read(spark, sf_dir, "documents").select("doc_id", digests.of_range(plain, 10, 50).alias("digest"))


_HEADER = "(SELECT c_custkey, c_name || c_mktsegment || c_name AS t FROM customer)"
_ZEROED = f"list_concat({_BYTES.format(t='substr(t, 1, 16)')}, list_concat([CAST(0 AS BIGINT), 0, 0, 0], {_BYTES.format(t='substr(t, 21)')}))"


@R.add(f"SELECT c_custkey, {_CRC.format(b=_ZEROED)} AS crc FROM {_HEADER}")
def header_crc32(spark, sf_dir):
    data = F.concat("c_name", "c_mktsegment", "c_name").cast("binary")
    return read(spark, sf_dir, "customer").select("c_custkey", digests.header_crc32(data).alias("crc"))


@R.add("SELECT p_partkey, p_size % 3 = 0 AS zero FROM part")
def zero_blocks(spark, sf_dir):
    data = F.when(F.col("p_size") % 3 == 0, F.unhex(F.repeat(F.lit("00"), F.col("p_size")))).otherwise(F.unhex(F.concat(F.repeat(F.lit("00"), F.col("p_size")), F.lit("01"))))
    return read(spark, sf_dir, "part").select("p_partkey", digests.is_zero(data).alias("zero"))


@R.add("SELECT c_custkey, lower(md5(c_name)) AS digest, c_name || '.img' AS name FROM customer")
def parsed_sidecar(spark, sf_dir):
    line = digests.sidecar(F.md5("c_name"), F.concat("c_name", F.lit(".img")))
    return read(spark, sf_dir, "customer").select("c_custkey", digests.parse_sidecar(line).alias("p")).select("c_custkey", F.lower("p.digest").alias("digest"), "p.name")


@R.add("""SELECT p_partkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS guid
FROM (SELECT p_partkey, upper(md5(p_name)) AS h FROM part)""")
def guid_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.guid_text(F.unhex(F.md5("p_name"))).alias("guid"))


@R.add("SELECT p_partkey, (d >> 8) & 4095 AS major, (d & 255) | ((d >> 12) & 1048320) AS minor FROM (SELECT p_partkey, CAST(p_partkey * 7919 AS BIGINT) AS d FROM part)")
def device_numbers(spark, sf_dir):
    device = F.col("p_partkey").cast("long") * 7919
    return read(spark, sf_dir, "part").select("p_partkey", names.device_numbers(device).alias("d")).select("p_partkey", "d.major", "d.minor")


@R.add("SELECT p_partkey, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) BETWEEN 32 AND 126 THEN chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT)) ELSE '.' END), '') AS code FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def ostype_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.ostype(F.substring(F.unhex(F.md5("p_name")), 1, 4)).alias("code"))


@R.add("SELECT p_partkey, printf('$%02X', p_partkey % 256) AS code FROM part")
def prodos_code(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.prodos_code(F.col("p_partkey") % 256).alias("code"))


@R.add("SELECT p_partkey, list_reduce(list_prepend(CAST(length(p_name) AS BIGINT), list_transform(range(1, length(p_name) + 1), lambda i: CAST(ord(substr(upper(p_name), i, 1)) AS BIGINT))), lambda h, c: (h * 13 + c) & 2047) % 72 AS bucket FROM part")
def name_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.name_hash(F.col("p_name")).cast("long").alias("bucket"))


@R.add("SELECT p_partkey, CASE WHEN p_size & 1 != 0 THEN 'R' ELSE '' END || CASE WHEN p_size & 2 != 0 THEN 'H' ELSE '' END || CASE WHEN p_size & 4 != 0 THEN 'S' ELSE '' END || CASE WHEN p_size & 32 != 0 THEN 'A' ELSE '' END AS letters FROM part")
def attribute_letters(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.attribute_letters(F.col("p_size")).alias("letters"))


_PATHS = ("concat({a}, '/', {b})", "concat('/', {a})", "concat({a}, '/../', {b})", "concat('..', {a})", "concat({a}, '/..')")


@R.add("SELECT p_partkey, p_partkey % 5 IN (0, 3) AS safe FROM part")
def safe_paths(spark, sf_dir):
    kinds = [F.expr(t.format(a="p_name", b="p_brand")) for t in _PATHS]
    return read(spark, sf_dir, "part").select("p_partkey", names.safe_path(F.get(F.array(*kinds), F.col("p_partkey") % 5)).alias("safe"))


@R.add("SELECT p_partkey, p_partkey % 4 = 0 AND length(p_name) <= 20 AS valid FROM part")
def name_validity(spark, sf_dir):
    name = F.get(F.array(F.col("p_name"), F.lit(""), F.concat("p_name", F.lit("/x")), F.repeat("p_name", F.lit(9))), F.col("p_partkey") % 4)
    return read(spark, sf_dir, "part").select("p_partkey", names.valid_name(name, 20).alias("valid"))


@R.add("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS start, c_mktsegment AS kind FROM customer")
def key_values(spark, sf_dir):
    line = F.concat(F.lit("/dev/sda1 : start= "), F.col("c_custkey").cast("string"), F.lit(", size=7, type="), "c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_custkey", names.key_value(line, "start").alias("start"), names.key_value(line, "type").alias("kind"))


@R.add("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM events")
def unix_time_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", dates.unix_text(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("text"))


@R.add("SELECT event_id, epoch_us(ts) // 1000000 // 2 * 2 AS unix FROM events")
def fat_dates(spark, sf_dir):
    ts = F.col("ts")
    date = (F.year(ts) - 1980) * 512 + F.month(ts) * 32 + F.day(ts)
    time = F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2).cast("int")
    return read(spark, sf_dir, "events").select("event_id", dates.fat_to_unix(date, time).cast("long").alias("unix"))


@R.add("SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS eta FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS s FROM orders)")
def eta_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.eta_text((F.floor("o_totalprice") % 20000).cast("long")).alias("eta"))


@R.add("SELECT o_orderkey, CAST(CASE WHEN v // 512 <= 65535 THEN 512 ELSE 512 * pow(2, ceil(log2((v // 512 + 1) / 65536.0::DOUBLE))) END AS BIGINT) AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 4099 AS v FROM orders)")
def block_size_pick(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.pick_block_size((F.floor("o_totalprice") * 4099).cast("long")).cast("long").alias("size"))


@R.add("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (least + 511) // 512 * 512 WHEN 1 THEN (777 + 511) // 512 * 512 WHEN 2 THEN CASE WHEN 9000000 > o_custkey * 512 THEN 9000000 - o_custkey * 512 ELSE original END ELSE original END AS BIGINT) AS size
FROM (SELECT *, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN original - 9 END, CASE WHEN o_orderkey % 5 = 0 THEN original - 600 END, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 2 END, original) AS least FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS original FROM orders))""")
def restore_size(spark, sf_dir):
    original, key = F.floor("o_totalprice").cast("long"), F.col("o_orderkey")
    choice = F.get(F.array(*map(F.lit, ("minimum", "custom", "fill", "original"))), key % 4)
    size = sizes.restore_size(choice, original, F.when(key % 5 == 0, original - 600), F.when(key % 3 == 0, original - 9), key % 2, F.lit(777).cast("long"), F.col("o_custkey"), F.lit(9_000_000).cast("long"))
    return read(spark, sf_dir, "orders").select("o_orderkey", size.cast("long").alias("size"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(a, b) ELSE coalesce(b, a) END AS size FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + 1 END AS b FROM orders)")
def shrink_target(spark, sf_dir):
    key, a = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.shrink_target(key % 2 == 0, F.when(key % 3 > 0, a), F.when(key % 5 > 0, a + 1)).alias("size"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey * 512 END AS start, CASE WHEN o_custkey > o_orderkey THEN o_custkey - o_orderkey ELSE 0 END AS free FROM orders")
def offsets_and_free_bytes(spark, sf_dir):
    start = sizes.byte_offset(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")), F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), sizes.free_bytes(F.col("o_custkey"), F.col("o_orderkey")).cast("long").alias("free"))


@R.add("SELECT CAST(c_nationkey AS VARCHAR) AS image_id, min(CAST(c_custkey AS INTEGER)) AS part_index FROM customer GROUP BY 1")
def default_partition(spark, sf_dir):
    """Of a nation's customers all but the first are drivers, maps or containers."""
    rows = read(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS STRING) AS image_id", "CAST(c_custkey AS INT) AS part_index", "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n")
    kind = F.when(F.col("n") % 3 == 2, "Apple_Driver43").when(F.col("n") % 3 == 0, "Apple_partition_map")
    return glob.default_partition(rows.select("image_id", "part_index", ((F.col("n") > 1) & (F.col("n") % 3 == 1)).alias("is_extended"), kind.alias("type_string")))


@R.add("SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path FROM pages) WHERE regexp_full_match(path, '/en/.*[0-9]')")
def glob_to_the_end(spark, sf_dir):
    """A path that ends with a line end does not match what ends before it."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    pages = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    both = pages.union(pages.select("page_id", F.concat("path", F.lit("\n"))))
    return glob.select(both, "/en/**[0-9]", ignore_case=False)


@R.add("""WITH t AS (SELECT user_id, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS following, lag(event_id) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, event_id, n, CASE WHEN event_id % 50 = 1 THEN 0 ELSE following END AS forward, CASE WHEN event_id % 70 = 1 THEN -1 ELSE previous END AS back FROM t)
SELECT event_id FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY n) AS a, lead(back) OVER (PARTITION BY user_id ORDER BY n) AS b FROM s) WHERE a IS DISTINCT FROM forward OR (a IS NOT NULL AND b IS DISTINCT FROM event_id)""")
def leaf_chain(spark, sf_dir):
    """Events as nodes of a chain, of which some link to the wrong neighbour."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"row_number() {w} AS n", f"lead(event_id) {w} AS following", f"lag(event_id) {w} AS previous")
    nodes = rows.selectExpr("user_id", "event_id", "n", "CASE WHEN event_id % 50 = 1 THEN 0 ELSE following END AS forward", "CASE WHEN event_id % 70 = 1 THEN -1 ELSE previous END AS back")
    return checks.broken_links(nodes, ["user_id"], "n", "event_id", "forward", "back").select("event_id")


@R.add("""WITH e AS (SELECT n_nationkey AS cnid, n_regionkey AS parent FROM nation) SELECT 'i' AS image_id, 'error' AS severity, code, message FROM (
SELECT 'MissingDirThread' AS code, 'directory ' || r_regionkey AS message FROM region WHERE r_regionkey = 4
UNION ALL SELECT 'OrphanedThread', 'thread 99'
UNION ALL SELECT 'MissingParent', 'entry ' || (100 + n_nationkey) FROM nation WHERE n_nationkey % 7 = 0
UNION ALL SELECT 'ThreadParentNameMismatch', 'directory 2'
UNION ALL SELECT 'ParentValenceMismatch', 'directory ' || r_regionkey FROM region JOIN (SELECT n_regionkey, count(*) FILTER (n_nationkey % 7 != 0) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey WHERE n != 4
UNION ALL SELECT 'DuplicateCnid', 'entry 105')""")
def catalog_check(spark, sf_dir):
    """Regions as folders and nations as files, with faults of every kind."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    folders = region.select(F.lit("i").alias("image_id"), F.col("r_regionkey").cast("int").alias("cnid"), F.lit(-1).alias("parent"), F.col("r_name").alias("name"), F.lit(4).alias("valence"))
    threads = folders.where("cnid != 4").select("image_id", "cnid", "parent", F.when(F.col("cnid") == 2, F.lower("name")).otherwise(F.col("name")).alias("name"))
    threads = threads.union(folders.where("cnid = 0").select("image_id", F.lit(99), "parent", "name"))
    parent = F.when(F.col("n_nationkey") % 7 == 0, 77).otherwise(F.col("n_regionkey")).cast("int")
    number = F.when(F.col("n_nationkey") == 6, 105).otherwise(F.col("n_nationkey") + 100).cast("int")
    files = nation.select(F.lit("i").alias("image_id"), number.alias("cnid"), parent.alias("parent"), F.col("n_name").alias("name"), F.lit("file").alias("kind"))
    return checks.check_catalog(folders, threads, files)


_SWAP = (("WIN386.SWP", 0x02, "/"), ("PAGEFILE.SYS", 0x04, "/"))


@R.add("SELECT p_partkey FROM part WHERE NOT ((p_partkey % 3 = 0 AND p_size & 2 != 0 AND p_partkey % 2 = 0) OR (p_partkey % 3 = 1 AND p_size & 4 != 0 AND p_partkey % 2 = 0))")
def volatile_filter(spark, sf_dir):
    key = F.col("p_partkey")
    files = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("win386.swp", "PageFile.sys", "other.txt"))), key % 3).alias("name"), F.col("p_size").alias("attr"), F.when(key % 2 == 0, "/").otherwise("/sub").alias("folder"))
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule_name"), F.lit(b).alias("rule_bits"), F.lit(f).alias("rule_folder")) for n, b, f in _SWAP))))
    return diff.drop_volatile(files, rules).select("p_partkey")


@R.add("""SELECT c_custkey, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(coalesce(last, 1000000) AS BIGINT) AS last_data_byte, CAST((coalesce(used, 0) + 4095) // 4096 * 4096 AS BIGINT) AS packed
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_custkey % 97 + 1) AS used, max(o_orderkey + o_custkey % 97 + 1) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def volume_sizes(spark, sf_dir):
    extents = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("start"), (F.col("o_custkey") % 97 + 1).alias("length"))
    volumes = read(spark, sf_dir, "customer").select("c_custkey", F.lit(1_000_000).cast("long").alias("total"), F.lit(4096).alias("unit"))
    found = compaction.sizes(extents, volumes, ["c_custkey"])
    return found.select("c_custkey", *(F.col(c).cast("long").alias(c) for c in ("used", "last_data_byte", "packed")))


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS minimum, CASE WHEN p_partkey % 3 = 0 THEN 'known' ELSE 'deferred' END AS state FROM part")
def minimum_deferred(spark, sf_dir):
    cheap = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    return compaction.minimum_size(read(spark, sf_dir, "part").select("p_partkey", "p_size"), cheap, F.lit(7), False).select("p_partkey", "minimum", "state")


@R.add("SELECT CAST(o_custkey AS VARCHAR) AS image_id, CAST(sum(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END) + 1048576 AS BIGINT) AS work, CAST(max(o_orderkey) AS BIGINT) AS output, CAST(sum(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END) + 1048576 + max(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def export_usage(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("image_id"), (F.col("o_orderkey") % 5 == 0).alias("is_extended"), F.when(F.col("o_orderkey") % 7 == 0, 0xEE).alias("type_byte"), F.col("o_custkey").alias("size_bytes"), "o_orderkey")
    return compaction.export_usage(rows, F.col("o_orderkey"), True)


@R.add("SELECT count(*) FILTER (p_size % 4 = 0 AND p_partkey % 3 = 0) AS files, count(*) FILTER (p_size % 4 = 1 AND p_partkey % 3 = 0) AS directorys, count(*) FILTER (p_partkey % 3 = 1) AS skipped, count(*) FILTER (p_partkey % 3 = 2) AS failed, count(*) FILTER (p_partkey % 2 = 0) AS dropped_owner, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS bytes FROM part")
def copy_statistics(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda i, *values: F.get(F.array(*map(F.lit, values)), i)
    rows = read(spark, sf_dir, "part").select(pick(F.col("p_size") % 4, "file", "directory", "symlink", "special").alias("kind"), pick(key % 3, "copied", "skipped", "failed").alias("state"), F.when(key % 2 == 0, F.array(F.lit("owner"))).otherwise(F.array().cast("array<string>")).alias("dropped"), F.col("p_size").alias("size"))
    return copying.statistics(rows).select("files", "directorys", "skipped", "failed", "dropped_owner", F.col("bytes").cast("long").alias("bytes"))


@R.add("SELECT image_id, path, line FROM (SELECT CAST(r_regionkey AS VARCHAR) AS image_id, '/' || r_name AS path, r_name || '/' AS line FROM region UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/' || r_name || '/' || n_name, '  ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey)")
def tree_lines(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    image = F.col("r_regionkey").cast("string").alias("image_id")
    folders = region.select(image, F.concat(F.lit("/"), "r_name").alias("path"), F.col("r_name").alias("name"), F.lit("directory").alias("kind"))
    files = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(image, F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name"), "n_name", F.lit("file"))
    return listing.tree_text(folders.union(files))


@R.add("""SELECT doc_id, CAST(i - 1 AS BIGINT) AS ordinal, r[i] AS run, len(r) > 2 AS truncated FROM (SELECT doc_id, r, unnest(range(1, least(len(r), 2) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\t\\n\\r -~]{64,}') AS r FROM documents))""")
def carve_capped(spark, sf_dir):
    """The entry cap is the operator's feature: what lies beyond is told by `truncated`."""
    found = carve.text_runs(read(spark, sf_dir, "documents"), "doc_id", "text", entries=2)
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "run", "truncated")


@R.add("SELECT CAST(o_custkey AS VARCHAR) AS image_id, CAST(o_orderkey AS INTEGER) AS part_index, o_orderkey * 512 + o_custkey * 7 > lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 512 AS collides FROM orders")
def kept_positions(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("image_id"), F.col("o_orderkey").cast("int").alias("part_index"), F.col("o_orderkey").alias("start_lba"), (F.col("o_custkey") * 7).alias("size"))
    return layout.keep_positions(rows).select("image_id", "part_index", "collides")


@R.add("""SELECT o_custkey AS image_id, CAST(o_orderkey AS INTEGER) AS part_index, o_orderkey AS start_lba, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 2 WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS size_bytes, o_orderkey % 5 = 0 AS bootable FROM orders WHERE o_orderkey % 11 != 0""")
def table_edits(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), key.cast("int").alias("part_index"), key.alias("start_lba"), key.alias("size_bytes"), F.lit(6).cast("long").alias("type_byte"), F.lit(False).alias("bootable"), F.lit(False).alias("is_extended"))
    edit = lambda when, seq, kind, value: rows.where(when).select("image_id", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), "part_index", value.cast("long").alias("value"))
    log = edit("start_lba % 3 = 0", 1, "resize", F.col("start_lba") + 1).union(edit("start_lba % 2 = 0", 2, "resize", F.col("start_lba") + 2)).union(edit("start_lba % 5 = 0", 3, "bootable", F.lit(1))).union(edit("start_lba % 11 = 0", 4, "delete", F.lit(1)))
    return layout.apply_table_edits(rows, log).select("image_id", "part_index", "start_lba", "size_bytes", "bootable")


@R.add("SELECT p_partkey, b & 1 != 0 AS zero, CASE WHEN b & 1 = 0 THEN 0 WHEN b & 2 = 0 THEN 1 WHEN b & 4 = 0 THEN 2 WHEN b & 8 = 0 THEN 3 END AS lowest FROM (SELECT p_partkey, p_partkey & 255 AS b FROM part)")
def bitmap_gaps(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex(F.col("p_partkey").bitwiseAND(F.lit(255))), 2, "0"))
    rows = read(spark, sf_dir, "part").select("p_partkey", raw.alias("bitmap"))
    return rows.select("p_partkey", F.array_contains(bits.set_positions(F.col("bitmap"), F.lit(4)), 0).alias("zero"), bits.lowest_clear(F.col("bitmap"), F.lit(4)).alias("lowest"))


@R.add("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS steps, (SELECT count(*) FROM region) AS folders")
def script_steps(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    rows = region.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit("directory").alias("kind"))
    made = edits.script_for(rows.union(nation.select(F.concat(F.lit("/x/"), "n_name"), F.lit("file"))))
    return made.agg(F.count("step").alias("steps"), F.count_if(F.get_json_object("step", "$.op") == "mkdir").alias("folders"))


#: Volumes built of a row: what is put where, and what it must be taken for.
_MAGICS = (
    ("ntfs", 3, "4E54465320202020"), ("exfat", 3, "4558464154202020"), ("xfs", 0, "58465342"), ("hfs", 1024, "4244"), ("hfsplus", 1024, "482B"), ("hfsplus", 1024, "4858"), ("mfs", 1024, "D2D7"),
    ("ext", 1080, "53EF"), ("efs", 540, "00072959"), ("affs", 0, "444F5303"), ("qdos", 0, "514C5741"), ("andos", 504, "414E444F53"), (None, 100, "FF"), (None, 1148, "482B"),
)


def _placed(cases, size: int) -> Column:
    """Zeros with the magic of a row's case in its place."""
    hexed = [F.lit("00" * at + magic + "00" * (size - at - len(magic) // 2)) for _, at, magic in cases]
    return F.unhex(F.get(F.array(*hexed), F.col("p_partkey") % len(cases)))


def _expected(cases) -> str:
    return "CASE p_partkey % {n} {whens} END".format(n=len(cases), whens=" ".join(f"WHEN {k} THEN {'NULL' if name is None else repr(name)}" for k, (name, *_) in enumerate(cases)))


@R.add(f"SELECT p_partkey, {_expected(_MAGICS)} AS fs FROM part")
def sniffed_filesystem(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sniff.filesystem(_placed(_MAGICS, 1600)).alias("fs"))


_TABLES = (("sgi", 0, "0BE5A941"), ("apm", 0, "4552"), ("rdb", 1024, "5244534B"), ("x68k", 2048, "5836384B"), ("mbr", 510, "55AA"), ("unknown", 30, "01"))


@R.add(f"SELECT p_partkey, {_expected(_TABLES)} AS scheme FROM part")
def sniffed_scheme(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sniff.scheme(_placed(_TABLES, 2200)).alias("scheme"))


_BOXES = (("gzip", 0, "1F8B"), ("zstd", 0, "28B52FFD"), ("zip", 0, "504B0304"), ("chd", 0, "4D436F6D70724844"), ("qcow2", 0, "514649FB"), ("vmdk", 0, "4B444D56"), ("2mg", 0, "32494D47"), ("tar", 257, "7573746172"), ("raw", 90, "77"))


@R.add(f"SELECT p_partkey, {_expected(_BOXES)} AS container FROM part")
def sniffed_container(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sniff.container(_placed(_BOXES, 600), F.lit("/x/image.img")).alias("container"))


_FILES = "SELECT c_nationkey AS part, c_custkey AS path, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer"


@R.add(f"""WITH a AS (SELECT * FROM ({_FILES}) WHERE part != 3), b AS (SELECT part, path, CASE WHEN part % 4 = 1 AND path % 10 = 0 THEN size + 1 ELSE size END AS size FROM ({_FILES}) WHERE part % 4 != 2 OR path % 9 != 0),
d AS (SELECT coalesce(a.part, b.part) AS part, count(*) FILTER (a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size) AS n FROM a FULL JOIN b ON a.part = b.part AND a.path = b.path GROUP BY 1)
SELECT part, part != 3 AS comparable, part = 5 AS bootability_changed, CAST(CASE WHEN part != 3 THEN n ELSE 0 END AS BIGINT) AS files_changed, part != 3 AND part != 5 AND n = 0 AS is_unchanged FROM d""")
def partition_gate(spark, sf_dir):
    """Customers as files of their nation's partition: one side of nation 3 is a placeholder, nation 5 boots otherwise."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("part"), F.col("c_custkey").alias("path"), F.floor("c_acctbal").alias("size"))
    prior = rows.where("part != 3")
    new = rows.where("part % 4 != 2 OR path % 9 != 0").withColumn("size", F.col("size") + F.when((F.col("part") % 4 == 1) & (F.col("path") % 10 == 0), 1).otherwise(0))
    system = lambda rows, crc: rows.select("part", F.struct(crc.alias("crc")).alias("system")).distinct()
    # every file twice on one side: the last counts
    twice = prior.withColumn("size", F.col("size") - 5).withColumn("n", F.lit(0)).union(prior.withColumn("n", F.lit(1)))
    changed = system(new, F.when(F.col("part") == 5, 2).otherwise(1))
    return diff.partition_gate(twice, new.withColumn("n", F.lit(1)), system(prior, F.lit(1)), changed, ["part"], ["path"], ["size"], "n")


_TREE = "SELECT '/' || c_mktsegment || '/' || c_name AS path, 'file' AS kind, c_custkey AS size, 420 AS mode FROM customer UNION ALL SELECT DISTINCT '/' || c_mktsegment, 'directory', CAST(NULL AS BIGINT), 493 FROM customer"


def _tree(spark, sf_dir):
    customer, folder = read(spark, sf_dir, "customer"), F.concat(F.lit("/"), "c_mktsegment")
    files = customer.select(F.concat(folder, F.lit("/"), "c_name").alias("path"), F.lit("file").alias("kind"), F.col("c_custkey").alias("size"), F.lit(420).alias("mode"))
    return files.union(customer.select(folder, F.lit("directory"), F.lit(None).cast("long"), F.lit(493)).distinct())


def _log(*parts):
    """Edits from (rows, seq, op, columns): what is not given is null."""
    out = None
    for rows, seq, op, given in parts:
        value = lambda name, kind: (given[name] if name in given else F.lit(None)).cast(kind).alias(name)  # noqa: B023, E731
        one = rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.col("path"), value("kind", "string"), value("size", "long"), value("mode", "int"), value("new_path", "string"))
        out = one if out is None else out.union(one)
    return out


@R.add(f"""SELECT CASE WHEN kind = 'file' AND size % 5 = 0 THEN path || '.old' ELSE path END AS path, kind, CASE WHEN kind = 'file' AND size % 3 = 0 THEN size * 2 ELSE size END AS size,
CASE WHEN kind = 'file' AND size % 5 = 0 AND size % 2 = 0 THEN 256 WHEN kind = 'file' AND size % 4 = 0 THEN 511 ELSE mode END AS mode FROM ({_TREE}) WHERE NOT (kind = 'file' AND size % 35 = 0)
UNION ALL SELECT path, 'file', 1, 1 FROM ({_TREE}) WHERE kind = 'file' AND size % 5 = 0 AND size % 7 != 0 AND size % 11 = 0""")
def edit_sequence(spark, sf_dir):
    """Several edits of one path, in order: mode, then size, then a new name, then an edit by that name; some files end, and
    others are made anew where one was moved away."""
    tree = _tree(spark, sf_dir)
    files = tree.where("kind = 'file'")
    moved = files.where("size % 5 = 0")
    named = moved.withColumn("path", F.concat("path", F.lit(".old")))
    log = _log(
        (files.where("size % 4 = 0"), 1, "set", {"mode": F.lit(511)}), (files.where("size % 3 = 0"), 2, "set", {"size": F.col("size") * 2}),
        (moved, 3, "rename", {"new_path": F.concat("path", F.lit(".old"))}), (named.where("size % 2 = 0"), 4, "set", {"mode": F.lit(256)}),
        (moved.where("size % 3 = 0"), 5, "set", {"mode": F.lit(7)}), (named.where("size % 7 = 0"), 6, "delete", {}),
        (moved.where("size % 7 != 0 AND size % 11 = 0"), 7, "create", {"kind": F.lit("file"), "size": F.lit(1), "mode": F.lit(1)}),
    )
    return edits.apply_edits(tree, log)


@R.add(f"""SELECT CASE WHEN path LIKE '/BUILDING%' THEN '/keep/b' || substr(path, 10) WHEN path LIKE '/AUTOMOBILE%' THEN '/cars' || substr(path, 12) ELSE path END AS path, kind, size, CASE WHEN path = '/BUILDING' THEN 1 ELSE mode END AS mode
FROM ({_TREE}) WHERE path NOT LIKE '/FURNITURE%' AND path NOT LIKE '/MACHINERY%' UNION ALL SELECT '/keep', 'directory', NULL, 493 UNION ALL SELECT '/MACHINERY', 'directory', NULL, 2""")
def edit_subtree(spark, sf_dir):
    """Folders that move twice, folders that end with all that is made in them before, and one that is made again."""
    tree = _tree(spark, sf_dir)
    one = lambda path: spark.range(1).select(F.lit(path).alias("path"))
    folder, file = {"kind": F.lit("directory"), "mode": F.lit(493)}, {"kind": F.lit("file"), "size": F.lit(9), "mode": F.lit(9)}
    log = _log(
        (one("/keep"), 1, "create", folder), (one("/BUILDING"), 2, "rename", {"new_path": F.lit("/b")}), (one("/b"), 3, "rename", {"new_path": F.lit("/keep/b")}),
        (one("/keep/b"), 4, "set", {"mode": F.lit(1)}), (one("/AUTOMOBILE"), 5, "rename", {"new_path": F.lit("/cars")}), (one("/FURNITURE/new"), 6, "create", file),
        (one("/FURNITURE"), 7, "delete", {}), (one("/MACHINERY/new"), 8, "create", file), (one("/MACHINERY"), 9, "rename", {"new_path": F.lit("/m")}),
        (one("/m"), 10, "delete", {}), (one("/MACHINERY"), 11, "create", {"kind": F.lit("directory"), "mode": F.lit(2)}),
    )
    return edits.apply_edits(tree, log)


@R.add("""SELECT '/' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'TEXT' ELSE 'APPL' END AS type_code, CASE WHEN c_custkey % 6 = 0 THEN 'MSWD' ELSE 'ttxt' END AS creator_code, CASE WHEN c_custkey % 5 = 0 THEN '2024-01-02 03:04:05' END AS modified, CAST(NULL AS VARCHAR) AS target FROM customer
UNION ALL SELECT '/link' || c_custkey, NULL, NULL, NULL, '/' || c_custkey FROM customer WHERE c_custkey % 9 = 0""")
def edit_metadata(spark, sf_dir):
    """Types, creators, dates and links as edits of their own columns."""
    values = ("type_code", "creator_code", "modified", "target")
    null = F.lit(None).cast("string")
    files = read(spark, sf_dir, "customer").select(F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("APPL").alias("type_code"), F.lit("ttxt").alias("creator_code"), null.alias("modified"), null.alias("target"), "c_custkey")
    edit = lambda when, seq, op, path=F.col("path"), **given: files.where(when).select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), path.alias("path"), null.alias("new_path"), *(given.get(v, null).alias(v) for v in values))
    log = edit("c_custkey % 2 = 0", 1, "set", type_code=F.lit("TEXT")).union(edit("c_custkey % 6 = 0", 2, "set", creator_code=F.lit("MSWD"))).union(edit("c_custkey % 5 = 0", 3, "set", modified=F.lit("2024-01-02 03:04:05")))
    log = log.union(edit("c_custkey % 9 = 0", 4, "create", F.concat(F.lit("/link"), F.col("c_custkey").cast("string")), target=F.col("path")))
    return edits.apply_edits(files.select("path", *values), log, values)


@R.add(f"SELECT CAST(9 AS BIGINT) AS added, CAST((SELECT sum(size) FROM ({_TREE}) WHERE path LIKE '/BUILDING/%' OR (kind = 'file' AND size % 10 = 0)) AS BIGINT) AS freed")
def space_delta_of_folders(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    one = lambda path: spark.range(1).select(F.lit(path).alias("path"))
    log = _log((tree.where("kind = 'file' AND size % 10 = 0"), 1, "delete", {}), (one("/BUILDING"), 2, "delete", {}), (one("/n"), 3, "create", {"size": F.lit(9)}))
    return edits.space_delta(tree, log)


@R.add("""SELECT p_partkey, CASE WHEN n = 0 THEN base ELSE stem || '~' || n || ending END AS unique_name FROM (SELECT p_partkey, base, regexp_extract(base, '^(.*)([.][a-z]+)$', 1) AS stem, regexp_extract(base, '^(.*)([.][a-z]+)$', 2) AS ending, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) - 1 AS n
FROM (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) || '.txt' AS base FROM part))""")
def unique_file_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".txt")).alias("name"))
    return listing.unique_names(rows, "p_brand", "name", "p_partkey").select("p_partkey", "unique_name")


@R.add("SELECT source, count(*) AS parts, bool_and(ok) AS ok FROM (SELECT source, true AS ok FROM documents) GROUP BY source")
def verified_manifest(spark, sf_dir):
    """A document's digest as stored, and as computed from its chunk."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("bytes"), F.lit(0).alias("block_no"))
    found = backup.manifest(docs, ["source", "doc_id"])
    stored = docs.select("source", "doc_id", F.sha2("bytes", 256).alias("sha256"))
    return backup.verify(stored, found, ["source", "doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("parts"), F.bool_and(F.col("state") == "ok").alias("ok"))


_KINDS = ("Apple_HFS", "Apple_Driver43", "DOS\\3", "SFS\\2", "muFS", None, "DOS\\9", "Apple_ProDOS")
_BROWSED = "(SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 256 END AS INTEGER) AS b, CASE p_partkey % 8 {whens} END AS k, list_extract(['HFS', 'Big FAT disk', 'Volume', 'XFS', 'HFS+ (HFSX)'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS n FROM part)".format(
    whens=" ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k).replace(chr(92) * 2, chr(92))}" for i, k in enumerate(_KINDS))
)


@R.add(f"""SELECT p_partkey, b IN ({', '.join(map(str, selection.BROWSABLE_BYTES))}) OR coalesce(k IN ('Apple_HFS', 'DOS\\3', 'SFS\\2', 'muFS', 'Apple_ProDOS'), false) OR lower(n) LIKE '%fat%' OR (b = 0 AND n IN ('HFS', 'XFS')) AS browsable,
b = 175 OR coalesce(k IN ('Apple_HFS', 'DOS\\3'), false) AS checkable, (coalesce(k = 'Apple_HFS', false) OR b = 175 OR (b = 0 AND n = 'HFS')) AND n NOT LIKE '%HFS+%' AND n NOT LIKE '%HFSX%' AS classic FROM {_BROWSED}""")
def partition_predicates(spark, sf_dir):
    key = F.col("p_partkey")
    byte = F.when(key % 3 == 0, 0).otherwise(key % 256).cast("int")
    kind, name = F.get(F.array(*map(F.lit, _KINDS)), key % 8), F.get(F.array(*map(F.lit, ("HFS", "Big FAT disk", "Volume", "XFS", "HFS+ (HFSX)"))), key % 5)
    rows = read(spark, sf_dir, "part").select("p_partkey", byte.alias("b"), kind.alias("k"), name.alias("n"))
    b, k, n = F.col("b"), F.col("k"), F.col("n")
    return rows.select("p_partkey", selection.browsable(b, k, n).alias("browsable"), selection.checkable(b, k).alias("checkable"), selection.classic_hfs(b, k, n).alias("classic"))


@R.add("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hfs' WHEN 1 THEN 'hfsplus' ELSE 'unknown' END AS fs_type, CAST(CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN p_size * 512 + 7 * 4096 ELSE 0 END AS BIGINT) AS shift FROM part")
def apple_hfs_kind(spark, sf_dir):
    """Old volumes, new ones, and new ones within old ones, whose place the old header tells."""
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    old = lambda mark: F.concat(F.lit("00" * 1024 + "4244" + "00" * 18 + "00001000" + "00" * 4), number(F.col("p_size"), 4), F.lit("00" * 94 + mark + "0007" + "00" * 40))
    key = F.col("p_partkey")
    head = F.when(key % 3 == 0, old("0000")).when((key % 3 == 1) & (key % 2 == 0), old("482B")).when(key % 3 == 1, F.lit("00" * 1024 + "4858" + "00" * 200)).otherwise(F.lit("00" * 1300))
    return read(spark, sf_dir, "part").select("p_partkey", selection.apple_hfs(F.unhex(head)).alias("r")).select("p_partkey", "r.fs_type", F.col("r.offset").cast("long").alias("shift"))


@R.add("SELECT p_partkey, p_name AS name, p_size % 2 = 0 AS removable FROM part WHERE p_size % 2 = 0")
def removable_devices(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("size_bytes"), (F.col("p_size") % 2 == 0).alias("removable"), F.lit(False).alias("read_only"), F.lit(False).alias("system_disk"), F.col("p_brand").alias("bus_protocol"), F.col("p_type").alias("media_name"), F.array("p_brand").alias("mount_points"))
    return selection.removable(rows, True).select(F.col("path").cast("long").alias("p_partkey"), "name", "removable")


_ENDINGS = ("iso", "CUE", "bin", "chd", "xdf")


@R.add("SELECT p_partkey, p_partkey % 5 < 2 AS cd, p_partkey % 5 NOT IN (1, 2) AS dvd FROM part WHERE p_size % 4 > 0 AND (p_partkey % 5 < 2 OR p_partkey % 5 NOT IN (1, 2))")
def folder_scan(spark, sf_dir):
    """Files by number, of which every fourth is a dotfile, as two conversions take them."""
    name = F.concat(F.when(F.col("p_size") % 4 == 0, F.lit(".")).otherwise(F.lit("")), F.col("p_partkey").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, _ENDINGS)), F.col("p_partkey") % 5))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), name).alias("path"))
    cd, dvd = (selection.taken(rows, t).select("p_partkey", F.lit(True).alias(a)) for t, a in (("chd-cd", "cd"), ("chd-dvd", "dvd")))
    return cd.join(dvd, "p_partkey", "full").select("p_partkey", F.coalesce("cd", F.lit(False)).alias("cd"), F.coalesce("dvd", F.lit(False)).alias("dvd"))


@R.add("""SELECT count(*) FILTER (k = 0 AND NOT f) AS dirs, count(*) FILTER (k = 1 AND NOT f AND v) AS files, count(*) FILTER (k = 2 AND NOT f AND v) AS symlinks, count(*) FILTER (k = 2 AND NOT f AND v) AS symlinks_dropped,
count(*) FILTER (f) AS appledouble, count(*) FILTER (NOT f AND NOT v) AS invalid_names, count(*) FILTER (k = 3 AND NOT f AND v) AS other_unsupported
FROM (SELECT p_partkey % 4 AS k, p_size % 6 = 0 AS f, length(p_name) <= 20 AS v FROM part WHERE p_size % 10 != 9)""")
def import_preflight(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.when(size % 10 == 9, F.lit("../")).otherwise(F.lit("./d/")), F.when(size % 6 == 0, F.lit("._")).otherwise(F.lit("")), "p_name")
    rows = read(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, ("directory", "file", "symlink", "special"))), key % 4).alias("kind"), path.alias("path"), "p_name")
    return selection.preflight(rows, F.length("p_name") <= 20, symlinks=False)


@R.add("SELECT p_partkey, left(regexp_extract(p_name, '^[^n]*'), 8) || CASE WHEN regexp_extract(p_brand, '^[^#]*') = '' THEN '' ELSE '.' || left(regexp_extract(p_brand, '^[^#]*'), 3) END AS short FROM part WHERE left(p_name, 1) != 'n'")
def mangled_names(spark, sf_dir):
    name = F.concat("p_name", F.lit("."), "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", selection.fitted(name, 8, 3, "[n#]").alias("short")).where("short IS NOT NULL")


@R.add("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '/Volumes/' || n_name WHEN 1 THEN 'Disk:' || n_name WHEN 2 THEN NULL ELSE n_name END AS target FROM nation")
def alias_targets(spark, sf_dir):
    """Forks whose alias tells a path, a volume and a name, or a name alone; and a fork without an alias."""

    def each(batches):
        for batch in batches:
            forks = []
            for n, name in zip(batch["n_nationkey"], batch["n_name"], strict=True):
                record = resource.write_alias("" if n % 4 == 3 else "Disk", name, f"/Volumes/{name}" if n % 4 == 0 else None)
                forks.append(resource.write_fork({(b"TEXT", 128): name.encode(), (b"none" if n % 4 == 2 else b"alis", 0): record}))
            yield pd.DataFrame({"n_nationkey": batch["n_nationkey"], "fork": forks})

    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").mapInPandas(each, "n_nationkey long, fork binary")
    return rows.select("n_nationkey", resource.alias_target(F.col("fork")).alias("target"))


@R.add("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def host_times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", selection.modified_text(F.col("ts")).alias("text"))


@R.add("""SELECT p_partkey, concat_ws('-', CASE WHEN b >= 1000000000 THEN (b + 500000000) // 1000000000 || 'GB' ELSE (b + 500000) // 1000000 || 'MB' END, CASE WHEN p_partkey % 3 = 0 THEN 'my-disk' ELSE trim(regexp_replace(p_name, '[^A-Za-z0-9_]+', '-', 'g'), '-') END, '2024-05-06-0708') AS name
FROM (SELECT *, CAST(p_partkey * 7000003 AS BIGINT) AS b FROM part)""")
def backup_names(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 3 == 0, " my disk! ").when(F.col("p_partkey") % 3 == 1, "  ")
    at = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    return read(spark, sf_dir, "part").select("p_partkey", backup.backup_name(F.col("p_partkey").cast("long") * 7_000_003, label, F.col("p_name"), at).alias("name"))


_LAID = "(SELECT n_regionkey, n_nationkey, n_nationkey % 2 = 1 AS logical, CAST((n_nationkey + 1) * 700 * 512 AS BIGINT) AS size, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_nationkey) AS k FROM nation)"


@R.add(f"""WITH RECURSIVE t AS {_LAID},
p AS (SELECT n_regionkey, n_nationkey, logical, k, size, CAST(CASE WHEN logical THEN 4096 ELSE 2048 END AS BIGINT) AS pos FROM t WHERE k = 1
  UNION ALL SELECT t.n_regionkey, t.n_nationkey, t.logical, t.k, t.size, CAST(CASE WHEN t.logical AND NOT p.logical THEN ((p.pos + p.size // 512 + 2047) // 2048 * 2048 + 1 + 2047) // 2048 * 2048 WHEN t.logical THEN (p.pos + p.size // 512 + 1 + 2047) // 2048 * 2048 ELSE (p.pos + p.size // 512 + 2047) // 2048 * 2048 END AS BIGINT)
  FROM t JOIN p ON t.n_regionkey = p.n_regionkey AND t.k = p.k + 1)
SELECT CAST(n_regionkey AS VARCHAR) AS image_id, CAST(n_nationkey AS INTEGER) AS part_index, pos AS new_lba, size FROM p""")
def restore_layout_logicals(spark, sf_dir):
    """Odd nations are logical partitions: behind all others, by their starts, each with a sector of its own before it."""
    key = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("image_id"), key.cast("int").alias("part_index"), (key * 9 + 63).cast("long").alias("start_lba"), (key % 2 == 1).alias("is_logical"), ((key + 1) * 700 * 512).cast("long").alias("size"))
    return layout.restore_layout(rows)


_WORDS = "list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT))"


@R.add(f"SELECT p_partkey, (4294967296 - list_sum({_WORDS}) % 4294967296) % 4294967296 AS checksum FROM (SELECT p_partkey, substr(md5(p_name), 1, 8) || '00000000' || substr(md5(p_name), 17, 16) AS h FROM part)")
def word_checksums(spark, sf_dir):
    """Of blocks whose second word holds the checksum, and does not count."""

    def each(batches):
        for batch in batches:
            yield pd.DataFrame({"p_partkey": batch["p_partkey"], "checksum": [digests.word_checksum(bytes(b), 1) for b in batch["block"]]})

    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.unhex(F.md5("p_name")).alias("block"))
    return rows.mapInPandas(each, "p_partkey long, checksum long")


_CRC16 = "list_reduce(list_prepend(CAST(0 AS BIGINT), {b}), lambda c, b: list_reduce(list_prepend(xor(c, b << 8), list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT))), lambda x, i: CASE WHEN x & 32768 != 0 THEN xor(x << 1, 4129) & 65535 ELSE (x << 1) & 65535 END))"


@R.add(f"SELECT c_custkey, {_CRC16.format(b=_BYTES.format(t='c_name'))} AS crc FROM customer")
def crc16(spark, sf_dir):
    def each(batches):
        for batch in batches:
            yield pd.DataFrame({"c_custkey": batch["c_custkey"], "crc": [digests.crc16(n.encode()) for n in batch["c_name"]]})

    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name").mapInPandas(each, "c_custkey long, crc long")


@R.add("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'exfat' WHEN 2 THEN 'xfs' ELSE 'ext' END AS fs FROM part")
def resolved_types(spark, sf_dir):
    """Volumes behind type bytes 07 and 83, told by their bytes."""
    cases = (("ntfs", 3, "4E54465320202020"), ("exfat", 3, "4558464154202020"), ("xfs", 0, "58465342"), ("ext", 1080, "53EF"))
    byte = F.when(F.col("p_partkey") % 4 < 2, 0x07).otherwise(0x83)
    return read(spark, sf_dir, "part").select("p_partkey", selection.resolved(byte, sniff.filesystem(_placed(cases, 1600))).alias("fs"))


@R.add("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 252 END AS type, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2049 END AS aux FROM part")
def type_dictionary(spark, sf_dir):
    name = F.concat("p_name", F.get(F.array(*map(F.lit, (".TXT", ".bas", ".none"))), F.col("p_partkey") % 3))
    entries = F.array(*(F.struct(F.lit(e).alias("ending"), F.lit(t).alias("type"), F.lit(a).alias("aux")) for e, t, a in (("txt", 4, 0), (".BAS", 252, 2049))))
    return selection.typed(read(spark, sf_dir, "part").select("p_partkey", name.alias("name")), spark.range(1).select(F.inline(entries))).select("p_partkey", "type", "aux")


QUERIES, ORACLE_SQL = R.queries, R.sql
