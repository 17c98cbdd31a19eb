"""Joins, differences, integrity checks, aggregations and layouts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platterlake.functions import bits, dates, digests, sizes
from platterlake.operators import carve, checks, compaction, diff, edits, layout, rates
from platterlake.plans.common import Registry, read

R = Registry()

for _kind in ("sha256", "md5", "sha1"):

    def _digest(spark, sf_dir, kind=_kind):
        return read(spark, sf_dir, "documents").select("doc_id", digests.one(F.col("text"), kind).alias("digest"))

    _digest.__name__ = f"digest_{_kind}"
    R.add(f"SELECT doc_id, {_kind}(text) AS digest FROM documents")(_digest)


@R.add("SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size, sha256(string_agg(text, '' ORDER BY doc_id)) AS sha256, md5(string_agg(text, '' ORDER BY doc_id)) AS md5 FROM documents GROUP BY source")
def chunked_digests(spark, sf_dir):
    """A source's documents as the chunks of one stream."""
    chunks = read(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("bytes"))
    return digests.of_chunks(chunks, ["source"], "doc_id").select("source", "size", "sha256", "md5")


@R.add("SELECT doc_id, sha256(text) || '  ' || source || '-' || doc_id AS line FROM documents")
def checksum_sidecar(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", digests.sidecar(F.sha2("text", 256), F.concat_ws("-", "source", "doc_id")).alias("line"))


@R.add("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'damaged' WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'ok' END AS state FROM documents")
def verify_backup(spark, sf_dir):
    from platterlake.operators import backup

    docs = read(spark, sf_dir, "documents")
    want = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    got = docs.where("doc_id % 7 != 0 OR doc_id % 9 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return backup.verify(want, got, ["doc_id"])


@R.add("SELECT CAST(sum(ceil(n_chars / 512.0)) AS BIGINT) AS chunks FROM documents")
def chunk_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.sum(sizes.units(F.col("n_chars"), 512)).alias("chunks"))


@R.add("SELECT source, CAST(sum(ceil(octet_length(encode(text)) / 512.0) * 512) AS BIGINT) AS bytes FROM documents GROUP BY source")
def allocated_bytes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(sizes.align_up(F.octet_length("text").cast("long"), 512)).alias("bytes"))


@R.add("SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def distinct_content(spark, sf_dir):
    return digests.distinct_contents(read(spark, sf_dir, "documents"), F.col("text"))


_DIFF = """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.n IS NOT DISTINCT FROM b.n THEN 'unchanged' ELSE 'modified' END AS state
FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 5 != 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 7 != 0) b ON a.doc_id = b.doc_id"""


def _manifests(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"), "source")
    return docs.where("doc_id % 5 != 0"), docs.where("doc_id % 7 != 0").withColumn("n", F.col("n") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0))


@R.add(_DIFF)
def manifest_diff(spark, sf_dir):
    prior, new = _manifests(spark, sf_dir)
    return diff.compare(prior, new, ["doc_id"], ["n"])


@R.add(f"SELECT doc_id % 4 AS part, count(*) FILTER (state != 'unchanged') AS files_changed, count(*) FILTER (state != 'unchanged') = 0 AS is_unchanged FROM ({_DIFF}) GROUP BY 1")
def incremental_gate(spark, sf_dir):
    prior, new = _manifests(spark, sf_dir)
    return diff.gate(diff.compare(prior, new, ["doc_id"], ["n"]).withColumn("part", F.col("doc_id") % 4), ["part"])


@R.add("SELECT l_orderkey, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def last_write_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return diff.last_of(rows, ["l_orderkey"], "seq").select("l_orderkey", "l_quantity", "l_shipdate")


_OVERLAY = """WITH j AS (SELECT event_id AS seq, user_id AS block, event_type AS bytes, event_id % 997 != 996 AS good FROM events),
w AS (SELECT block, bytes, row_number() OVER (PARTITION BY block ORDER BY seq DESC) AS n FROM j WHERE seq < coalesce((SELECT min(seq) FROM j WHERE NOT good), 1 << 60))
SELECT coalesce(b.block, w.block) AS block, coalesce(w.bytes, b.bytes) AS bytes FROM (SELECT c_custkey AS block, c_mktsegment AS bytes FROM customer) b FULL JOIN (SELECT * FROM w WHERE n = 1) w ON b.block = w.block"""


@R.add(_OVERLAY)
def journal_replay(spark, sf_dir):
    blocks = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("block"), F.col("c_mktsegment").alias("bytes"))
    journal = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("block"), F.col("event_type").alias("bytes"), (F.col("event_id") % 997 != 996).alias("good"))
    return diff.overlay(blocks, journal)


@R.add("SELECT c_custkey, c_name || '.new' AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 1")
def conflict_force(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    source = rows.where("c_custkey % 3 = 0").withColumn("name", F.concat("name", F.lit(".new")))
    return diff.resolve_conflicts(source, rows.where("c_custkey % 3 != 2"), ["c_custkey"], "force")


@R.add("SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 3 != 2")
def conflict_skip(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return diff.resolve_conflicts(rows.where("c_custkey % 3 = 0"), rows.where("c_custkey % 3 != 2"), ["c_custkey"], "skip")


@R.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def name_collision(spark, sf_dir):
    return diff.collisions(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@R.add("SELECT n_name, CASE WHEN r_regionkey IS NULL THEN 'original' ELSE r_name END AS choice FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def size_choice_lookup(spark, sf_dir):
    chosen = read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("choice"))
    return layout.size_choices(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"), chosen, "n_regionkey").select("n_name", "choice")


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return checks.orphans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@R.add("SELECT c_custkey, count(o_orderkey) AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) != 10")
def valence(spark, sf_dir):
    parents = read(spark, sf_dir, "customer").withColumn("stored", F.lit(10))
    return checks.counts_differ(parents, "c_custkey", "stored", read(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "found")


@R.add("""SELECT event_id, previous FROM (SELECT event_id, event_id % 97 AS k, lag(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous >= k""")
def key_order(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("place", F.struct("ts", "event_id")).withColumn("k", F.col("event_id") % 97)
    return checks.out_of_order(rows, ["user_id"], "place", "k").select("event_id", "previous")


@R.add("""SELECT event_id FROM (SELECT event_id, ts, max(ts + INTERVAL 10 MINUTE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE ts < before""")
def extent_overlap(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("stop", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    return checks.overlaps(rows, ["user_id"], "ts", "stop", "event_id").select("event_id")


@R.add("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'referenced_but_free' ELSE 'marked_but_unreferenced' END AS problem
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 20) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def bitmap_check(spark, sf_dir):
    computed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return checks.bitmap_differences(computed, read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k")), ["k"])


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("""SELECT * FROM (SELECT CAST(c_nationkey AS VARCHAR) AS image_id, c_custkey, 'segment' AS field, p AS expected, c_mktsegment AS found FROM customer JOIN (SELECT c_nationkey, min_by(c_mktsegment, c_custkey) AS p FROM customer GROUP BY 1) USING (c_nationkey)) WHERE expected IS DISTINCT FROM found""")
def replica_compare(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("image_id"), "c_custkey", F.col("c_mktsegment").alias("segment"))
    primary = rows.groupBy("image_id").agg(F.min_by("segment", "c_custkey").alias("segment"))
    return checks.replica_differences(rows, primary, "c_custkey", ["segment"])


_ISSUES = """SELECT CAST(c_nationkey AS VARCHAR) AS image_id, 'error' AS severity, 'MissingParent' AS code, 'entry ' || c_custkey AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'warning', 'NegativeBalance', 'entry ' || c_custkey FROM customer WHERE c_acctbal < 0"""


def _issues(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").withColumn("image_id", F.col("c_nationkey"))
    text = F.concat(F.lit("entry "), F.col("c_custkey").cast("string"))
    lost = checks.issue(checks.orphans(customer, read(spark, sf_dir, "orders"), "c_custkey", "o_custkey"), "MissingParent", text)
    return customer, checks.report([lost, checks.issue(customer.where("c_acctbal < 0"), "NegativeBalance", text, "warning")])


@R.add(_ISSUES)
def fsck_issues(spark, sf_dir):
    return _issues(spark, sf_dir)[1]


@R.add(f"SELECT image_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS is_clean FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS image_id FROM customer) LEFT JOIN ({_ISSUES}) USING (image_id) GROUP BY image_id")
def fsck_verdict(spark, sf_dir):
    return checks.verdict(*_issues(spark, sf_dir))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"


@R.add(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS running FROM lineitem")
def prefix_sum(spark, sf_dir):
    rows = layout.running(read(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER.split(", "), "l_quantity", "running")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "running")


@R.add("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def islands(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("place", F.struct("ts", "event_id"))
    return carve.islands(rows, ["user_id"], "place", "event_type").select("user_id", "run", "event_type", "n")


@R.add("""SELECT min(o_orderkey) AS start, count(*) AS length FROM (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM orders WHERE o_orderstatus = 'F') GROUP BY g HAVING count(*) >= 2""")
def block_runs(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.lit(0).alias("image_id"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("used"))
    return carve.block_runs(rows, ["image_id"], "o_orderkey", "used", 2).select("start", "length")


@R.add("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS new_block FROM orders WHERE o_orderstatus != 'P'")
def block_renumbering(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("used", F.col("o_orderstatus") != "P")
    return compaction.renumber(rows, ["o_custkey"], "o_orderkey")


@R.add("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def live_blocks(spark, sf_dir):
    allocation = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("used"))
    return compaction.live(read(spark, sf_dir, "lineitem"), allocation, ["l_orderkey"]).select("l_orderkey", "l_quantity", "l_extendedprice")


@R.add("SELECT n_nationkey AS image_id, CAST(b AS BIGINT) AS block_no, s_name AS data FROM (SELECT n_nationkey, unnest(range(0, 50)) AS b FROM nation) LEFT JOIN (SELECT s_nationkey, s_suppkey % 50 AS k, min(s_name) AS s_name FROM supplier GROUP BY 1, 2) ON s_nationkey = n_nationkey AND k = b")
def expand_blocks(spark, sf_dir):
    totals = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), F.lit(50).cast("long").alias("blocks"))
    used = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("image_id"), (F.col("s_suppkey") % 50).alias("block_no")).agg(F.min("s_name").alias("data"))
    return compaction.expand(totals, used)


@R.add("SELECT c_nationkey, count(*) FILTER (n > 0) AS files, count(*) FILTER (n > 1) AS fragmented, CAST(100.0 * count(*) FILTER (n > 1) / nullif(count(*) FILTER (n > 0), 0) AS FLOAT) AS percent FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def fragmentation(spark, sf_dir):
    extents = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return compaction.fragmentation(extents.withColumn("block_count", F.when(F.col("o_orderkey").isNotNull(), 1).otherwise(0)), ["c_nationkey"], "c_custkey")


@R.add("SELECT s_nationkey, count(*) FILTER (u) AS used_blocks, max(CASE WHEN u THEN s_suppkey END) AS highest_used, min(CASE WHEN NOT u THEN s_suppkey END) AS lowest_free FROM (SELECT *, s_acctbal > 0 AS u FROM supplier) GROUP BY 1")
def bitmap_summary(spark, sf_dir):
    return bits.summarise(read(spark, sf_dir, "supplier").withColumn("used", F.col("s_acctbal") > 0), ["s_nationkey"], "s_suppkey")


@R.add("SELECT p_partkey, bit_count(p_partkey) AS n, CASE WHEN p_partkey > 0 THEN CAST(floor(log2(p_partkey)) AS INTEGER) END AS highest FROM part")
def popcount(spark, sf_dir):
    raw = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright("p_partkey", s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24))))
    rows = read(spark, sf_dir, "part").select("p_partkey", raw.alias("bitmap"))
    return rows.select("p_partkey", bits.count_set(F.col("bitmap"), F.lit(32)).alias("n"), bits.highest_set(F.col("bitmap"), F.lit(32)).alias("highest"))


@R.add("SELECT o_orderkey, CASE WHEN m >= 200000 THEN 200000 ELSE least((least(m + m // 5, 200000) + 511) // 512 * 512, 200000) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS m FROM orders)")
def min_plus_20(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.min_plus_20(F.floor("o_totalprice"), F.lit(200000)).cast("long").alias("size"))


@R.add("SELECT o_orderkey, CASE WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 13) AS b FROM orders)")
def size_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.format_size((F.floor("o_totalprice") * (F.col("o_orderkey") % 13)).cast("long")).alias("size"))


@R.add("SELECT o_orderkey, CASE WHEN b >= 1000000000 THEN (b + 500000000) // 1000000000 || 'GB' ELSE (b + 500000) // 1000000 || 'MB' END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 9973 AS b FROM orders)")
def size_text_short(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sizes.format_size_short((F.floor("o_totalprice") * 9973).cast("long")).alias("size"))


@R.add("SELECT p_partkey, CASE WHEN t IN ('', 'B') THEN n WHEN t IN ('K', 'KIB') THEN n * 1024 WHEN t IN ('M', 'MIB') THEN n * 1048576 WHEN t IN ('G', 'GIB') THEN n * 1073741824 END AS bytes FROM (SELECT p_partkey, p_partkey AS n, list_extract(['', 'B', 'K', 'KIB', 'M', 'MIB', 'G', 'GIB', 'T'], p_size % 9 + 1) AS t FROM part)")
def parse_size(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("", "b", "K", "kib", " M", "MiB", "g", "GiB", "T"))), F.col("p_size") % 9)
    return read(spark, sf_dir, "part").select("p_partkey", sizes.parse_size_column(F.concat(F.col("p_partkey").cast("string"), unit)).cast("long").alias("bytes"))


@R.add("SELECT o_orderkey, CAST(CASE WHEN l // 1008 > 1023 THEN 1023 ELSE l // 1008 END AS BIGINT) AS c, CAST(CASE WHEN l // 1008 > 1023 THEN 15 ELSE l // 63 % 16 END AS BIGINT) AS h, CAST(CASE WHEN l // 1008 > 1023 THEN 63 ELSE l % 63 + 1 END AS BIGINT) AS s FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 7) AS BIGINT) AS l FROM orders)")
def lba_to_chs(spark, sf_dir):
    chs = sizes.lba_to_chs(F.floor(F.col("o_totalprice") * 7), F.lit(16), F.lit(63))
    return read(spark, sf_dir, "orders").select("o_orderkey", chs.alias("a")).select("o_orderkey", F.col("a.cylinder").alias("c"), F.col("a.head").alias("h"), F.col("a.sector").alias("s"))


@R.add("SELECT event_id, epoch_us(ts) // 1000000 + 2082844800 AS mac, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def mac_epoch(spark, sf_dir):
    mac = dates.unix_to_mac(F.unix_seconds(F.col("ts").cast("timestamp")))
    return read(spark, sf_dir, "events").select("event_id", mac.alias("mac"), dates.mac_text(mac).alias("text"))


@R.add("SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE (p_partkey + 2922) * 86400 + p_size * 60 + p_size * 7 // 50 END AS unix FROM part")
def amiga_dates(spark, sf_dir):
    some = lambda c: F.when(F.col("p_size") == 1, 0).otherwise(c)
    return read(spark, sf_dir, "part").select("p_partkey", dates.amiga_to_unix(some(F.col("p_partkey")), some(F.col("p_size")), some(F.col("p_size") * 7)).alias("unix"))


_RUNS = """WITH f AS (SELECT event_id, user_id, ts, event_type, CASE WHEN lag(event_type) OVER w = event_type AND lag(event_id) OVER w <= event_id THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
m AS (SELECT *, epoch_us(ts) AS t, count(*) OVER s AS n, min(epoch_us(ts)) OVER s AS t0, min(event_id) OVER s AS c0 FROM r WINDOW s AS (PARTITION BY user_id, run ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n >= 2 AND t - t0 >= 250000 THEN (event_id - c0) / ((t - t0) / 1000000.0::DOUBLE) END AS rate FROM m"""


@R.add(_RUNS)
def rolling_rate(spark, sf_dir):
    return rates.rolling_rate(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", seconds=3600).select("event_id", "rate")


@R.add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_window(spark, sf_dir):
    """Extension: a window by time."""
    return read(spark, sf_dir, "events").selectExpr("event_id", "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n")


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    """Extension: windows over events."""
    found = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM r GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    """Extension: sessions of events."""
    found = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@R.add("SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup(spark, sf_dir):
    """Extension: grouping sets."""
    return read(spark, sf_dir, "nation").rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


_PARTS = "SELECT o_custkey AS image_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS part_index, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey FROM orders"
_TABLE = f"SELECT image_id, part_index, size_bytes, coalesce(sum(size_bytes) OVER (PARTITION BY image_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1048576 AS start_byte, CASE WHEN o_orderkey % 3 = 0 THEN size_bytes + 4096 END AS new_size FROM ({_PARTS})"


def _partitions(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image_id", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS part_index", "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes", "o_orderkey")
    return rows.selectExpr("image_id", "part_index", "size_bytes", "o_orderkey", "coalesce(sum(size_bytes) OVER (PARTITION BY image_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1048576 AS start_byte", "CASE WHEN o_orderkey % 3 = 0 THEN size_bytes + 4096 END AS new_size", "3000000L AS disk_size")


@R.add(f"SELECT image_id, part_index, CAST(start_byte AS BIGINT) AS old_start, CAST(start_byte + d AS BIGINT) AS new_start, n AS new_size, CAST(d AS BIGINT) AS move_delta, start_byte + d + n <= 3000000 AS fits FROM (SELECT *, coalesce(new_size, size_bytes) AS n, coalesce(sum(coalesce(new_size, size_bytes) - size_bytes) OVER (PARTITION BY image_id ORDER BY start_byte, part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ({_TABLE}))")
def resize_plan(spark, sf_dir):
    return layout.resize_plan(_partitions(spark, sf_dir))


@R.add(f"""WITH RECURSIVE t AS ({_TABLE}),
p AS (SELECT image_id, part_index, start_byte, coalesce(new_size, size_bytes) AS n, size_bytes, CAST(0 AS BIGINT) AS shift, CAST((start_byte + 1048575) // 1048576 * 1048576 AS BIGINT) AS pos FROM t WHERE part_index = 1
  UNION ALL
  SELECT t.image_id, t.part_index, t.start_byte, coalesce(t.new_size, t.size_bytes), t.size_bytes, CAST(p.shift + p.n - p.size_bytes + p.pos - (p.start_byte + p.shift) AS BIGINT),
         CAST((t.start_byte + p.shift + p.n - p.size_bytes + p.pos - (p.start_byte + p.shift) + 1048575) // 1048576 * 1048576 AS BIGINT)
  FROM t JOIN p ON t.image_id = p.image_id AND t.part_index = p.part_index + 1)
SELECT image_id, part_index, CAST(start_byte AS BIGINT) AS old_start, pos AS new_start, n AS new_size, CAST(pos - start_byte AS BIGINT) AS move_delta, pos + n <= 3000000 AS fits FROM p""")
def resize_plan_aligned(spark, sf_dir):
    return layout.resize_plan(_partitions(spark, sf_dir), 2048)


@R.add(f"""WITH RECURSIVE t AS (SELECT image_id, part_index, size_bytes AS size FROM ({_PARTS})),
p AS (SELECT image_id, part_index, size, CAST(2048 AS BIGINT) AS pos FROM t WHERE part_index = 1
  UNION ALL SELECT t.image_id, t.part_index, t.size, CAST((p.pos + p.size // 512 + 2047) // 2048 * 2048 AS BIGINT) FROM t JOIN p ON t.image_id = p.image_id AND t.part_index = p.part_index + 1)
SELECT image_id, part_index, pos AS new_lba, size FROM p""")
def restore_layout(spark, sf_dir):
    rows = _partitions(spark, sf_dir).select("image_id", "part_index", (F.col("start_byte") / 512).cast("long").alias("start_lba"), F.lit(False).alias("is_logical"), F.col("size_bytes").alias("size"))
    return layout.restore_layout(rows)


@R.add("SELECT CAST(o_custkey AS VARCHAR) AS image_id, min(o_orderkey) AS first_lba, CASE WHEN min(o_orderkey) = 63 THEN 'dos' WHEN bool_and(o_orderkey % 2048 = 0) THEN 'modern' WHEN count(*) >= 2 AND list_reduce(list(o_orderkey), lambda a, b: gcd(a, b)) > 1 THEN 'custom' ELSE 'none' END AS kind, CAST(CASE WHEN min(o_orderkey) = 63 THEN 16065 WHEN bool_and(o_orderkey % 2048 = 0) THEN 2048 WHEN count(*) >= 2 AND list_reduce(list(o_orderkey), lambda a, b: gcd(a, b)) > 1 THEN list_reduce(list(o_orderkey), lambda a, b: gcd(a, b)) ELSE 1 END AS BIGINT) AS sectors FROM orders GROUP BY o_custkey")
def alignment(spark, sf_dir):
    return layout.detect_alignment(read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("image_id"), F.col("o_orderkey").alias("start_lba")))


@R.add(f"SELECT image_id, part_index, CASE WHEN (a + s // 512) * 512 > 3000000 THEN 'beyond the disk' ELSE 'overlaps' END AS problem FROM (SELECT *, max(a + s // 512) OVER (PARTITION BY image_id ORDER BY a, part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT image_id, part_index, CAST(start_byte // 512 AS BIGINT) AS a, coalesce(new_size, size_bytes) AS s FROM ({_TABLE}))) WHERE (a + s // 512) * 512 > 3000000 OR a < b")
def edit_validation(spark, sf_dir):
    rows = _partitions(spark, sf_dir).select("image_id", "part_index", F.floor(F.col("start_byte") / 512).alias("start_lba"), F.coalesce("new_size", "size_bytes").alias("size_bytes"), F.lit(False).alias("is_extended"))
    return layout.validate(rows, F.lit(3000000))


@R.add(f"WITH t AS (SELECT image_id, CAST(start_byte AS BIGINT) AS a, size_bytes AS n, part_index FROM ({_TABLE}) WHERE part_index % 2 = 1), w AS (SELECT *, lead(a) OVER (PARTITION BY image_id ORDER BY a) AS b, row_number() OVER (PARTITION BY image_id ORDER BY a) AS k FROM t) SELECT image_id, a AS \"offset\", n AS length, CAST(part_index AS VARCHAR) AS source FROM t UNION ALL SELECT image_id, a + n, coalesce(b, 9000000) - a - n, NULL FROM w WHERE coalesce(b, 9000000) > a + n UNION ALL SELECT image_id, 0, a, NULL FROM w WHERE k = 1 AND a > 0")
def segment_gaps(spark, sf_dir):
    rows = _partitions(spark, sf_dir).where("part_index % 2 = 1").select("image_id", F.col("start_byte").alias("offset"), F.col("size_bytes").alias("length"), F.col("part_index").cast("string").alias("source"))
    return layout.with_gaps(rows, F.lit(9000000))


@R.add("""WITH e AS (SELECT '/' || c_mktsegment AS path, 'directory' AS kind, CAST(NULL AS BIGINT) AS size, 0 AS mode FROM customer GROUP BY c_mktsegment UNION ALL SELECT '/' || c_mktsegment || '/' || c_name, 'file', c_custkey, 420 FROM customer)
SELECT path, kind, size, CASE WHEN kind = 'file' AND size % 10 = 0 THEN 511 ELSE mode END AS mode FROM e WHERE path NOT LIKE '/MACHINERY%' AND NOT (kind = 'file' AND size % 7 = 0) UNION ALL SELECT '/new', 'file', 5, 420""")
def staged_edits(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    folder = F.concat(F.lit("/"), "c_mktsegment")
    null = F.lit(None)
    dirs = customer.select(folder.alias("path"), F.lit("directory").alias("kind"), null.cast("long").alias("size"), F.lit(0).alias("mode")).distinct()
    entries = dirs.union(customer.select(F.concat(folder, F.lit("/"), "c_name"), F.lit("file"), F.col("c_custkey"), F.lit(420)))
    edit = lambda rows, seq, op, mode: rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "path", F.lit("file").alias("kind"), null.cast("long").alias("size"), mode.cast("int").alias("mode"), null.cast("string").alias("new_path"))
    files = entries.where("kind = 'file'")
    log = edit(files.where("size % 10 = 0"), 1, "set", F.lit(511)).union(edit(files.where("size % 7 = 0"), 2, "delete", null)).union(edit(entries.where("path = '/MACHINERY'"), 3, "delete", null))
    log = log.union(spark.range(1).select(F.lit(4), F.lit("create"), F.lit("/new"), F.lit("file"), F.lit(5).cast("long"), F.lit(420), null.cast("string")))
    return edits.apply_edits(entries, log)


@R.add("SELECT CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN o_orderkey % 2 = 1 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS freed FROM orders")
def space_delta(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("size"))
    log = orders.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "create").otherwise("delete").alias("op"), F.col("o_custkey").alias("size"))
    return edits.space_delta(entries, log)


QUERIES, ORACLE_SQL = R.queries, R.sql
