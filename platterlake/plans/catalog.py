"""Listings over the driver's tables: pages as files, nations as folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.functions import names
from platterlake.operators import carve, copying, glob, listing
from platterlake.plans.common import Registry, read

R = Registry()


def files(spark, sf_dir) -> DataFrame:
    """Pages as catalog rows: path is the URL's path, source its host."""
    pages = read(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    return pages.select("page_id", "url", path.alias("path"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.octet_length("html").cast("long").alias("size"))


FILES = "(SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS path, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)"


@R.add(f"SELECT page_id, path FROM {FILES} WHERE regexp_matches(path, '^/en/[^/]*$')")
def ls_folders_first(spark, sf_dir):
    """The flagship: files under a glob, in the order of a listing."""
    found = glob.select(files(spark, sf_dir), "/en/*", ignore_case=False).select("page_id", "path")
    return listing.sort_listing(found, F.lower("path"), F.endswith("path", F.lit("/")), F.col("page_id"))


@R.add(f"SELECT page_id, regexp_full_match(lower(path), '/[^/]n/.*') AS hit FROM {FILES}")
def glob_filter(spark, sf_dir):
    return files(spark, sf_dir).select("page_id", glob.matches(F.col("path"), "/?N/**").alias("hit"))


@R.add(f"SELECT page_id, path FROM {FILES} WHERE regexp_matches(lower(path), '/(en|fr)/[^/]*$') AND NOT regexp_matches(lower(path), '[.]html$')")
def include_exclude(spark, sf_dir):
    return glob.select(files(spark, sf_dir), "{EN,fr}/*", ["*.html"]).select("page_id", "path")


@R.add(f"SELECT page_id, path FROM {FILES} WHERE regexp_matches(path, '^/de/') AND regexp_matches(path, '^/de/(.*/)?[0-9][^/][^/]?$')")
def glob_anchored(spark, sf_dir):
    return glob.select(files(spark, sf_dir), "/de/**/[0-9]?{,?}", ignore_case=False).select("page_id", "path")


@R.add(f"SELECT page_id, size FROM {FILES} WHERE rtrim(path, '/') IN ('/en/853', '/en/960', '/de/1', '/es/17')")
def path_lookup(spark, sf_dir):
    return glob.lookup(files(spark, sf_dir), ["/en/853/", "en//960", "/de/1", "/es/17/"]).select("page_id", "size")


@R.add("SELECT n_nationkey, n_name, n_regionkey = 0 AS is_dir FROM nation ORDER BY is_dir DESC, lower(n_name)")
def folders_first(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") == 0).alias("is_dir"))
    return listing.sort_listing(rows, F.lower("n_name"), F.col("is_dir"), F.col("n_nationkey"))


@R.add("SELECT n_nationkey, n_name FROM nation WHERE n_name BETWEEN (SELECT min(n_name) FROM nation WHERE n_nationkey IN (3, 9)) AND (SELECT max(n_name) FROM nation WHERE n_nationkey IN (3, 9))")
def range_selection(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return listing.select_range(rows, [F.col("n_name")], F.col("n_nationkey") == 3, F.col("n_nationkey") == 9)


@R.add(f"SELECT host, count(*) FILTER (path LIKE '%/') AS directories, count(*) FILTER (path NOT LIKE '%/') AS files FROM {FILES} GROUP BY host")
def tree_counts(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("kind", F.when(F.endswith("path", F.lit("/")), "directory").otherwise("file"))
    return listing.tree_counts(rows, ["host"])


@R.add("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 3 END AS parent FROM nation),
t AS (SELECT node, node AS root, 0 AS depth, [node] AS path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.node, t.root, t.depth + 1, list_append(t.path, e.node) FROM e JOIN t ON e.parent = t.node)
SELECT node, root, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path FROM t""")
def tree_closure(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.expr("CASE WHEN n_nationkey > 0 THEN CAST(floor((n_nationkey - 1) / 3) AS BIGINT) END").alias("parent"))
    found = listing.closure(rows, "node", "parent")
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@R.add(f"SELECT page_id, upper(regexp_extract(path, '[.]([^.]*)$', 1)) AS tag FROM {FILES}")
def extension_tag(spark, sf_dir):
    return files(spark, sf_dir).select("page_id", names.extension(F.col("path")).alias("tag"))


@R.add("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '<DIR>' WHEN 1 THEN '->' WHEN 2 THEN lpad(printf('%o', p_partkey % 4096), 4, '0') ELSE upper(regexp_extract(p_name, '[.]([^.]*)$', 1)) END AS tag FROM part""")
def type_tag(spark, sf_dir):
    none = F.lit(None)
    kind = F.when(F.col("p_size") % 4 == 0, "directory").when(F.col("p_size") % 4 == 1, "symlink").otherwise("file")
    mode = F.when(F.col("p_size") % 4 == 2, F.col("p_partkey") % 4096)
    return read(spark, sf_dir, "part").select("p_partkey", names.type_tag(kind, F.col("p_name"), none.cast("string"), none.cast("string"), none.cast("int"), mode).alias("tag"))


@R.add("SELECT p_partkey, lpad(printf('%o', p_partkey * 37 & 4095), 4, '0') AS octal FROM part")
def octal_mode(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.octal_mode(F.col("p_partkey").cast("long") * 37).alias("octal"))


_BIT = "CASE WHEN m & {b} != 0 THEN '{c}' ELSE '-' END"
_MODE = " || ".join(
    part
    for shift, special, letter in ((6, 2048, "s"), (3, 1024, "s"), (0, 512, "t"))
    for part in (
        _BIT.format(b=4 << shift, c="r"), _BIT.format(b=2 << shift, c="w"),
        f"CASE WHEN m & {1 << shift} != 0 AND m & {special} != 0 THEN '{letter}' WHEN m & {1 << shift} != 0 THEN 'x' WHEN m & {special} != 0 THEN '{letter.upper()}' ELSE '-' END",
    )
)


@R.add(f"SELECT p_partkey, CASE m & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' WHEN 24576 THEN 'b' WHEN 8192 THEN 'c' WHEN 4096 THEN 'p' WHEN 49152 THEN 's' ELSE '-' END || {_MODE} AS mode FROM (SELECT p_partkey, CAST(p_partkey * 37 % 65536 AS BIGINT) AS m FROM part)")
def mode_string(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.mode_string(F.col("p_partkey") * 37 % 65536).alias("mode"))


@R.add("SELECT p_partkey, trim(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_]+', '-', 'g'), '-') AS name FROM part")
def sanitized_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.sanitize(F.concat("p_name", F.lit(" / "), "p_type")).alias("name"))


_CONTROLS = [*range(1, 32), 127]
_FROM, _TO = " || ".join(f"chr({c})" for c in _CONTROLS), " || ".join(f"chr({0x2421 if c == 127 else 0x2400 + c})" for c in _CONTROLS)


@R.add(f"SELECT doc_id, length(text) AS n, translate(text, {_FROM}, {_TO}) AS shown FROM documents")
def display_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"), names.control_pictures(F.col("text")).alias("shown"))


@R.add("""SELECT doc_id, i - 1 AS ordinal, run FROM (SELECT doc_id, unnest(r) AS run, unnest(range(1, len(r) + 1)) AS i
FROM (SELECT doc_id, regexp_extract_all(text, '[\\t\\n\\r -~]{64,}') AS r FROM documents))""")
def carve_runs(spark, sf_dir):
    found = carve.text_runs(read(spark, sf_dir, "documents"), "doc_id", "text", entries=None)
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "run")


@R.add("SELECT doc_id, length(regexp_replace(text, '[^\\t\\n\\r -~]', '', 'g')) AS n FROM documents")
def printable_length(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", carve.text_bytes(F.col("text")).alias("n"))


@R.add(r"""SELECT event_id, CASE WHEN first = '{' AND regexp_matches(t, '(?s).\n[^\n]') THEN 'jsonl' WHEN first IN ('{', '[') THEN 'json' ELSE 'txt' END AS kind
FROM (SELECT *, regexp_extract(left(t, 128), '^[ \t\n\r\f]*([^ \t\n\r\f])', 1) AS first FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props || chr(10) || props WHEN 2 THEN chr(10) || ' [' || props || ']' WHEN 3 THEN event_type WHEN 4 THEN props || chr(10) || chr(10) ELSE chr(10) || props END AS t FROM events))""")
def text_kind(spark, sf_dir):
    k, line = F.col("event_id") % 6, F.lit("\n")
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat("props", line, "props")).when(k == 2, F.concat(line, F.lit(" ["), "props", F.lit("]"))).when(k == 3, F.col("event_type"))
    text = text.when(k == 4, F.concat("props", line, line)).otherwise(F.concat(line, "props"))
    return read(spark, sf_dir, "events").select("event_id", names.text_kind(text).alias("kind"))


@R.add("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    """Extension: a field of JSON text."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@R.add(f"SELECT host, CAST(sum(CASE WHEN path LIKE '%/' THEN 512 ELSE (size + 511) // 512 * 512 END) AS BIGINT) AS bytes FROM {FILES} GROUP BY host")
def projected_space(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("kind", F.when(F.endswith("path", F.lit("/")), "directory").otherwise("file"))
    return copying.space(rows, ["host"], forks=False)


@R.add(f"SELECT page_id, CASE WHEN n = 0 THEN name ELSE name || '~' || n END AS unique_name FROM (SELECT page_id, split_part(path, '/', 2) AS name, row_number() OVER (PARTITION BY lower(split_part(path, '/', 2)) ORDER BY page_id) - 1 AS n FROM {FILES})")
def unique_names(spark, sf_dir):
    rows = files(spark, sf_dir).select("page_id", F.lit("/").alias("folder"), F.split_part("path", F.lit("/"), F.lit(2)).alias("name"))
    return listing.unique_names(rows, "folder", "name", "page_id").select("page_id", "unique_name")


@R.add("""SELECT c_custkey, CASE WHEN f = 'ext' THEN m END AS mode, CASE WHEN f = 'fat' THEN a END AS attr,
CASE WHEN f = 'ext' THEN 'dos_attributes' WHEN f = 'fat' THEN 'unix_mode' ELSE 'dos_attributes,unix_mode' END AS dropped
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ext' WHEN 1 THEN 'fat' ELSE 'hfs' END AS f, c_nationkey AS m, c_nationkey % 8 AS a FROM customer)""")
def translated_metadata(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "ext").when(F.col("c_custkey") % 3 == 1, "fat").otherwise("hfs")
    rows = read(spark, sf_dir, "customer").select("c_custkey", kind.alias("fs_type"), F.col("c_nationkey").alias("mode"), (F.col("c_nationkey") % 8).alias("attr"))
    found = copying.translate(rows, copying.capabilities(spark), {"mode": "unix_mode", "attr": "dos_attributes"})
    return found.select("c_custkey", "mode", "attr", F.array_join("dropped", ",").alias("dropped"))


QUERIES, ORACLE_SQL = R.queries, R.sql
