"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join that removes its false positives.

Two kinds of entries are listed: rules of a host and a path, which fit the host, its subdomains and every path that starts
with theirs, and canonical URLs (the host without a first label www or m, the path without the final slashes), which are
blocked. Every URL emits the few keys
under which a rule could be listed, and its canonical form. Keys that the filter rejects end there; the rest meet the
listed keys in an exact join. The rule of the greatest length decides, then the list; anything else is allowed.

Only DataFrame functions run. A filter is a table of (block, four words of 64 bits), built by bit_or. It is broadcast only
up to MAX_BLOCKS rows; beyond that the exact join does alone.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; of two rules
of equal length that with the longer host wins, then the one that blocks; repeated rows and null page_ids are judged
row by row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import numbered, read, table

WORDS, BITS, BITS_PER_KEY = 4, 8, 12
#: 64-byte rows of a filter that may be broadcast: 32 MB.
MAX_BLOCKS = 1 << 19
#: Listed keys that may be broadcast to the exact join.
MAX_KEYS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Labels of hosts whose pages the query lists, wherever in the host they stand.
LISTED_LABELS = ("spam-farm", "blog")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"/+\z", "")))


def _place(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bits in each word."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(BITS)]
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"m{w}"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *words]


class BlockedBloom:
    """keys: a frame whose first column holds n listed keys."""

    def __init__(self, keys: DataFrame, n: int):
        self.blocks = max(1, math.ceil(n * BITS_PER_KEY / (64 * WORDS)))
        placed = keys.select(*_place(F.col(keys.columns[0]), self.blocks))
        self.filter = placed.groupBy("block").agg(*(F.bit_or(f"m{w}").alias(f"f{w}") for w in range(WORDS)))

    def passes(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be listed; all of them where the filter is too large to be broadcast, since to join it would
        shuffle every row once more than the exact join alone does."""
        if self.blocks > MAX_BLOCKS:
            return rows
        side = F.broadcast(self.filter)
        placed = rows.select("*", *_place(F.col(key), self.blocks))
        hit = " AND ".join(f"(f{w} & m{w}) = m{w}" for w in range(WORDS))
        return placed.join(side, "block").where(hit).select(*rows.columns)


def inline(spark: SparkSession, rows, names: str) -> DataFrame:
    """A few rows of strings as a frame."""
    names = names.split()
    found = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(found))


def verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), a row for every row of pages.

    rules: (host, path, action); listed: canonical URLs in its first column, or None.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = numbered(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), "urls", "uid")
    keyed = rules.select(F.concat("host", "path").alias("key"), F.length("host").alias("h"), F.length("path").alias("p"), F.size(F.split("host", r"\.")).alias("k"), (F.col("action") == "block").alias("blocks"))
    keyed = table(keyed.where("key IS NOT NULL").groupBy("key", "h", "p", "k").agg(F.max("blocks").alias("blocks")), "rules")
    n = keyed.count()
    shapes = [tuple(r) for r in keyed.select("k", "p").distinct().collect()]  # at most labels x path lengths of the rules
    found = []
    if shapes:
        labels = F.size(F.split("host", r"\."))
        tried = [F.when((labels >= k) & (F.length("path") >= p), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, p))) for k, p in shapes]
        tries = rows.where("host != ''").select("uid", F.explode(F.array_distinct(F.array_compact(F.array(*tried)))).alias("key"))
        possible = BlockedBloom(keyed.select("key"), n).passes(tries, "key")
        exact = possible.join(F.broadcast(keyed) if n <= MAX_KEYS else keyed, "key")
        found.append(exact.select("uid", F.struct((F.col("h") + F.col("p")).alias("n"), "h", "blocks", "key").alias("best"), F.lit(False).alias("listed")))
    if listed is not None:
        urls = table(listed.select(F.col(listed.columns[0]).alias("key")).where("key IS NOT NULL").distinct(), "listed")
        n = urls.count()
        tries = rows.select("uid", canonical(F.col("host"), F.col("path")).alias("key")).where("key IS NOT NULL")
        exact = BlockedBloom(urls, n).passes(tries, "key").join(urls, "key")
        found.append(exact.select("uid", F.lit(None).cast("struct<n:int,h:int,blocks:boolean,key:string>").alias("best"), F.lit(True).alias("listed")))
    if not found:
        found = [spark.range(0).selectExpr("id AS uid", "CAST(NULL AS struct<n:int,h:int,blocks:boolean,key:string>) AS best", "false AS listed")]
    hits = found[0] if len(found) == 1 else found[0].union(found[1])
    hits = table(hits.groupBy("uid").agg(F.max("best").alias("best"), F.max("listed").alias("listed")), "hits")
    judged = rows.join(hits, "uid", "left")
    blocked = F.coalesce(F.col("best.blocks"), F.col("listed"), F.lit(False))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(canonical(host, path).alias("key"))
    return verdicts(pages, inline(spark, RULES, "host path action"), listed).drop("listed")


_SQL = """
WITH u AS (
  SELECT page_id, row_number() OVER () AS uid,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, uid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rhost, rpath, act) AS (VALUES %s),
m AS (
  SELECT uid, rhost || rpath AS rule, act,
         row_number() OVER (PARTITION BY uid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, act DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
l AS (SELECT DISTINCT regexp_replace(host, '^(www|m)[.]', '') || rtrim(path, '/') AS key FROM p WHERE list_has_any(string_split(host, '.'), [%s]))
SELECT page_id, host, path, rule,
       CASE WHEN act IS NOT NULL THEN act WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (uid) LEFT JOIN l ON host != '' AND regexp_replace(host, '^(www|m)[.]', '') || rtrim(path, '/') = key
"""

QUERIES = {"op8_urlfilter": op8_urlfilter}
ORACLE_SQL = {"op8_urlfilter": _SQL % (", ".join(str(r) for r in RULES), ", ".join(f"'{x}'" for x in LISTED_LABELS))}
