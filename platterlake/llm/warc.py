"""Content-addressed WARC archive.

Payload bytes are stored once, deflated, under their SHA-256; the exact header of every record is stored on its own and names that
digest. Reading joins the two and yields the original records byte for byte. A digest is trusted only after equal digests
were seen to have equal lengths and equal second hashes, and each payload read back must hash to its name.

Defined results: a null payload is an empty one; a null url is an empty target; line ends in a url are percent-encoded; of
equal payloads the row with the smallest page_id is the response, null last, and of rows that repeat it one; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import numbered, read, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex."""
    parts = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(ALPHABET), F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in parts for s in (15, 10, 5, 0)]
    return F.concat(*letters)


@dataclass
class Archive:
    """headers: (uid, key, header); payloads: (key, deflated), each payload once."""

    headers: DataFrame
    payloads: DataFrame


def deflate(data: Column) -> Column:
    return F.pandas_udf(lambda each: each.map(zlib.compress), "binary")(data)


def inflate(data: Column) -> Column:
    return F.pandas_udf(lambda each: each.map(zlib.decompress), "binary")(data)


def header() -> Column:
    """The exact header of a record from page_id, uid, url, digest, payload_bytes, refers_to and revisit."""
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(":"), F.col("uid").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("revisit"), revisit).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"), F.lit(END),
    ).cast("binary")


def write_archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", payload: str = "html") -> Archive:
    """Write a record per row of pages; payloads of at least min_bytes that repeat become revisits."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    small = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.sha2(data, 256).alias("key"), F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("payload_bytes"))
    rows = numbered(small, "records", "uid")
    first = table(rows.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "uid")).alias("first")), "responses")
    revisit = (F.col("uid") != F.col("first.uid")) & (F.col("payload_bytes") >= min_bytes)
    typed = rows.join(first, "key").select("*", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), base32(F.col("sha1")).alias("digest"))
    headers = table(typed.select("uid", "key", header().alias("header")), "warc-headers")
    named = pages.select(F.sha2(data, 256).alias("key"), deflate(data).alias("deflated"), F.struct(F.octet_length(data), F.xxhash64(data)).alias("second"))
    once = named.groupBy("key").agg(F.first("deflated").alias("deflated"), F.min("second").alias("a"), F.max("second").alias("b"))
    same = F.when(F.col("a") == F.col("b"), F.col("deflated")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), "key")).cast("binary"))
    return Archive(headers, table(once.select("key", same.alias("deflated")), "warc-payloads"))


def records(archive: Archive) -> DataFrame:
    """(record, payload): the record as archived, header to final line ends, and its full payload, which a revisit refers to."""
    joined = archive.headers.join(archive.payloads, "key").select("key", "header", inflate(F.col("deflated")).alias("payload"))
    good = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "key")).cast("binary"))
    own = F.when(F.contains("header", F.lit(b"\r\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", good.alias("payload"), F.concat("header", own, F.lit(END.encode())).alias("record"))


def parse(found: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the bytes of records and their payloads."""
    text = found.withColumn("head", F.substring_index(F.col("header").cast("string"), END, 1))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    page = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:([^:>]*)", 1), F.lit("")).cast(id_type)
    digest = base32(F.sha1("payload"))
    whole = (F.concat(F.lit("sha1:"), digest) == field("WARC-Payload-Digest")) & (F.octet_length("record") == F.octet_length("header") + field("Content-Length").cast("long") + len(END))
    checked = F.when(whole, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), field("WARC-Record-ID"))).cast("string"))
    return text.select(page("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(records(write_archive(read(spark, sf_dir, "pages"), min_bytes=0)))


_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS s,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least
  FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', ((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM p
"""

QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {"op7_warc": _SQL}
