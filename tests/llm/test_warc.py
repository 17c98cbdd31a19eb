import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from platterlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, uid long, key string"


def rows():
    body = "<html>é\r\n\r\nWARC/1.1\r\n"
    return [(5, "http://a/\r\nX: y", body, "c", 1, "c"), (3, None, body, "c", 1, "c"), (None, "http://b/", body, "c", 1, "c"), (9, "http://c/", None, "c", 1, "c"), (8, "http://d/", "", "c", 1, "c"), (3, None, body, "c", 1, "c"), (1, "u", "x" * 200_000, "c", 1, "c")]


def test_round_trip(spark):
    found = warc.parse(warc.records(warc.write_archive(spark.createDataFrame(rows(), SCHEMA)))).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(p, len((h or "").encode()), digest(h)) for p, _, h, *_ in rows()]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in found), key=str) == sorted(want, key=str)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in found), key=str)
    assert kinds == sorted([(1, "response", None), (3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (8, "response", None), (9, "revisit", 8), (None, "revisit", 3)], key=str)


def test_small_payloads_stay_responses(spark):
    archive = warc.write_archive(spark.createDataFrame(rows(), SCHEMA), min_bytes=10)
    found = {(r.page_id, r.record_type) for r in warc.parse(warc.records(archive)).collect()}
    assert {(8, "response"), (9, "response"), (5, "revisit")} <= found
    assert archive.payloads.count() == 3


def test_records_are_exact(spark):
    for r in warc.records(warc.write_archive(spark.createDataFrame(rows(), SCHEMA))).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        assert rest[:length] == (b"" if b"WARC-Type: revisit" in head else bytes(r.payload))


def test_empty_table(spark):
    assert warc.parse(warc.records(warc.write_archive(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_damage_is_told(spark):
    archive = warc.write_archive(spark.createDataFrame(rows(), SCHEMA))
    other = archive.payloads.withColumn("deflated", warc.deflate(F.lit(b"another payload")))
    with pytest.raises(Exception, match="damaged payload"):
        warc.records(warc.Archive(archive.headers, other)).collect()
    whole = warc.records(archive)
    with pytest.raises(Exception, match="damaged record"):
        warc.parse(whole.withColumn("record", F.concat("record", F.lit(b"x")))).collect()
    with pytest.raises(Exception, match="damaged record"):
        warc.parse(whole.withColumn("payload", F.concat("payload", F.lit(b"x")))).collect()
