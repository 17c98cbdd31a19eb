"""Digests: whole values as built-ins, chunked streams in order within one group, and the small checksums of disk formats."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.shipping import ship


def four(data: Column) -> list[Column]:
    """CRC-32, MD5, SHA-1 and SHA-256 of a value in one projection."""
    raw = data.cast("binary")
    return [F.lpad(F.lower(F.hex(F.crc32(raw))), 8, "0").alias("crc32"), F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256")]


def one(data: Column, kind: str) -> Column:
    """One of the four, by its name."""
    return dict(zip(("crc32", "md5", "sha1", "sha256"), four(data), strict=True))[kind]


def distinct_contents(rows: DataFrame, data: Column) -> DataFrame:
    """n: how many different contents rows have."""
    return rows.agg(F.count_distinct(F.sha2(data.cast("binary"), 256)).alias("n"))


def of_range(data: Column, offset: int, length: int) -> Column:
    """SHA-256 of a range of a binary value."""
    return F.sha2(F.substring(data.cast("binary"), offset + 1, length), 256)


def of_chunks(chunks: DataFrame, keys: list[str], seq: str = "seq", data: str = "bytes") -> DataFrame:
    """keys, size and the four digests of every stream of chunks.

    A digest is sequential by nature, so the chunks of one stream meet in one task; they arrive sorted and are hashed one
    Arrow batch at a time, so a task never holds a whole stream.
    """
    ship(chunks.sparkSession)
    names = ["size", "crc32", "md5", "sha1", "sha256"]

    def each(batches):
        now, state = None, None

        def done():
            crc, size, *rest = state
            return [*now, size, f"{crc:08x}", *(h.hexdigest() for h in rest)]

        for batch in batches:
            out = []
            for *key, piece in zip(*(batch[k] for k in keys), batch[data], strict=True):
                if key != now:
                    if now is not None:
                        out.append(done())
                    now, state = key, [0, 0, hashlib.md5(), hashlib.sha1(), hashlib.sha256()]
                piece = piece or b""
                state[0], state[1] = zlib.crc32(piece, state[0]), state[1] + len(piece)
                for h in state[2:]:
                    h.update(piece)
            yield pd.DataFrame(out, columns=[*keys, *names])
        if now is not None:
            yield pd.DataFrame([done()], columns=[*keys, *names])

    kinds = dict(chunks.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "size long", *(f"{n} string" for n in names[1:])])
    count = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.select(*keys, seq, data).repartition(count, *keys).sortWithinPartitions(*keys, seq).mapInPandas(each, schema)


def sidecar(digest: Column, name: Column) -> Column:
    """A line of a checksum file."""
    return F.concat(digest, F.lit("  "), name)


def parse_sidecar(line: Column) -> Column:
    return F.struct(F.regexp_extract(line, r"^([0-9A-Fa-f]+)\s+\*?(.*)$", 1).alias("digest"), F.regexp_extract(line, r"^([0-9A-Fa-f]+)\s+\*?(.*)$", 2).alias("name"))


def header_crc32(header: Column, at: int = 16) -> Column:
    """CRC-32 of a header whose own four-byte field counts as zero."""
    return F.crc32(F.concat(F.substring(header, 1, at), F.lit(b"\0" * 4), F.substring(header, at + 5, 1 << 20)))


def crc16(data: bytes, start: int = 0) -> int:
    """CRC-16 with the polynomial 0x1021, most significant bit first."""
    crc = start
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def word_checksum(block: bytes, at: int) -> int:
    """The big-endian word that, at its place, makes a block's words sum to zero."""
    words = [int.from_bytes(block[i : i + 4], "big") for i in range(0, len(block) - 3, 4)]
    return -(sum(words) - words[at]) & 0xFFFFFFFF


def journal_checksum(data: bytes) -> int:
    total = 0
    for byte in data:
        total = (total << 8 & 0xFFFFFFFF) ^ (total + byte & 0xFFFFFFFF)
    return ~total & 0xFFFFFFFF


def is_zero(data: Column) -> Column:
    """Whether every byte is zero."""
    return F.regexp_replace(F.hex(data), "0", "") == ""
