"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant,
so one shuffle on variants brings them together; colliding pairs are verified by their Hamming distance and joined into
components. A variant is shared by at most as many fingerprints as a ball of half the radius holds (65 for radius 2), and
every one of them is within the radius of every other, so each is linked to the smallest only: no link is lost, and a
group's size never enters as a square.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows that repeat a doc_id are
rows of their own with the same component; component_id is the smallest non-null doc_id of the component, null if it has
none; further columns of the input are ignored.

Similarities far from 1 need more than 64 bits: at a Jaccard similarity of 0.8 a bit differs with a probability of 0.15 to 0.16.
A wide fingerprint has BLOCKS blocks of WIDTH bits, and the balls are those of its blocks. Of a ball of radius HALF, a text emits the
variants that flip some of the NARROW bits that it decides by the least margin, since an alike text differs there or nowhere: 16
of 407. Two sets of similarity 0.8 meet in a block with a probability of 0.29, and in none of 32 with one of about 2e-5.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import connected, drop, numbered, read, table

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Hashes counted at once, which bounds the memory of a very long text.
BLOCK = 1 << 14
#: Wide fingerprints.
BLOCKS, WIDTH, NARROW, HALF = 32, 28, 5, 2
#: Of the bits of the first four blocks, those that may differ: a pair of similarity 0.8 has more with a probability below 1e-5.
FAR = 36
_rnd = np.random.default_rng(SEED)
_XOR, _TIMES = _rnd.integers(0, 1 << 63, (2, BLOCKS * WIDTH // 8), dtype=np.uint64)
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)
_MIX, _LANES = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x00FF00FF00FF00FF)
_PLACES = np.uint32(1) << np.arange(WIDTH, dtype=np.uint32)
_FLIPS = [c for n in range(HALF + 1) for c in combinations(range(NARROW), n)]


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as a signed long."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        h = xxhash.xxh64_intdigest(joined, seed)
        return h - (1 << 64) if h >> 63 else h
    ends = list(accumulate(map(len, found)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-words])]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at + words - 1 : at + words - 1 + BLOCK], strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED):
    """A column of fingerprints (long) of docs' text."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return F.pandas_udf(each, "long")(docs[text].cast("binary"))


def ball(radius: int) -> list[int]:
    """Masks, as signed longs, of all sets of at most radius bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: one column fp. Verified links (fp, center) that connect exactly what lies within an even radius."""
    if radius % 2:
        raise ValueError("the radius must be even: both sides of a pair emit half of it")
    masks = F.array(*(F.lit(m).cast("long") for m in ball(radius // 2)))
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    found = variants.withColumn("center", F.expr("min(fp) OVER (PARTITION BY variant)")).where("fp != center")
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= radius).select("fp", "center").distinct()


def wide(hashes: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a set of hashes (unsigned): its blocks, then, for each block, its least decided bits.

    Every hash gives a number of 0 to 255 for each bit, which is set where their sum is over half of what it can be.
    """
    total = np.zeros(BLOCKS * WIDTH, np.int64)
    for at in range(0, len(hashes), 256):  # sums of 256 bytes fit 16 bits
        x = (hashes[at : at + 256, None] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        total += np.concatenate([(y & _LANES).sum(axis=0).view(np.uint16) for y in (x, x >> np.uint64(8))])
    margin = (2 * total - 255 * len(hashes)).reshape(BLOCKS, WIDTH)
    least = np.abs(margin).argsort(axis=1, kind="stable")[:, :NARROW]
    return np.concatenate([(margin > 0) @ _PLACES, _PLACES[least].sum(axis=1, dtype=np.uint32)]).astype(np.uint32)


def screen(marks: np.ndarray) -> tuple[int, int]:
    """The first four blocks of a wide fingerprint as two longs, to compare pairs by."""
    a, b, c, d = (int(x) for x in marks[:4])
    return a << WIDTH | b, c << WIDTH | d


def variants(marks: np.ndarray, first: int, last: int) -> np.ndarray:
    """The keys of blocks first to last - 1 of some wide fingerprints (rows of marks): a row of longs for each."""
    narrow = marks[:, BLOCKS + first : BLOCKS + last].copy()
    bits = []
    for _ in range(NARROW):
        bits.append(narrow & (~narrow + np.uint32(1)))
        narrow ^= bits[-1]
    flips = [sum((bits[k] for k in c), np.zeros_like(narrow)) for c in _FLIPS]
    found = np.stack([marks[:, first:last] ^ f for f in flips], axis=2).astype(np.int64)
    return (found | (np.arange(first, last, dtype=np.int64) << WIDTH)[None, :, None]).reshape(len(marks), -1)


def emitted(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """nodes: (node long, marks: the bytes of a wide fingerprint). (key, node) for every variant of the blocks."""

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = variants(marks, first, last)
            node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "marks").mapInArrow(each, "key long, node long")


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes (node, screen_a, screen_b, ...) whose fingerprints are near enough."""
    left = nodes.select(F.col("node").alias("u"), F.col("screen_a").alias("a"), F.col("screen_b").alias("b"))
    right = nodes.select(F.col("node").alias("v"), F.col("screen_a").alias("c"), F.col("screen_b").alias("d"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("c"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("d")))
    return pairs.join(left, "u").join(right, "v").where(differ <= FAR).select("u", "v")


def _members(rows: DataFrame, radius: int) -> DataFrame:
    """rows: a table of (doc_id, fp). (fp, component_id, root) of every fingerprint; root is its component's smallest one."""
    groups = table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    found = table(links(groups.select("fp"), radius), "links")
    labels = connected(found)
    rooted = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    smallest = table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    members = table(rooted.join(smallest, "root").select("fp", "component_id", "root"), "members")
    drop(groups, found, labels, smallest)
    return members


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id, root), a row for every row of docs."""
    rows = table(docs.select(F.col(id_col).alias("doc_id"), fingerprints(docs, text).alias("fp")), "fingerprints")
    return rows.join(_members(rows, radius), "fp").select("doc_id", "fp", "component_id", "root")


def survivors(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, of which one of each component stays: that with the smallest non-null id, and of
    several such rows any one."""
    uid, fp = "__platterlake_uid", "__platterlake_fp"
    base = numbered(docs.withColumn(fp, fingerprints(docs, text)), "documents", uid)
    members = _members(base.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp")), radius)
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(uid).alias("uid"))
    best = base.join(members.select(F.col("fp").alias(fp), F.col("root").alias("__platterlake_root")), fp).groupBy("__platterlake_root").agg(F.min(row).alias("r"))
    return base.join(best.select(F.col("r.uid").alias(uid)), uid, "left_semi").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
