"""Suffix-array removal of long repeats: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Passages may also be told by their words: a string of WORDS whole words, of FLOOR to LENGTH bytes, that also stands
elsewhere as whole words. Fewer bytes than FLOOR never count as a passage, more than LENGTH always do.

1.  Equal texts are one text with a count. Those of LENGTH bytes or more that occur twice are removed whole.
2.  Every start of FLOOR bytes (of LENGTH where words do not count) belongs to the leftmost smallest hashed gram inside
    them, its anchor. Equal strings have equal anchors, so only starts whose anchor's gram occurs twice can repeat.
    Consecutive starts of one anchor form a run, and a run's bytes a segment, up to LENGTH bytes from its last start; equal
    segments (with the bytes around them) are one segment with a count, and repeat whole if it is two or more.
3.  Buckets of different segments with the same gram are suffix-sorted by two stages: suffixes smaller than their
    successors are sorted directly, the others are induced by one scan over the buckets of first bytes. Adjacent suffixes
    with LENGTH common bytes repeat; of the starts of words, those whose words another start of the bucket has.
4.  A bucket of more than MAX_BUCKET segments, such as a passage that very many documents share, is not gathered: its
    strings are dealt out by a 128-bit hash to as many parts as its size asks for, and counted there.

Defined results: a null text is an empty one; strings never cross documents; repeated rows are documents of their own, so
each is the other's repeat; a word is a run of bytes other than ASCII white space; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import drop, numbered, only, read, table

LENGTH, GRAM = 400, 48
#: A passage of over 50 words. Of 51 words of the test tables, 99 % have 240 bytes or more.
WORDS, FLOOR = 51, 240
MAX_BUCKET = 2048
#: Bytes of segments sorted at once; a bucket is never split. Sorting takes some 200 times as much memory.
BLOCK = 1 << 19
#: Shared grams that may be broadcast, of 8 bytes each.
MAX_BROADCAST = 1_000_000
#: Segments of a larger bucket whose strings make a part, on average.
PART = 64
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is the smallest
    w = length - gram + 1
    starts = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = ranked
    square = padded.reshape(-1, w)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[:starts], left[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return h[anchor[first]].view(np.int64), first, np.diff(np.concatenate([first, [starts]]))


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of starts with one anchor: the anchor gram's hash, the first start, and how many there are."""
    out = []
    for at in range(0, len(text) - length + 1, _CHUNK):
        h, first, n = _runs(np.frombuffer(text, np.uint8, min(_CHUNK + length - 1, len(text) - at), at), length, gram)
        out.append((h, first + at, n))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(segments: list[bytes], counts: list[int], length: int = LENGTH) -> tuple[bytes, list[int], np.ndarray]:
    """The segments' first counts suffixes, in the order of their first `length` bytes.

    Returns the segments in one buffer, each followed by a byte that ends it, the sorted positions there, and the segments'
    places. A segment has length - 1 bytes more than its count.
    """
    buffer = b"\0".join([*segments, b""])
    sizes = np.array([len(s) for s in segments])
    places = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = places + sizes
    c = np.frombuffer(buffer, np.uint8).astype(np.int16)
    c[ends] = -1
    step = np.sign(np.diff(c, append=np.int16(-1)))
    rises = np.where(step != 0, np.arange(len(c)), len(c))
    nearest = np.minimum.accumulate(rises[::-1])[::-1]  # the next place where neighbours differ
    smaller = np.zeros(len(c), bool)  # than its successor
    inside = nearest < len(c)
    smaller[inside] = step[nearest[inside]] > 0
    smaller[ends] = True  # an end is smaller than all, and sorted first
    last = places + np.array(counts)
    needed = np.zeros(len(c) + 1, np.int32)
    np.add.at(needed, places, 1)
    np.add.at(needed, last, -1)
    direct = np.where(smaller, np.arange(len(c)), len(c))
    direct = np.minimum.accumulate(direct[::-1])[::-1]
    chained = last[~smaller[last - 1]]  # the last start is induced from suffixes behind it
    np.add.at(needed, chained, 1)
    np.add.at(needed, direct[chained] + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    seeds = np.flatnonzero(needed & smaller)
    stop = np.minimum(seeds + length, ends[np.searchsorted(ends, seeds)])
    keys = [buffer[a:b] for a, b in zip(seeds.tolist(), stop.tolist(), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    seeds = seeds[order]
    induced = needed & ~smaller
    # buckets by first byte: induced suffixes, then those sorted directly
    a, b = np.bincount(c[induced] + 1, minlength=257), np.bincount(c[seeds] + 1, minlength=257)
    heads = np.concatenate([[0], np.cumsum(a + b)])[:-1]
    array = np.zeros(int((a + b).sum()), np.int64)
    array[np.repeat(heads + a - np.concatenate([[0], np.cumsum(b)])[:-1], b) + np.arange(len(seeds))] = seeds
    found, is_induced, at = array.tolist(), induced.tobytes(), heads[1:].tolist()
    for i in range(len(found)):
        p = found[i] - 1
        if p >= 0 and is_induced[p]:
            k = buffer[p]
            found[at[k]] = p
            at[k] += 1
    starts = np.zeros(len(c) + 1, np.int32)
    np.add.at(starts, places, 1)
    np.add.at(starts, last, -1)
    wanted = (np.cumsum(starts[:-1]) > 0).tobytes()
    return buffer, [p for p in found if wanted[p]], places


def common_prefixes(buffer: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """How many of their first `length` bytes each of the sorted suffixes, from the second on, shares with the one before it."""
    if len(order) < 2:
        return np.empty(0, np.int32)
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer + bytes(length), np.uint8), length)
    out = np.empty(len(order) - 1, np.int32)
    for at in range(0, len(out), 4096):
        rows = strings[order[at : at + 4097]]
        other = rows[1:] != rows[:-1]
        out[at : at + 4096] = np.where(other.any(axis=1), other.argmax(axis=1), length)
    return out


def repeated_starts(segments: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its first counts strings of `length` bytes occur at another place of the segments too: those
    that share all these bytes with a neighbour in the order of suffixes."""
    buffer, order, places = suffix_order(segments, counts, length)
    whole = [max(0, min(n, len(s) - length + 1)) for s, n in zip(segments, counts, strict=True)]
    inside = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + np.array(whole), -1)
    order = np.array(order, np.int64)
    order = order[(np.cumsum(inside) > 0)[order]]  # shorter ones stand before all that they begin
    same = np.flatnonzero(common_prefixes(buffer, order, length) >= length)
    hit = np.zeros(len(buffer), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    return [np.flatnonzero(hit[p : p + n]) for p, n in zip(places, counts, strict=True)]


def word_strings(data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of so many whole words start and stop."""
    gap = np.concatenate([[True], _IS_SPACE[data], [True]])
    first, stop = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    return first[: max(0, len(first) - words + 1)], stop[words - 1 :]


def words_of_segments(rows: list[bytes], counts: list[int], words: int, floor: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, start, string) of the word strings that start among the first counts bytes of a segment.

    Of a row's bytes the first and the last stand around its segment."""
    buffer = b"\n".join([*rows, b""])
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])
    first, stop = word_strings(np.frombuffer(buffer, np.uint8), words)
    row = np.searchsorted(edges, first, "right") - 1
    at, size = first - edges[row] - 1, stop - first
    good = (at >= 0) & (at < np.array(counts)[row]) & (size >= floor) & (size <= length) & (stop < edges[row + 1] - 1)
    for r, i, a, b in zip(row[good].tolist(), at[good].tolist(), first[good].tolist(), stop[good].tolist(), strict=True):
        yield r, i, buffer[a:b]


def ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Ascending starts as ranges [first, stop)."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1).tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def by_bytes(first, stop, length: int) -> list[tuple[int, int]]:
    """The bytes that strings starting in the ranges cover."""
    return [(int(a), int(b) - 1 + length) for a, b in zip(first, stop, strict=True)]


def by_words(text: bytes, first, stop, words: int | None, floor: int, length: int) -> list[tuple[int, int]]:
    """The word strings that start in the ranges."""
    if words is None or not len(first):
        return []
    wanted = np.zeros(len(text) + 1, np.int32)
    np.add.at(wanted, np.asarray(first, np.int64), 1)
    np.add.at(wanted, np.asarray(stop, np.int64), -1)
    a, b = word_strings(np.frombuffer(text, np.uint8), words)
    good = (np.cumsum(wanted)[a] > 0) & (b - a >= floor) & (b - a <= length)
    return list(zip(a[good].tolist(), b[good].tolist(), strict=True))


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, last = [], 0
    for a, b in spans:
        parts.append(text[last:a])
        last = b
    return b"".join([*parts, text[last:]])


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, key, n_bytes, text): the digest and the bytes of each text."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(data, 256)).alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("text"))


def _with_runs(named: DataFrame, length: int) -> DataFrame:
    """(key, n_bytes, h, a, n): the runs of the starts of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(t.as_buffer().to_pybytes(), length) for t in batch["text"]]
            ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
            flat = [np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(f.astype(kind))) for f, kind in zip(flat, (np.int64, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n_bytes"], *lists], ["key", "n_bytes", "h", "a", "n"])

    return named.select("key", "n_bytes", "text").mapInArrow(each, "key binary, n_bytes long, h array<bigint>, a array<int>, n array<int>")


@dataclass(frozen=True)
class Rule:
    """Strings of `length` bytes repeat and, unless words is None, those of so many words, of `floor` to `length` bytes."""

    length: int = LENGTH
    words: int | None = WORDS
    floor: int = FLOOR

    @property
    def least(self) -> int:
        return self.length if self.words is None else min(self.floor, self.length)


def _cut_out(texts: DataFrame, rule: Rule, how: str) -> DataFrame:
    """texts: text and h, a, n of runs, and d, their buckets' sizes. A row for every run: its segment's digest ("digest"), its
    bytes and one on either side ("bytes"), or the hashes of its strings ("strings"), each with the part of its bucket that
    it falls into. Beyond the ends of a text stand line ends."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tid, text, hs, firsts, counts, sizes in zip(*(batch[c] for c in ("tid", "text", "h", "a", "n", "d")), strict=True):
                around = b"\n" + text + b"\n"
                for h, a, n, d in zip(hs.tolist(), firsts.tolist(), counts.tolist(), sizes.tolist(), strict=True):
                    segment = around[a : a + n + rule.length + 1]
                    sd = xxhash.xxh3_128_digest(segment, n)
                    if how == "digest":
                        rows.append((h, sd, tid, a, n, len(segment) - 2))
                    elif how == "bytes":
                        rows.append((h, sd, n, segment))
                    else:
                        parts = -(-d // PART)
                        found = [(i, False, xxhash.xxh3_128_digest(segment[i + 1 : i + 1 + rule.length])) for i in range(min(n, len(segment) - 1 - rule.length))]
                        if rule.words:
                            found += [(i, True, xxhash.xxh3_128_digest(w, 1)) for _, i, w in words_of_segments([segment], [n], rule.words, rule.floor, rule.length)]
                        rows.extend((h, int.from_bytes(x[:4], "little") % parts, sd, i, w, x) for i, w, x in found)
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    schema = {"digest": "h long, sd binary, tid long, a int, n int, size int", "bytes": "h long, sd binary, n int, segment binary", "strings": "h long, part int, sd binary, i int, w boolean, string binary"}[how]
    names = [c.split()[0] for c in schema.split(", ")]
    return texts.select("tid", "text", "h", "a", "n", "d").mapInPandas(each, schema)


def repeats_in(rows: list[tuple[int, bytes, int, bytes]], rule: Rule) -> list[tuple]:
    """rows: (h, sd, n, segment and the bytes around it) of whole buckets. (h, sd, first, stop, wfirst, wstop): ranges of the
    starts whose bytes, and whose words, repeat in the buckets."""
    counts, out = [r[2] for r in rows], []
    words = [[] for _ in rows]
    if rule.words:
        found = list(words_of_segments([r[3] for r in rows], counts, rule.words, rule.floor, rule.length))
        often = Counter(w for *_, w in found)
        for r, i, w in found:
            if often[w] > 1:
                words[r].append(i)
    for (h, sd, *_), hit, said in zip(rows, repeated_starts([r[3][1:-1] for r in rows], counts, rule.length), words, strict=True):
        if len(hit) or said:
            out.append((h, sd, *ranges(hit), *ranges(np.array(said, np.int64))))
    return out


_FOUND = "h long, sd binary, first array<int>, stop array<int>, wfirst array<int>, wstop array<int>"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _sorted_buckets(segments: DataFrame, rule: Rule) -> DataFrame:
    """segments: (h, sd, n, segment), no two alike. What repeats_in finds."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(batch["h"], batch["sd"], batch["n"], batch["segment"], strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield pd.DataFrame(repeats_in(held, rule), columns=_NAMES)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield pd.DataFrame(repeats_in(held, rule), columns=_NAMES)

    return segments.repartition("h").sortWithinPartitions("h").mapInPandas(each, _FOUND)


def _counted_parts(strings: DataFrame) -> DataFrame:
    """strings: (h, part, sd, i, w, string). The starts whose string another place of the bucket has too, as in repeats_in; equal
    strings lie in one part, so a segment comes out once for every part that holds some of it."""

    def counted(rows: list[tuple]) -> pd.DataFrame:
        often = Counter(r[4] for r in rows)
        found: dict[tuple, tuple[list, list]] = {}
        for h, sd, i, w, x in rows:
            if often[x] > 1:
                found.setdefault((h, sd), ([], []))[w].append(i)
        return pd.DataFrame([(*key, *ranges(np.array(sorted(a), np.int64)), *ranges(np.array(sorted(b), np.int64))) for key, (a, b) in found.items()], columns=_NAMES)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for h, part, *row in zip(*(batch[c] for c in ("h", "part", "sd", "i", "w", "string")), strict=True):
                if (h, part) != now:
                    if held:
                        yield counted(held)
                    now, held = (h, part), []
                held.append((h, row[0], row[1], int(row[2]), row[3]))
        if held:
            yield counted(held)

    return strings.repartition("h", "part").sortWithinPartitions("h", "part").mapInPandas(each, _FOUND)


@dataclass
class Repeats:
    """rows: (doc_id, key, n_bytes); classes: (tid, key, n_bytes, copies); texts: (tid, key, text) of texts that may hold
    repeats; spans: (tid, first, stop, wfirst, wstop), ranges of starts whose bytes, and whose words, repeat."""

    rows: DataFrame
    classes: DataFrame
    texts: DataFrame
    spans: DataFrame
    rule: Rule

    @property
    def whole(self) -> DataFrame:
        """The classes that are removed whole."""
        return self.classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= self.rule.length))

    @property
    def partly(self) -> DataFrame:
        """(key, text, first, stop, wfirst, wstop) of all others that hold repeats."""
        return self.texts.join(self.spans, "tid").join(self.whole.select("tid"), "tid", "left_anti").select("key", "text", "first", "stop", "wfirst", "wstop")

    def cuts(self, text: bytes, first, stop, wfirst, wstop) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """What repeated bytes cover, and what these and repeated words cover."""
        spans = by_bytes(first, stop, self.rule.length)
        return merged(spans), merged(spans + by_words(text, wfirst, wstop, self.rule.words, self.rule.floor, self.rule.length))


def _runs_of(chosen: DataFrame) -> DataFrame:
    """chosen: (tid, h, a, n, d). A row for every tid, with lists."""
    lists = chosen.groupBy("tid").agg(F.collect_list(F.struct("h", "a", "n", "d")).alias("r"))
    return lists.select("tid", *(F.col(f"r.{c}").alias(c) for c in ("h", "a", "n", "d")))


def find_repeats(docs: DataFrame, rule: Rule = Rule(), max_bucket: int = MAX_BUCKET, id_col: str = "doc_id", text: str = "text") -> Repeats:
    length, least = rule.length, rule.least
    named = _named(docs, id_col, text)
    one = _with_runs(named.where(F.col("n_bytes") >= least), least).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("n_bytes", "h", "a", "n")).alias("r"))
    classes = numbered(one.select("key", "copies", "r.*"), "classes", "tid")
    # copies too short to be removed whole repeat themselves
    each_run = classes.select("tid", F.when(F.col("n_bytes") < length, F.col("copies")).otherwise(F.lit(1)).alias("times"), F.inline(F.arrays_zip("h", "a", "n")))
    shared = table(each_run.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1").select("h"), "shared")
    few = shared.count() <= MAX_BROADCAST
    candidates = each_run.select("tid", "h", "a", "n", F.lit(0).cast("long").alias("d")).join(F.broadcast(shared) if few else shared, "h")
    wanted = table(_runs_of(candidates).join(classes.select("tid", "key"), "tid"), "wanted")
    once = only(named.where(F.col("n_bytes") >= least), wanted.select("key")).groupBy("key").agg(F.first("text").alias("text"))
    texts = table(once.join(wanted, "key"), "texts")
    drop(wanted, shared)

    places = table(_cut_out(texts, rule, "digest"), "places")
    again = classes.where((F.col("copies") > 1) & (F.col("n_bytes") < length)).select("tid", "copies")
    counted = places.join(again, "tid", "left")
    kinds = table(counted.groupBy("h", "sd").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("c"), F.min(F.struct("tid", "a", "n")).alias("owner")), "kinds")
    buckets = table(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "buckets")

    def owners(which: str) -> DataFrame:
        return texts.select("tid", "text").join(_runs_of(kinds.join(buckets.where(which), "h").select("h", "owner.*", "d")), "tid")

    partly = _sorted_buckets(_cut_out(owners(f"d <= {max_bucket}"), rule, "bytes"), rule)
    if buckets.where(f"d > {max_bucket}").count():
        partly = partly.union(_counted_parts(_cut_out(owners(f"d > {max_bucket}"), rule, "strings")))
    none = F.array().cast("array<int>")
    here, last = F.col("a"), F.col("a") + F.least("n", F.col("size") - (length - 1))
    long = last > here
    whole = places.join(kinds.where("c > 1").select("h", "sd"), ["h", "sd"]).select(
        "tid", F.when(long, F.array(here)).otherwise(none).alias("first"), F.when(long, F.array(last)).otherwise(none).alias("stop"),
        F.array(here).alias("wfirst"), F.array(here + F.col("n")).alias("wstop"),
    )
    shift = lambda c: F.transform(c, lambda i: i + F.col("a")).alias(c)
    alone = places.join(partly, ["h", "sd"]).select("tid", *(shift(c) for c in ("first", "stop", "wfirst", "wstop")))
    spans = whole.union(alone).groupBy("tid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("first", "stop", "wfirst", "wstop")))
    return Repeats(named.select("doc_id", "key", "n_bytes"), classes.select("tid", "key", "n_bytes", "copies"), texts.select("tid", "key", "text"), spans, rule)


def removals(found: Repeats) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes), a row for every document. n_removed counts what
    strings of `length` bytes cover, n_passage_bytes what these and the rule's word strings cover."""
    names = ["key", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, *starts in zip(*(batch[c] for c in ("key", "text", "first", "stop", "wfirst", "wstop")), strict=True):
                spans, more = cuts(text, *starts)
                rows.append((key, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(text, spans)).hexdigest(), sum(b - a for a, b in more)))
            yield pd.DataFrame(rows, columns=names)

    cuts = Repeats(None, None, None, None, found.rule).cuts
    cut = found.partly.mapInPandas(each, "key binary, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
    every = F.lit(-1).cast("long")
    gone = found.whole.select("key", every.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), every.alias("n_passage_bytes"))
    changed = cut.union(gone)
    joined = found.rows.join(changed, "key", "left")
    count = lambda c: F.when(F.col(c) < 0, F.col("n_bytes")).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    return joined.select("doc_id", "n_bytes", count("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"), count("n_passage_bytes"))


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated passages, nor the rest of a character cut in two; what loses all its words is removed."""
    found = find_repeats(docs, rule, id_col=id_col, text=text)
    cuts = Repeats(None, None, None, None, rule).cuts

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = zip(*(batch[c] for c in ("text", "first", "stop", "wfirst", "wstop")), strict=True)
            left = [kept(t, cuts(t, *starts)[1]).decode("utf-8", "ignore") for t, *starts in columns]
            yield pd.DataFrame({"__platterlake_key": batch["key"], "__platterlake_left": left})

    some = found.partly.mapInPandas(each, "__platterlake_key binary, __platterlake_left string")
    gone = found.whole.select(F.col("key").alias("__platterlake_key"), F.lit("").alias("__platterlake_left"))
    changed = table(some.union(gone).select(F.lower(F.hex("__platterlake_key")).alias("__platterlake_key"), "__platterlake_left"), "changed")
    # only what changes is joined; all other rows stay where they are
    named, keys = docs.withColumn("__platterlake_key", F.sha2(F.col(text), 256)), changed.select("__platterlake_key")
    cut = only(named, keys).join(changed, "__platterlake_key").where(F.col("__platterlake_left").rlike(r"[^\x20\x09-\x0D]"))
    return only(named, keys, "left_anti").select(*docs.columns).unionByName(cut.select(*(F.col("__platterlake_left").alias(c) if c == text else F.col(c) for c in docs.columns)))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(find_repeats(read(spark, sf_dir, "documents")))


QUERIES = {"op9_suffixes": op9_suffixes}
ORACLE_SQL: dict[str, str] = {}
