"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans training windows and verifies hits.

The set is flat: the benchmark's words in one buffer, and for every length of windows their sorted 64-bit hashes, places and
items, some six times the benchmark's bytes. A batch of texts is hashed at once; a window whose hash is listed is compared
word for word. A benchmark of more than BLOCK_BYTES is not broadcast: its windows stay a table, documents' windows that a
bitmap of fixed size passes meet it in a shuffled join on the hash, and are compared there.

Defined results: a null or wordless text has no words, no hits and is clean; items that are null or wordless have no
window; an item whose id is null marks words but is not counted or named; rows that repeat an item's id count once; rows
are judged one by one, so repeated documents get equal results; further columns of either input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import numbered, read, table

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of a benchmark that is not broadcast: 32 MB.
BITMAP_BITS = 1 << 28
#: Bytes of texts hashed at once; a longer text is hashed by itself.
TOGETHER = 1 << 20
#: Lower-cases A-Z and turns every ASCII byte that is in no word into a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BY_PLACE = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
UID = "__platterlake_uid"


class Words:
    """The words of some texts: their places in one buffer, their hashes, and whose they are."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [(t or b"").translate(_TO_WORDS) for t in texts]
        self.data = b" ".join([*self.texts, b""])
        self.edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts], dtype=np.int64)])
        raw = np.frombuffer(self.data, np.uint8)
        inside = raw != 32
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.owner = np.searchsorted(self.edges, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.edges)  # of every text's words
        sizes = self.stops - self.starts
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        letters = (raw[inside].astype(np.uint64) + np.uint64(1)) * _BY_PLACE[place & 63]
        h = np.add.reduceat(letters, begin) if len(begin) else np.empty(0, np.uint64)
        h ^= h >> np.uint64(31)
        self.hashes = h * np.uint64(0xD6E8FEB86659FD93)

    def windows(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every length: the hashes of windows that lie in one text, and the words that begin them."""
        h = np.zeros(len(self.hashes), np.uint64)
        for n in range(1, longest + 1):
            if n > len(self.hashes):
                return
            h = h[: len(self.hashes) - n + 1] * _BASE + self.hashes[n - 1 :]
            at = np.flatnonzero(self.owner[: len(h)] == self.owner[n - 1 :])
            mixed = h[at]
            yield n, mixed ^ (mixed >> np.uint64(29)), at

    def text(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[first] : self.stops[first + n - 1]].split())


def item_windows(words: Words, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The windows of items: of `window` words, of shorter items all words."""
    count = np.diff(words.first)
    for n, h, at in words.windows(window):
        own = count[words.owner[at]]
        mine = (own == n) if n < window else (own >= n)
        if mine.any():
            yield n, h[mine], at[mine]


class Matcher:
    """Windows of benchmark items, by their length in words."""

    def __init__(self, items, window: int = WINDOW):
        """items: pairs of an id, or None, and a text in UTF-8, or None."""
        self.names, self.window, self.data = [], window, bytearray()
        places: list[list[np.ndarray]] = [[], [], []]  # of the benchmark's words: first byte, end, item
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        words = 0

        def add(some: list) -> None:  # in parts, since hashing takes many times their bytes
            nonlocal words
            w = Words([text for _, text in some])
            for kept, new, base in zip(places, (w.starts, w.stops, w.owner), (len(self.data), len(self.data), len(self.names)), strict=True):
                kept.append((new + base).astype(np.int32))
            for n, h, at in item_windows(w, window):
                windows.setdefault(n, []).append((h, (at + words).astype(np.int32)))
            words += len(w.starts)
            self.data += w.data
            self.names += [item for item, _ in some]

        for some in together(items, lambda row: row[1]):
            add(some)
        self.starts, self.stops, self.owner = (np.concatenate([np.empty(0, np.int32), *kept]) for kept in places)
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in windows.items():
            h, at = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(h, kind="stable")
            bits = min(26, max(10, int(len(h) * 4).bit_length()))
            listed = np.zeros(1 << bits, bool)
            listed[h >> np.uint64(64 - bits)] = True
            self.sets[n] = (h[order], at[order], listed)

    def _text(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[first] : self.stops[first + n - 1]].split())

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list]]:
        """Of every text: its number of words, the positions of those that are hit, and the items whose windows occur."""
        w = Words(texts)
        hit, items = np.zeros(len(w.starts), bool), [set() for _ in texts]
        for n, h, at in w.windows(max(self.sets, default=0)):
            if n not in self.sets:
                continue
            hashes, places, listed = self.sets[n]
            bits = len(listed).bit_length() - 1
            maybe = np.flatnonzero(listed[h >> np.uint64(64 - bits)])
            low, high = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
            for k in np.flatnonzero(low < high):
                first = int(at[maybe[k]])
                said = w.text(first, n)
                names = {self.names[self.owner[p]] for p in places[low[k] : high[k]].tolist() if self._text(p, n) == said}
                if names:
                    hit[first : first + n] = True
                    items[w.owner[first]] |= names
        out = []
        for k, found in enumerate(items):
            a, b = w.first[k], w.first[k + 1]
            out.append((int(b - a), np.flatnonzero(hit[a:b]), sorted(x for x in found if x is not None)))
        return out

    def cut(self, text: bytes) -> bytes:
        """The text without its spans, again until none is left: what stood around a span may form a window too."""
        while len(positions := self.scan([text])[0][1]):
            text = without(text, positions)
        return text


def without(text: bytes, positions: np.ndarray) -> bytes:
    """A text without the bytes from the first to the last of adjoining words of these positions."""
    w = Words([text])
    hit = np.zeros(len(w.starts), np.int8)
    hit[positions] = 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    parts, last = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        parts.append(text[last : w.starts[a]])
        last = w.stops[b - 1]
    return b"".join([*parts, text[last:]])


def together(texts, of=lambda t: t) -> Iterator[list]:
    """Texts, or what holds them, in order, as many at once as have TOGETHER bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(of(t) or b"")
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def _items(bench: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    return bench.select(F.col(id_col).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")


def matcher(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Matcher | None:
    """The set of a benchmark of at most block_bytes of text; None for a larger one."""
    items = _items(bench)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    return Matcher(((r["item"], r["text"]) for r in items.toLocalIterator()), window)


def _scanned(docs: DataFrame, found: Matcher, text: str):
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def each(texts: pd.Series) -> pd.DataFrame:
        out = [(n, hit.tolist(), items) for some in together(texts) for n, hit, items in shared.value.scan(some)]
        return pd.DataFrame(out, columns=["n_words", "hit", "items"])

    return F.pandas_udf(each, "n_words long, hit array<int>, items array<string>")(docs[text].cast("binary"))


_WINDOWS = "h long, n int, said binary"


def _bench_windows(bench: DataFrame, window: int) -> DataFrame:
    """(h, n, said, item): every distinct window of every item."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                w, ids = Words(part["text"].tolist()), part["item"].tolist()
                rows = [(int(x), n, w.text(int(i), n), ids[w.owner[i]]) for n, h, places in item_windows(w, window) for x, i in zip(h.view(np.int64), places, strict=True)]
                yield pd.DataFrame(rows, columns=["h", "n", "said", "item"])

    return _items(bench).mapInPandas(each, _WINDOWS + ", item string").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """A bit for every hash, by its leading bits; the hashes pass the driver one partition at a time."""
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    shift = np.uint64(64 - BITMAP_BITS.bit_length() + 1)
    for row in windows.select("h").distinct().groupBy(F.spark_partition_id().alias("p"), F.pmod("h", F.lit(64))).agg(F.collect_list("h").alias("h")).toLocalIterator():
        place = np.array(row["h"], np.int64).view(np.uint64) >> shift
        np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return out


def _joined_hits(rows: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """rows: (uid, text). (uid, n_words, hit, items) by a join, for a benchmark that is not broadcast."""
    windows = table(_bench_windows(bench, window), "windows")
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most `window` numbers
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(windows))
    shift = np.uint64(64 - BITMAP_BITS.bit_length() + 1)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uids, done = batch[UID].tolist(), 0
            for some in together(batch["text"]):
                w, out = Words(some), []
                out.extend((uids[done + k], -1, int(n), 0, 0, b"") for k, n in enumerate(np.diff(w.first)))  # a row for the text itself
                for n, h, at in w.windows(max(lengths, default=0)):
                    if n in lengths:
                        place = h >> shift
                        bit = shared.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                        for k in np.flatnonzero(bit):
                            i = int(at[k])
                            own = w.owner[i]
                            out.append((uids[done + own], i - int(w.first[own]), 0, int(h[k].view(np.int64)), n, w.text(i, n)))
                done += len(some)
                yield pd.DataFrame(out, columns=[UID, "at", "n_words", "h", "n", "said"])

    found = table(rows.select(UID, F.col("text").cast("binary").alias("text")).mapInPandas(each, f"{UID} long, at int, n_words long, {_WINDOWS}"), "found")
    hits = found.where("n > 0").join(windows, ["h", "n", "said"])
    words = F.explode(F.sequence("at", F.col("at") + F.col("n") - 1))
    positions = hits.select(UID, words.alias("p")).distinct().groupBy(UID).agg(F.array_sort(F.collect_list("p")).alias("hit"))
    items = hits.groupBy(UID).agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = found.where("n = 0").select(UID, "n_words")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return every.join(positions, UID, "left").join(items, UID, "left").select(UID, "n_words", none("hit", "array<int>"), none("items", "array<string>"))


def find_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, hit: positions of hit words, items), a row for every row of docs."""
    found = matcher(bench, window, block_bytes)
    if found is not None:
        return docs.select(F.col(id_col).alias("doc_id"), _scanned(docs, found, text).alias("s")).select("doc_id", "s.*")
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "documents", UID)
    return rows.select(UID, "doc_id").join(_joined_hits(rows, bench, window), UID).drop(UID)


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """docs without the spans of benchmark windows; a document of which no word is left is removed."""
    found, new = matcher(bench, window, block_bytes), "__platterlake_text"
    if found is not None:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def each(texts: pd.Series) -> pd.Series:
            out = []
            for some in together(texts):
                for t, (_, hit, _) in zip(some, shared.value.scan(some), strict=True):
                    out.append(None if t is None else shared.value.cut(without(t, hit)).decode("utf-8", "ignore") if len(hit) else t.decode("utf-8", "ignore"))
            return pd.Series(out, dtype=object)

        # not to be repeated in the filters that follow
        cut = docs.withColumn(new, F.pandas_udf(each, "string").asNondeterministic()(F.col(text).cast("binary")))
        return _left(cut, docs.columns, text, new)

    def rest(data: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, np.array(h, np.int64)).decode("utf-8", "ignore") for t, h in zip(data, hit, strict=True)], dtype=object)

    rows = numbered(docs.withColumn(new, F.col(text)), "documents", UID)
    open_ = rows.select(UID, F.col(new).alias("text"))
    changed = None
    while True:  # what stood around a span may form a window too
        hits = table(_joined_hits(open_, bench, window).where(F.size("hit") > 0).select(UID, "hit"), "hits")
        if hits.isEmpty():
            break
        cut = F.pandas_udf(rest, "string")(F.col("text").cast("binary"), F.col("hit"))
        open_ = table(open_.join(hits, UID).select(UID, cut.alias("text")), "cut")
        changed = open_ if changed is None else table(changed.join(open_.select(UID), UID, "left_anti").unionByName(open_), "changed")
    if changed is None:
        return rows.select(*docs.columns)
    both = rows.join(changed.select(F.col(UID), F.col("text").alias("__platterlake_cut")), UID, "left")
    return _left(both.withColumn(new, F.coalesce("__platterlake_cut", new)), docs.columns, text, new)


def _left(cut: DataFrame, columns: list[str], text: str, new: str) -> DataFrame:
    same = F.col(new).eqNullSafe(F.col(text))
    some = F.coalesce(F.col(new), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
    return cut.where(same | some).select(*(F.col(new).alias(c) if c == text else F.col(c) for c in columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {}
