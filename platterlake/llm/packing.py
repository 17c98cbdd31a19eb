"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents become token ids, the last of them a separator, and are cut every `size` ids; a group is a random set of pieces
that fills about GROUP_BINS sequences, so groups stay bounded however large the corpus is, and each is packed by itself.

Ids are those that the tokenizer's file gives, its special strings included. Defined results: a null text is an empty one,
of which the separator alone is packed; rows that repeat a doc_id are packed as documents of their own; null ids are kept;
further columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import numbered, read

SIZE, SEPARATOR, GROUP_BINS, SEED = 4096, 2, 256, 5
#: Words, numbers and marks whose ids a worker remembers, in each of two generations.
MAX_PIECES = 100_000
#: Characters of texts whose unknown pieces are encoded together.
TOGETHER = 1 << 21
#: The tokenizer that takes the short way; of any other every text is encoded whole.
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_END = "</w>"
#: Characters that normalisation leaves alone or lower-cases one by one: ASCII, Latin-1 letters and marks, common quotes
#: and dashes. A text of these alone is cut here as the pattern cuts it; any other text is encoded whole.
_OTHER = re.compile("[^\\t-\\r !-~À-ÖØ-öø-ÿ¡-©«¬®-±´¶·»¿×÷–—‘’“”…]")
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KINDS = np.array([_SPACE if c == 32 or 9 <= c <= 13 else _DIGIT if 48 <= c <= 57 else _LETTER if 97 <= c <= 122 or c >= 128 else _MARK for c in range(256)], np.uint8)
_loaded: dict[str, "Encoder"] = {}


def cut(data: np.ndarray) -> np.ndarray:
    """Where pieces and runs of white space begin in lower-cased UTF-8 of a text without _OTHER characters."""
    kind = _KINDS[data]
    at = np.flatnonzero(data == 0xC3)
    at = np.concatenate([np.flatnonzero(data == 0xC2), at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]])
    kind[at] = kind[at + 1] = _MARK
    at = np.flatnonzero(data == 0xE2)
    kind[at] = kind[at + 1] = kind[at + 2] = _MARK
    first = np.ones(len(data) + 3, bool)
    first[1 : len(data)] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quotes = np.flatnonzero((data == ord("'")) & first[: len(data)])
    a, b = (np.concatenate([data, [32, 32, 32]])[quotes + k] for k in (1, 2))
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    first[quotes[one | two] + 1] = False
    first[quotes[one] + 2] = first[quotes[two] + 3] = True
    return np.flatnonzero(first[: len(data)])


class Encoder:
    """Ids, as little-endian unsigned 32-bit numbers, of texts.

    The known kind of tokenizer never joins across the pieces its pattern finds, and the last id of a piece, and no other,
    ends a word; so new pieces are encoded in one go, one after the other, and every piece is remembered for a while.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.by_pieces = self._known(kind)
        self.ends = np.zeros(max(kind["model"]["vocab"].values()) + 1, bool)
        if self.by_pieces:
            self.ends[[i for t, i in kind["model"]["vocab"].items() if t.endswith(_WORD_END)]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _known(kind: dict) -> bool:
        model, split = kind["model"], {"type": "Split", "pattern": {"Regex": _SPLIT_RULE}, "behavior": "Removed", "invert": True}
        pre = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [None, {}]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        byte_level = pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex") and len(pre) == 2
        special = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in kind["added_tokens"])
        return plain and byte_level and special and pre[0] == split and model.get("end_of_word_suffix") == _WORD_END and (kind.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and not kind.get("post_processor")

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) == len(pieces) and 4 * len(ids) == ends[-1]:
            flat, at = ids.tobytes(), [0, *ends.tolist()]
            self.new.update(zip(pieces, (flat[a:b] for a, b in zip(at, at[1:]))))
        else:
            self.new.update(zip(pieces, self._raw(texts), strict=True))

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        unknown = []
        for p in pieces:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                elif not p.isspace():
                    unknown.append(p)
                else:
                    new[p] = b""
        if unknown:
            self._learn(unknown)
        out = list(map(new.__getitem__, pieces))
        if len(new) > MAX_PIECES:
            self.old, self.new = new, {}
        return out

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts without _OTHER characters: the distinct pieces of all of them are looked up, then dealt out."""
        lowered = [t.lower().encode() for t in texts]
        joined = b"\n".join([*lowered, b""])  # a line end belongs to no piece
        data = np.frombuffer(joined, np.uint8)
        first = cut(data)
        offsets = np.concatenate([first, [len(data)]]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        ids = self._ids(found.dictionary.to_pylist())
        size = np.array([len(i) // 4 for i in ids], np.int64)
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        which = found.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stop = np.cumsum([len(t) + 1 for t in lowered])
        at = [0, *(4 * ends[np.searchsorted(first, stop)]).tolist()]
        return (out[a:b] for a, b in zip(at, at[1:]))

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not (_OTHER.search(t) or any(x in t for x in self.special)) for t in texts]
        found = self._plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else iter(())
        for text, p in zip(texts, plain, strict=True):
            yield next(found) if p else self._raw([text])[0]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        first = size = 0
        for at, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or at == len(texts) - 1:
                some = texts[first : at + 1]
                yield from self._some(some) if self.by_pieces else self._raw(some)
                first, size = at + 1, 0


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenized(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every document's ids."""
    end = SEPARATOR.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for whole in batches:
            for first in range(0, len(whole), 1024):
                batch = whole.slice(first, 1024)
                out = []
                for row, ids in enumerate(tokens.encode(batch["text"].to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        out.append((row, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
                columns = list(zip(*out, strict=True))
                numbers = [pa.array(c, pa.int64()) for c in columns[1:5]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(columns[0], pa.int64())), *numbers, *[pa.array(columns[5], pa.binary())] * with_ids], names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(each, schema)


class Tournament:
    """Bins of equal capacity; every inner node holds the largest room below it, so the first bin with room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of every length, none of which exceeds the capacity; lengths must already decrease."""
    tree = Tournament(len(lengths), capacity)
    return [tree.first_fit(n) for n in lengths]


def pack(pieces: DataFrame, size: int = SIZE, group_bins: int = GROUP_BINS) -> DataFrame:
    """pieces and, for each, sequence_id and offset. Only lengths travel; the pieces are a table already."""
    rows = numbered(pieces, "pieces", "uid")
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (size * group_bins)))

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = pd.Series(first_fit_decreasing(frame["length"].tolist(), size), dtype="int64")
        frame["sequence_id"] = (int(key[0]) << 32) + bins
        frame["offset"] = frame["length"].groupby(bins).cumsum() - frame["length"]
        return frame.drop(columns=["uid", "grp"])

    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.lit(groups)))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return grouped.groupBy("grp").applyInPandas(each, schema)


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """(sequence_id, ids, n_tokens): ids of pieces packed with_ids, little-endian and padded with zeros to the size, except
    where their number is a power of two."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    n = (F.octet_length("ids") / 4).cast("int")
    padded = F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(F.rpad(F.col("ids"), 4 * size, b"\x00"))
    return whole.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"), n.alias("n_tokens"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(tokenized(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
