import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from platterlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long, offset long"


def direct(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(2)
    parts = ["The", "cat's", "I'LL", "don't!", "été", "été", "ΣΑΣ", "İx", "中文", "12ab3", "<|endoftext|>", "\x1c", "\x85", " ", " ", "...", "a_b", "\U0001f600", "́", "ﬁ", "ǅ", "''s", "'s"]
    return [rnd.choice(["", " ", "\n\t"]).join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(400)]


def test_encoder_equals_the_tokenizer():
    texts = odd_texts()
    got = [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in packing.Encoder(PATH).encode(texts)]
    assert got == direct(texts)


def as_ids(found):
    return [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in found]


def test_every_plain_character_in_context():
    plain = [chr(c) for c in range(0x2100) if not packing._OTHER.search(chr(c))]
    assert len(plain) > 180
    texts = [f"{a}{c}{b}" for c in plain for a in ("", "A", "7", "'", "é ") for b in ("", "s", "Ü", "!")]
    assert as_ids(packing.Encoder(PATH).encode(texts)) == direct(texts)


def test_special_strings_have_their_own_ids():
    assert as_ids(packing.Encoder(PATH).encode(["x <|endoftext|> y", "a<|startoftext|>", "<|other|>"])) == direct(["x <|endoftext|> y", "a<|startoftext|>", "<|other|>"])
    assert 49407 in direct(["x <|endoftext|> y"])[0]


def test_another_tokenizer_encodes_whole_texts():
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), odd_texts()
    one = packing.Encoder(path)
    assert not one.by_pieces
    assert as_ids(one.encode(texts)) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_small_caches_change_nothing(monkeypatch):
    for name in ("MAX_PIECES", "TOGETHER"):
        monkeypatch.setattr(packing, name, 20)
    texts = odd_texts()
    one = packing.Encoder(PATH)
    assert as_ids(one.encode(texts)) == direct(texts)
    assert len(one.new) <= 20


def test_first_fit_matches_a_plain_scan():
    rnd = random.Random(4)
    for _ in range(30):
        lengths = sorted((rnd.randrange(1, 65) for _ in range(rnd.randrange(1, 200))), reverse=True)
        room, want = [], []
        for n in lengths:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            room[k:k + 1] = [(room[k] if k < len(room) else 64) - n]
            want.append(k)
        assert packing.first_fit_decreasing(lengths, 64) == want


def test_every_id_lies_in_one_piece(spark):
    texts = [*odd_texts()[:60], "word " * 9000, None, "", "dup", "dup"]
    rows = [(i if i % 7 else None, t, 1, 1) for i, t in enumerate(texts)] + [(3, "dup", 0, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    found = packing.pack(packing.tokenized(docs, PATH, 512, with_ids=True), 512, 4)
    pieces = found.collect()
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in direct([t or "" for _, t, *_ in rows]))
    assert all(p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length for p in pieces)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    for s in packing.sequences(found, 512).collect():
        n = sum(x for _, x in bins[s.sequence_id])
        assert s.n_tokens == n and len(s.ids) == (4 * n if n & (n - 1) == 0 else 2048)


def test_empty_table(spark):
    assert packing.pack(packing.tokenized(spark.createDataFrame([], SCHEMA), PATH)).count() == 0
