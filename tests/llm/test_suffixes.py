import hashlib
import random
import re
from collections import Counter

import numpy as np

from platterlake.llm import suffixes as s

SCHEMA = "doc_id long, text string, key string, first string, n_bytes string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def brute_passages(texts, rule):
    """Whether each byte is covered by a repeated string of the rule's bytes or words."""
    data = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    strings = [[(w[i][0], w[i + rule.words - 1][1]) for i in range(len(w) - rule.words + 1) if rule.floor <= w[i + rule.words - 1][1] - w[i][0] <= rule.length] for w in words]
    seen = Counter(d[i : i + rule.length] for d in data for i in range(len(d) - rule.length + 1))
    said = Counter(d[a:b] for d, spans in zip(data, strings) for a, b in spans)
    out = []
    for d, spans in zip(data, strings):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - rule.length + 1):
            if seen[d[i : i + rule.length]] > 1:
                gone[i : i + rule.length] = True
        for a, b in spans:
            if said[d[a:b]] > 1:
                gone[a:b] = True
        out.append(gone)
    return out


def sample():
    rnd = random.Random(21)
    make = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    shared = [make(n) for n in (90, 150, 300, 700)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, "x" + "a" * 450]
    for _ in range(40):
        texts.append("".join(rnd.choice([make(rnd.randrange(120)), rnd.choice(shared), rnd.choice(shared)[rnd.randrange(80) :]]) for _ in range(rnd.randrange(1, 6))))
    texts += [texts[10], texts[11], texts[11], texts[12][:-1] + "!", make(900) * 2]
    return texts


def test_two_stage_order_is_the_order_of_suffixes():
    rnd = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "\x00\x01\xff"):
        for _ in range(40):
            counts = [rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 8))]
            segments = ["".join(rnd.choice(alphabet) for _ in range(n + 11)).encode("latin-1") for n in counts]
            if rnd.random() < 0.3:
                segments[0] = segments[0][:1] * len(segments[0])
            buffer, order, places = s.suffix_order(segments, counts, 12)
            assert sorted(order) == [p + i for p, n in zip(places, counts) for i in range(n)]
            keys = [buffer[p : p + 12] for p in order]
            assert keys == sorted(keys)


def test_common_prefixes_of_neighbours():
    rnd = random.Random(14)
    text = bytes(rnd.choice(b"ab") for _ in range(6000))
    order = np.array(sorted(range(len(text) - 30), key=lambda p: text[p : p + 30]))
    want = [next((i for i in range(30) if text[p + i] != text[q + i]), 30) for p, q in zip(order, order[1:])]
    assert s.common_prefixes(text, order, 30).tolist() == want and len(s.common_prefixes(b"", order[:1], 30)) == 0


def test_runs_cover_every_start_once_and_equal_strings_share_their_anchor():
    rnd = random.Random(7)
    text = bytes(rnd.choice(b"ab") for _ in range(5000)) + b"q" * 900
    text += text[1000:2500]
    h, a, n = s.runs(text, 400, 64)
    owner = np.repeat(h, n)
    assert len(owner) == len(text) - 399 and a.tolist() == np.concatenate([[0], np.cumsum(n)[:-1]]).tolist()
    by = {}
    for i in range(len(owner)):
        assert by.setdefault(text[i : i + 400], owner[i]) == owner[i]


def test_long_texts_are_cut_in_chunks(monkeypatch):
    rnd = random.Random(8)
    text = bytes(rnd.choice(b"abc") for _ in range(4000))
    whole = np.repeat(*[s.runs(text)[k] for k in (0, 2)])
    monkeypatch.setattr(s, "_CHUNK", 700)
    parts = np.repeat(*[s.runs(text)[k] for k in (0, 2)])
    assert (whole == parts).all()


def rules():
    return [(s.Rule(100, None), 1024), (s.Rule(100, None), 2), (s.Rule(400, None), 1024), (s.Rule(100, 5, 70), 1024), (s.Rule(100, 5, 70), 2), (s.Rule(130, 4, 64), 3)]


def test_removals_match_brute_force(spark):
    texts = sample()
    rows = [(i if i % 13 else None, t, "c", "c", "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for rule, bucket in rules():
        all_ = [int(x.sum()) for x in brute_passages(texts, rule)] if rule.words else [b[1] for b in brute(texts, rule.length)]
        want = Counter((r[0], *b, n) for r, b, n in zip(rows, brute(texts, rule.length), all_))
        got = s.removals(s.find_repeats(docs, rule, bucket)).collect()
        assert Counter(tuple(r) for r in got) == want


def test_texts_without_repeats(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)
    for rule in (s.Rule(100, 5, 70), s.Rule(100, None)):
        kept = {r.doc_id: r.text for r in s.remove_repeats(docs, rule).collect()}
        gone = brute_passages(texts, rule) if rule.words else brute_passages(texts, s.Rule(100, 10**6))
        for i, (t, cut) in enumerate(zip(texts, gone)):
            left = bytes(np.frombuffer((t or "").encode(), np.uint8)[~cut]).decode("utf-8", "ignore")
            if not cut.any():
                assert i in kept and kept[i] == t
            else:
                assert kept.get(i, "") == (left if left.strip() else "")
    assert s.removals(s.find_repeats(docs.limit(0))).count() == 0


def test_passages_of_over_fifty_words(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, short = some(52), some(49)
    texts = [f"{some(30)} {passage}\n{some(20)}", f"{some(5)}\t{passage}", f"{some(9)} {short} {some(30)}", f"{short}, {some(60)}", some(200)]
    assert 200 < len(passage) < 400
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in s.removals(s.find_repeats(docs)).collect()}
    assert [got[i].n_removed for i in range(5)] == [0] * 5
    assert [got[i].n_passage_bytes for i in range(5)] == [len(passage), len(passage), 0, 0, 0]
    kept = {r.doc_id: r.text for r in s.remove_repeats(docs).collect()}
    assert [kept[i] for i in range(5)] == [texts[0].replace(passage, ""), texts[1].replace(passage, ""), *texts[2:]]


def test_a_bucket_of_thousands_of_segments(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(rnd.choice("ijklmn ") for _ in range(60)) + passage + "".join(rnd.choice("ijklmn ") for _ in range(60)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.removals(s.find_repeats(docs, s.Rule(120, None))).collect()}
    assert [got[i] for i in range(3000)] == brute(texts, 120)
