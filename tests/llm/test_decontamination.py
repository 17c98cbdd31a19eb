import hashlib
import random
import re

from platterlake.llm import decontamination as d

DOCS, BENCH = "doc_id long, text string, items string, hit string, n_words long", "item_id long, text string, hit string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    out = []
    for doc, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for item, sample, *_ in bench:
            b = words(sample)
            n = min(10, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items |= {str(item)} if item is not None else set()
        out.append((doc, len(w), sorted(hit), sorted(items)))
    return sorted(out, key=str)


def sample():
    rnd = random.Random(9)
    v = [f"É{i}" for i in range(30)] + ["The", "a1", "B"]
    bench = [(i, " ".join(rnd.choices(v, k=rnd.choice([3, 9, 10, 15, 40]))), "c") for i in range(12)]
    bench += [(12, None, "c"), (13, " .. ", "c"), (None, "null id item", "c"), (1, bench[1][1], "c"), (14, bench[2][1].upper(), "c")]
    docs = [(None, None, "c", "c", 0), (1, "", "c", "c", 0), (2, "Null ID, item!", "c", "c", 0), (2, "Null ID, item!", "c", "c", 0)]
    for i in range(10, 60):
        text = rnd.choices(v, k=rnd.choice([2, 20, 100]))
        if i % 2:
            at = rnd.randrange(len(text))
            text[at:at] = words(bench[rnd.randrange(12)][1])[rnd.randrange(3) :]
        docs.append((i, rnd.choice([" ", ", ", "\n-"]).join(text), "c", "c", 0))
    docs.append((99, "x " * 50_000 + "The null id item", "c", "c", 0))
    return docs, bench


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    docs, bench = sample()
    want = brute(docs, bench)
    for block in (1 << 20, 900):
        found = d.find_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH), block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, sorted(r.hit), sorted(r["items"])) for r in found), key=str) == want


def test_spans_are_cut_until_none_is_left(spark):
    docs, bench = sample()
    for block in (1 << 20, 900):
        kept = d.remove_spans(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH), block_bytes=block).collect()
        rows = [tuple(r) for r in kept]
        assert all(not hit for _, _, hit, _ in brute(rows, bench))
        clean = {(doc, text) for (doc, text, *_) in docs if not brute([(doc, text)], bench)[0][2]}
        assert clean <= {(r[0], r[1]) for r in rows}
        assert all(r[1] != "" or r[0] == 1 for r in rows)


def test_digest_and_empty_tables(spark):
    assert d.digest([]) == hashlib.sha256(b"").hexdigest()
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert d.find_hits(none, bench).count() == 0
    assert d.find_hits(spark.createDataFrame([(1, "a b", "", "", 0)], DOCS), bench).first().hit == []
