import random
import re

import xxhash

from platterlake.llm import simhash

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def fp(t):
        w = words(t)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, ((d, _, _), f) in enumerate(zip(rows, fps))), key=str)


def sample():
    rnd = random.Random(3)
    vocabulary = [f"w{i}É" for i in range(80)] + ["The", "AND", "x"]
    rows = [(None, None, "c"), (7, None, "c"), (8, "", "c"), (9, " \t\n", "c"), (3, "One", "c"), (3, "One", "c"), (4, "one two", "c")]
    for i in range(20, 60):
        text = rnd.choices(vocabulary, k=rnd.choice([3, 30, 200, 400]))
        rows.append((i, " ".join(text), "c"))
        for j in range(rnd.randrange(4)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((100 * i + j if j else None, rnd.choice([" ", "\n "]).join(text), "c"))
    return rows + rows[10:14]


def test_matches_brute_force(spark):
    rows = sample()
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found), key=str) == brute(rows)


def test_survivors_keep_one_of_each_component(spark):
    rows = sample()
    groups = {c for _, _, c in brute(rows) if c is not None}
    kept = simhash.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(groups)
    unnamed = spark.createDataFrame([(None, "a b c d", ""), (None, "A b c d", ""), (None, "some other words", "")], SCHEMA)
    assert len(simhash.survivors(unnamed).collect()) == 2


def test_rows_that_repeat_an_id_with_other_texts_stay(spark):
    one, other = "some words of a first text", "quite another text with its own words"
    rows = spark.createDataFrame([(3, one, "c"), (5, one, "c"), (5, other, "c"), (None, other, "c")], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in simhash.survivors(rows).collect()) == [(3, one), (5, other)]


def test_a_text_of_more_shingles_than_are_counted_at_once(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    assert simhash.fingerprint(text) == whole


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain_is_one_component(spark):
    from platterlake.llm.common import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.label) for r in connected(edges).collect()} == {(i, 0) for i in range(41)} | {(500, 500), (501, 500)}
