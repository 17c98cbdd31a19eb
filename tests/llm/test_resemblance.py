import random

import numpy as np

from platterlake.llm import resemblance as r
from platterlake.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The components of rows, each a list of their numbers."""
    found = [sets(x[1]) for x in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            both = a | found[j]
            if len(a & found[j]) * 5 >= 4 * len(both):
                root[top(i)] = top(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def edited():
    """Texts with chains of copies, each of one or two words changed in the one before it or in the first."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**5)}"
    rows = []
    for g in range(40):
        first = [word() for _ in range(rnd.randrange(40, 200))]
        last = first
        rows.append(first)
        for k in range(g % 7):
            new = list(last if k % 2 else first)
            for _ in range(rnd.randrange(1, 4)):
                new[rnd.randrange(len(new))] = word()
            rows.append(new)
            last = new
    rows = [" ".join(x) for x in rows] + ["A b C", "a B c", "one", None, "", " "]
    rnd.shuffle(rows)
    return [(i, x, "en") for i, x in enumerate(rows)]


def test_survivors_against_brute_force(spark):
    rows = edited()
    want = sorted(min(rows[i][0] for i in g) for g in brute(rows))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = r.survivors(docs)
    assert found.columns == docs.columns
    found = sorted(found.collect(), key=lambda x: x.doc_id)
    assert [x.doc_id for x in found] == want and all(tuple(x) == rows[x.doc_id] for x in found)
    assert simhash.survivors(docs).count() > len(want)  # two bits of a fingerprint do not reach them


def test_edited_copy_goes_in_the_pipeline(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:50], "other", *words[51:]]), "en"), (3, " ".join([*words[:50], *"abcdefghijklmnopqrst", *words[70:]]), "en")]
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [1, 3]


def test_no_documents(spark):
    assert r.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_an_id_with_different_texts_stay(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(30))
    rows = [(7, text(), "en") for _ in range(20)] + [(k, text(), "en") for k in range(20, 50)] + [(None, text(), "en") for _ in range(5)]
    again = [(7, rows[0][1], "en"), (3, rows[1][1], "en"), (None, rows[25][1], "en")]
    want = sorted([*rows[:1], again[1], *rows[2:]], key=str)
    docs = spark.createDataFrame(rows + again, SCHEMA)
    assert sorted(map(tuple, r.survivors(docs).collect()), key=str) == want
    assert sorted(map(tuple, simhash.survivors(docs).collect()), key=str) == want


def test_copies_that_are_not_alike_enough_give_few_pairs(spark):
    rnd, rows = random.Random(12), []
    base = [f"w{i}" for i in range(60)]
    for k in range(400):
        text = list(base)
        text[rnd.randrange(10, 50)], text[rnd.randrange(10, 50)] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(text), "en"))
    made = []
    real = r.across
    try:
        r.across = lambda *a: made.append(real(*a)) or made[-1]
        found = sorted(x.doc_id for x in r.survivors(spark.createDataFrame(rows, SCHEMA)).collect())
    finally:
        r.across = real
    assert found == sorted(min(rows[i][0] for i in g) for g in brute(rows))
    assert sum(m.count() for m in made) < 400 * 40  # of 79,800 pairs


def of_similarity_80(rnd, size):
    """Two sets of hashes that share 8 of their 9 parts."""
    part = max(1, size // 9)
    found = np.array([rnd.getrandbits(64) for _ in range(10 * part)], np.uint64)
    return found[: 9 * part], found[part:]


def test_sets_of_similarity_80_meet_in_the_balls_of_some_block():
    rnd, shared = random.Random(6), []
    for size in [9] * 150 + [45] * 150 + [270] * 100:
        a, b = (simhash.wide(x) for x in of_similarity_80(rnd, size))
        keys = [simhash.variants(m[None], 0, simhash.BLOCKS)[0] for m in (a, b)]
        assert len(keys[0]) == 16 * simhash.BLOCKS == len(set(keys[0]))
        met = np.intersect1d(*keys) >> simhash.WIDTH
        assert len(met)
        shared.append(len(set(met.tolist())) / simhash.BLOCKS)
        differ = sum((x ^ y).bit_count() for x, y in zip(simhash.screen(a), simhash.screen(b), strict=True))
        assert differ <= simhash.FAR
    assert 0.26 < sum(shared) / len(shared) < 0.33


def test_variants_flip_up_to_two_of_the_least_decided_bits():
    marks = simhash.wide(np.array([3, 5, 11, 2**63 + 7], np.uint64))
    for block in range(simhash.BLOCKS):
        word, narrow = int(marks[block]), int(marks[simhash.BLOCKS + block])
        assert narrow.bit_count() == simhash.NARROW
        flips = [int(k) ^ (block << simhash.WIDTH | word) for k in simhash.variants(marks[None], block, block + 1)[0]]
        assert sorted(f.bit_count() for f in flips) == [0] + [1] * 5 + [2] * 10 and not any(f & ~narrow for f in flips)


def test_more_hashes_than_are_summed_at_once():
    found = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    total = np.zeros(simhash.BLOCKS * simhash.WIDTH, np.int64)
    for h in found:
        x = (h ^ simhash._XOR) * simhash._TIMES
        x = (x ^ (x >> np.uint64(32))) * simhash._MIX
        b = (x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 4, 2)
        total += np.concatenate([b[:, :, 0].reshape(-1), b[:, :, 1].reshape(-1)])
    bits = (2 * total > 255 * len(found)).reshape(simhash.BLOCKS, simhash.WIDTH)
    assert [int(x) for x in simhash.wide(found)[: simhash.BLOCKS]] == [sum(1 << int(k) for k in np.flatnonzero(r)) for r in bits]


def test_the_stage_gets_its_pairs_by_ball_hashing(spark, monkeypatch):
    import corpus_pipeline

    rows = edited()
    docs = spark.createDataFrame(rows, SCHEMA)
    seen, real = [], simhash.emitted
    monkeypatch.setattr(simhash, "emitted", lambda nodes, first, last: seen.extend(range(first, last)) or real(nodes, first, last))
    found = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert seen == list(range(simhash.BLOCKS)) and found == sorted(min(rows[i][0] for i in g) for g in brute(rows))
    monkeypatch.setattr(simhash, "emitted", lambda nodes, first, last: real(nodes, first, last).limit(0))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len({x[1] or "" for x in rows})


def test_a_large_group_of_near_copies_meets_in_the_first_blocks_only(spark, monkeypatch):
    rnd = random.Random(14)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(500):
        text = list(base)
        for j in range(2 if k % 10 else 1):  # most pairs are not alike, chains of others join them
            text[rnd.randrange(5, 115)] = f"x{k}_{j}"
        rows.append((k, " ".join(text), "en"))
    pairs, real = [], simhash.near
    monkeypatch.setattr(simhash, "near", lambda p, nodes: pairs.append(p.count()) or real(p, nodes))
    found = sorted(x.doc_id for x in r.survivors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted(min(rows[i][0] for i in g) for g in brute(rows))
    assert sum(pairs) < 500 * 60 and max(pairs[2:]) < 500 * 5
