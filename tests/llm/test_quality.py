import random
import re
from collections import Counter

import numpy as np

from platterlake.llm import quality as q

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            covered |= set(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e " * 2, "x " * 5000, "é\U0001f600 | <b> *\n\n \nq\nq\r\nq"]
    for _ in range(60):
        texts.append("".join(rnd.choice(["a", "b", "é", "|"]) + rnd.choice([" ", "  ", "\n", "\t"]) for _ in range(rnd.randrange(120))))
    docs = spark.createDataFrame([(i if i % 9 else None, t, "c", "c") for i, t in enumerate(texts)] * 2, SCHEMA)
    found = q.judged(docs, []).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        want = brute(r.text)
        assert tuple(r[q._P + c] for c in q.COUNTS) == want
        assert r[q._P + "base_failed"] == r[q._P + "base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r[q._P + "kept"] == (not r[q._P + "base_failed"])


def test_grams_whose_hashes_share_44_bits_are_not_repeats(spark):
    # "a b c d v11104121" and "a b c d v7364856" have equal low 44 bits of xxhash64, all that a text of 2**19 words had left
    words = "a b c d v11104121".split() + [f"x{i}" for i in range(1 << 19)] + "a b c d v7364856".split()
    docs = spark.createDataFrame([(1, " ".join(words), "c", "c")], SCHEMA)
    assert q.with_counts(docs).select(q._P + "n_repeat_words").first()[0] == 0


def test_list_learns_a_conjunction_and_ignores_noise():
    rnd = np.random.default_rng(3)
    x = rnd.random((3000, len(q.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] < 0.3)
    rules = q.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= q._holds(r, x)
    assert rules and (hit == bad).mean() > 0.98
    assert not q.learn(x, rnd.random(3000) < 0.2)


def test_the_expression_is_the_list(spark):
    rnd = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["Aa", "b1", "c!", "d$", "e\nf", "g"], int(rnd.integers(1, 60)))), "c", "c") for i in range(200)], SCHEMA)
    rows = q.with_counts(docs).select("doc_id", q.F.array(*q.features()).alias("x")).collect()
    x = np.array([r.x for r in rows])
    for _ in range(6):
        rules = [tuple(q.Condition(int(f), bool(rnd.integers(2)), float(rnd.choice(x[:, f]))) for f in rnd.integers(0, x.shape[1], int(rnd.integers(1, 4)))) for _ in range(3)]
        kept = {r.doc_id: r.k for r in q.with_counts(docs).select("doc_id", q.decision_list(rules).alias("k")).collect()}
        bad = np.any([q._holds(r, x) for r in rules], axis=0)
        assert [kept[r.doc_id] for r in rows] == (~bad).tolist()


def test_of_an_ids_texts_the_least_is_learned_from(spark):
    docs = spark.createDataFrame([(1, "z " * 20, "c", "c"), (1, "a b c d e f g h i j k", "c", "c"), (2, "m n o p q r s t u v w", "c", "c")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert q.fit(docs, labels) == q.fit(docs.orderBy(q.F.desc("text")).coalesce(1), labels)


def test_filter_keeps_clean_rows_and_all_columns(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        w = [f"w{rnd.randrange(5000)}" for _ in range(40)]
        docs.append((i, " ".join(x + "###" for x in w) if i % 6 == 0 else " ".join(w), "c", "c"))
        labels.append((i, int(i % 6 != 0), 0))
    d = spark.createDataFrame([*docs, (None, None, "c", "c"), (301, "", "c", "c")], SCHEMA)
    lab = spark.createDataFrame([*labels, (5, 0, 0), (7, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 6]
    assert q.keep_good(d.limit(0), lab.limit(0)).count() == 0
