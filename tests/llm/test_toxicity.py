import math
import random
import zlib

import numpy as np
import xxhash

from platterlake.llm import toxicity as t

DOCS, LABELS = "doc_id long, text string, score double, y int", "doc_id long, toxic int, quality int"


def test_learns_a_pair_that_neither_term_shows():
    rnd = random.Random(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rnd.random() < 0.3, rnd.random() < 0.3
        terms = rnd.choices([f"w{i}" for i in range(40)], k=6) + ["insult"] * a + ["group"] * b
        rows.append(t.slots(" ".join(terms).encode()))
        y.append(float(a and b))
    machine = t.train(rows, np.array(y, np.float32))
    score = lambda s: machine.score(t.slots(s.encode()))
    assert score("w1 w2 insult group") > 0.5 > max(score("w1 w2 insult"), score("w1 w2 group"), score(""))


def test_learns_a_group_term_that_is_neutral_by_itself():
    rnd = random.Random(5)
    rows, y = [], []
    for _ in range(4000):
        a, b, g = rnd.random() < 0.2, rnd.random() < 0.2, rnd.random() < 0.5
        terms = rnd.choices([f"w{i}" for i in range(200)], k=12) + ["insult"] * a + ["other"] * b + ["group"] * g
        rows.append(t.slots(" ".join(terms).encode()))
        y.append(float((a and g) or (b and not g)))
    y = np.array(y, np.float32)
    slot = t.slots(b"group")[0]
    seen, toxic = sum(slot in r for r in rows), sum(slot in r for r, x in zip(rows, y) if x)
    assert abs(toxic - seen * y.mean()) < t.MIN_Z * (seen * y.mean() * (1 - y.mean())) ** 0.5
    machine = t.train(rows[:3000], y[:3000])
    found = np.array([machine.score(r) >= 0.5 for r in rows[3000:]])
    assert found[y[3000:] == 1].mean() > 0.9 and found[y[3000:] == 0].mean() < 0.02


def test_whole_tables(spark):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        docs.append((i, " ".join(rnd.choices([f"w{k}" for k in range(300)], k=50) + (["Scum!"] if bad else [])), 0.0, 1))
        labels.append((i, int(bad), 1))
    docs += [(None, "scum", 0.0, 1), (None, None, 0.0, 1), (700, "", 0.0, 1), (700, "", 0.0, 1), (800, "w1 " * 50_000 + "scum", 0.0, 1)]
    labels += [(None, 1, 1), (700, None, 0), (3, 1, 1)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    machine = t.fit(d, lab)
    found = d.select("doc_id", "text", t.held_out(d.doc_id).alias("h"), t.scores(d, machine).alias("s")).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.s <= 1 and (r.s >= 0.5) == ("scum" in (r.text or "").lower())


def plain_score(machine, text):
    """The machine's formula, pair by pair."""
    terms = set("".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() and c < "\x80" or c >= "\x80" else " " for c in text or "").encode().split())
    slots = sorted({xxhash.xxh64_intdigest(w) % t.SLOTS for w in terms} & set(np.flatnonzero(machine.known).tolist()))
    z = machine.bias + sum(float(machine.weights[i]) for i in slots)
    z += sum(float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for k, i in enumerate(slots) for j in slots[:k])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_are_the_formula(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["Scum", "group!", "é", "plain", "x1", "ÀB"], k=rnd.randrange(9))) for _ in range(200)]
    machine = t.train([t.slots(x.encode()) for x in texts], np.array([float("Scum" in x and "group" in x) for x in texts], np.float32))
    docs = spark.createDataFrame([(i, x, 0.0, 1) for i, x in enumerate([*texts, None])], DOCS)
    for r in docs.select("text", t.scores(docs, machine).alias("s")).collect():
        assert abs(r.s - plain_score(machine, r.text)) < 1e-4


def test_the_least_text_of_an_id_is_learned_from_and_terms_are_bounded(spark, monkeypatch):
    docs = [(i, f"w{k} w{i % 7}", 0.0, 1) for i in range(1, 60) for k in range(3)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i % 7 == 0), 1) for i in range(1, 60)], LABELS)
    one, two = t.fit(d, lab), t.fit(d.orderBy(d.text.desc()).coalesce(1), lab)
    assert (one.weights == two.weights).all() and one.known.sum() <= 9
    monkeypatch.setattr(t, "MAX_SLOTS_HELD", 20)
    assert t.fit(d, lab).known.sum() < one.known.sum() + 1


def test_no_labels_and_empty_tables(spark):
    none, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert t.fit(none, lab) is None
    one = spark.createDataFrame([(1, "a", 0.0, 1)], DOCS)
    assert one.select(t.scores(one, None).alias("s")).first().s == 0.0
