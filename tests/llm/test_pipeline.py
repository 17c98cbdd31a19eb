import random

import pytest

import corpus_pipeline as c
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute as brute_components
from tests.llm.test_suffixes import brute as brute_removals

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, root = random.Random(31), str(tmp_path_factory.mktemp("tables"))
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    make = lambda n: rnd.choices(words, k=n)
    bench, passage, docs, labels = [(i, " ".join(make(30))) for i in range(5)], make(90), [], []
    for i in range(120):
        text = make(rnd.randrange(20, 250))
        if i % 10 == 0:
            text = [w + "###" for w in text]
        if i % 7 == 1:
            text[5:5] = bench[i % 5][1].split()
        if i % 11 == 2:
            text[8:8] = passage
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 10 != 0), 0))
        if i % 12 == 5:
            docs.append((1000 + i, docs[-1][1]))
    docs += [(2000, None), (2001, ""), (None, " ".join(make(50)))]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return root, rows, bench


def test_stages_against_brute_force(spark, tables):
    root, rows, bench = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    good = c.quality_rules(spark, docs, root)
    assert good.columns == docs.columns
    want = []
    for r in rows:
        n, _, _, _, repeats = brute_counts(r[1])
        if n >= 10 and 100 * repeats <= 20 * n and "###" not in r[1]:
            want.append(r)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(want, key=str)
    unique = c.near_duplicates(spark, good, root)
    assert unique.columns == docs.columns
    least = {(k, x) for k, _, x in brute_components([(r[0], r[1], "") for r in want])}
    want = [r for r in want if r[0] is None or (r[0], r[0]) in least]
    assert sorted(map(tuple, unique.collect()), key=str) == sorted(want, key=str)
    single = c.repeated_passages(spark, unique, root)
    assert single.columns == docs.columns
    found = brute_removals([r[1] for r in want], 400)
    assert any(f[1] for f in found)
    left = {r.doc_id: r.text for r in single.collect()}
    for r, (size, gone, *_) in zip(want, found):
        assert len(left[r[0]].encode()) == size - gone
    clean = c.benchmark_passages(spark, single, root)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    hits = {d: h for d, _, h, _ in brute_hits([(d, t) for d, t in left.items()], bench)}
    assert any(hits.values()) and all(kept[d] == t for d, t in left.items() if not hits[d])
    assert not any(h for _, _, h, _ in brute_hits(list(kept.items()), bench))
    pieces = c.packed(spark, clean, root).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    for d in kept:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == d)
        assert sum(n for _, n in own) == next(p.doc_tokens for p in pieces if p.doc_id == d)


def test_run_gives_the_last_stage(spark, tables):
    root, *_ = tables
    assert c.run(spark, root).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_columns_with_clashing_names_and_repeated_ids(spark, tables):
    root, rows, _ = tables
    names = ["doc_id", "text", "h", "node", "key", "n_words", "uid", "tid", "first", "copies"]
    twice = [*rows, *[(r[0], r[1]) for r in rows[:9]], (rows[20][0], "another text of the same id " + " ".join(f"q{k}" for k in range(40)))]
    docs = spark.createDataFrame([(r[0], r[1], *["c"] * 8) for r in twice], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names[2:])]))
    kept = len(twice)
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == names
        assert 0 < docs.count() <= kept
        kept = docs.count()
    assert "another text of the same id" in " ".join(r.text or "" for r in docs.collect())
    assert {p.doc_id for p in c.STAGES[-1][1](spark, docs, root).collect()} == {r.doc_id for r in docs.collect()}
