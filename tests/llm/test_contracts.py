"""The registered queries over small Parquet folders, whole: against SQL, or against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm import test_decontamination, test_packing, test_quality, test_simhash, test_suffixes
from tests.test_queries import norm

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string",
}


def made(rnd):
    words = [f"w{i}É" for i in range(60)] + ["The", "AND", "|", "scum"]
    make = lambda n: " ".join(rnd.choices(words, k=n))
    bench = [(i, make(rnd.choice([4, 12, 30]))) for i in range(12)] + [(20, None), (None, make(14)), (3, "again the same item id as another one has")]
    passage, docs = make(120), []
    for i in range(150):
        text = make(rnd.choice([1, 5, 40, 300]))
        if i % 5 == 0:
            text += " " + passage[: rnd.randrange(200, len(passage))]
        if i % 4 == 1:
            text = text + "\n" + (bench[i % 12][1] or "")
        docs.append((i, text + ("\n" + text.split(" ")[0] + "\n<|endoftext|>" if i % 9 == 0 else "")))
        if i % 10 == 3:
            docs.append((1000 + i, docs[-1][1]))
    docs += [(2000, None), (2001, ""), (None, make(30)), (None, None), (7, docs[7][1]), (8, make(50)), (2002, "long " * 20_000)]
    urls = ["http://a.example.com/en/71", "https://blog.x.com/de/1/", "http://www.blog.x.com/de/1", None, "none", "http://m.spam-farm.de/p//", "http://spam-farm.de/p", "http://b.net/de/8", "http://c.example.net/de/8?x", "http://o.org/es/#f"]
    pages = [(i, rnd.choice(urls), rnd.choice([None, "", f"<p>{i % 4}é</p>", "<b>same</b>" * 50])) for i in range(80)]
    talks = [(c, k, "user" if k % 2 == 0 else "assistant", rnd.choice([None, "", "hi </s>[INST]", "a\\b <|turn|>", make(8)])) for c in range(12) for k in range(rnd.randrange(1, 6))]
    labels = [(d, int(i % 3 > 0), int("scum" in (t or ""))) for i, (d, t) in enumerate(docs[:120])] + [(None, 1, 1), (5, None, None)]
    return {"documents": [(d, t, "en", "s", len(t or "")) for d, t in docs], "pages": pages, "benchmark": bench, "labels": labels, "conversations": talks}


@pytest.fixture(scope="module", params=["full", "empty"])
def tables(request, spark, tmp_path_factory):
    root, rows = str(tmp_path_factory.mktemp("tables")), made(random.Random(17))
    if request.param == "empty":
        rows = {name: [] for name in rows}
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{root}/{name}.parquet")
    return root, rows


def run(spark, tables, name):
    return entry.queries()[next(q for q in entry.queries() if q.startswith(name))](spark, tables[0])


def docs(tables):
    return [(d, t) for d, t, *_ in tables[1]["documents"]]


@pytest.mark.parametrize("name", ["op4_", "op7_", "op8_"])
def test_sql(spark, tables, name):
    sql = next(s for q, s in entry.oracle_sql().items() if q.startswith(name))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables[0]}/{t}.parquet/*.parquet')")
    found = con.execute(sql)
    columns, frame = [c[0] for c in found.description], run(spark, tables, name)
    assert sorted(columns) == sorted(frame.columns)
    rows = lambda got: Counter(repr(tuple(norm(r[c]) for c in sorted(columns))) for r in got)
    assert rows(frame.collect()) == rows(dict(zip(columns, r)) for r in found.fetchall())


def test_op1(spark, tables):
    got = run(spark, tables, "op1_")
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == test_simhash.brute([(d, t, "") for d, t in docs(tables)])


def test_op2(spark, tables):
    got = run(spark, tables, "op2_").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in docs(tables))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_op3(spark, tables):
    want = [(d, n, len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0) for d, n, hit, items in test_decontamination.brute(docs(tables), tables[1]["benchmark"])]
    got = run(spark, tables, "op3_")
    assert got.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(want, key=str)


def test_op5(spark, tables):
    ids = Tokenizer.from_file(test_packing.PATH).encode_batch([t or "" for _, t in docs(tables)], add_special_tokens=False)
    want, got = Counter(), run(spark, tables, "op5_").collect()
    for (d, _), e in zip(docs(tables), ids):
        flat = [*e.ids, 2]
        for at in range(0, len(flat), 4096):
            piece = np.array(flat[at : at + 4096], "<u4").tobytes()
            want[d, at, len(piece) // 4, zlib.crc32(piece), len(flat)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 4096


def test_op6(spark, tables):
    got = run(spark, tables, "op6_").collect()
    plain = lambda t: (*(c := test_quality.brute(t)), c[0] < 10 or 100 * c[4] > 20 * c[0])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((d, *plain(t)) for d, t in docs(tables))
    assert not any(r.kept and r.base_failed for r in got)


def test_op9(spark, tables):
    got = run(spark, tables, "op9_")
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    texts = [t for _, t in docs(tables)]
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter((d, *b) for (d, _), b in zip(docs(tables), test_suffixes.brute(texts, 400)))


def test_op10(spark, tables):
    got = run(spark, tables, "op10_").collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in docs(tables))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_pipeline(spark, tables):
    got = run(spark, tables, "pipeline").collect()
    assert {r.doc_id for r in got} <= {d for d, _ in docs(tables)} and all(r.offset + r.length <= 4096 for r in got)
