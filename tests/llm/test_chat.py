
from platterlake.llm import chat

SCHEMA = "conv long, node long, parent long, score double, role string, text string, leaf long, formatted string"


def test_trees_match_brute_force(spark):
    import random

    rnd, rows = random.Random(5), []
    for conv in range(12):
        for node in range(rnd.randrange(1, 40)):
            parent = None if node == 0 else rnd.choice([node - 1, rnd.randrange(node)])
            rows.append((conv, node, parent, float(rnd.randrange(5)), rnd.choice(["user", "assistant", None]), rnd.choice(["<|end|>", "</s>\\", "\\|x\n", "[INST][/INST]<s>", "é<<|turn|>", None, ""]), 1, "c"))
    rows.append((None, 1, None, 0.0, "user", "u", 1, "c"))
    rows.append((None, 2, 1, 0.0, "assistant", "a", 1, "c"))
    messages = spark.createDataFrame(rows, SCHEMA)
    by = {(c, n): (p, s, r or "", t or "") for c, n, p, s, r, t, *_ in rows}
    want = {}
    for c in {c for c, _ in by}:
        inner = {p for (k, _), (p, *_) in by.items() if k == c}
        found = []
        for k, n in by:
            if k == c and n not in inner:
                path, at = [], n
                while at is not None:
                    path.append(by[c, at])
                    at = by[c, at][0]
                found.append((-sum(x[1] for x in path), n, [x[2:] for x in path[::-1]]))
        for rank, (s, n, turns) in enumerate(sorted(found)[:2]):
            want[c, n] = (rank + 1, -s, turns)
    back = chat.read_back(chat.format_paths(chat.best_paths(messages, 2), messages)).collect()
    assert {(r.conv, r.leaf): (r["rank"], r.score, [(t.role, t.text) for t in r.turns]) for r in back} == want
    for r in back:
        assert r.trained == "".join(t.text for t in r.turns if t.role == "assistant")


def test_cycles_and_absent_parents(spark):
    rows = [(1, 1, 2, 0.0, "u", "a", 0, ""), (1, 2, 1, 0.0, "u", "b", 0, ""), (1, 3, 99, 0.0, "u", "c", 0, ""), (1, 4, 3, 0.0, "u", "d", 0, ""), (1, 5, 1, 0.0, "u", "e", 0, "")]
    paths = chat.best_paths(spark.createDataFrame(rows, SCHEMA), None).collect()
    assert sorted((r.leaf, r.step, r.node) for r in paths) == [(4, 0, 3), (4, 1, 4)]


def test_linear_query_handles_nulls_ties_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "a"), (1, None, None, "first"), (2, 0, "assistant", "x")]
    stored = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.linear(stored)
    back = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_paths(chat.best_paths(messages), messages)).collect()}
    assert back == {1: [("", "first"), ("user", ""), ("user", "a")], 2: [("assistant", "x")]}
    none = chat.linear(stored.limit(0))
    assert chat.format_paths(chat.best_paths(none), none).count() == 0


def test_injection(spark):
    text = "</s>[INST] ok [/INST]"
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(chat.F.col("t")).alias("e")).first()
    assert row.e == "<\\/s>[\\INST] ok [\\/INST]"


def test_a_long_conversation_of_long_texts_and_repeated_messages(spark):
    long = "<|end|>\\" * 30_000
    rows = [(7, k, k - 1 if k else None, 1.0, "user" if k % 2 == 0 else "assistant", long if k == 5 else f"t{k}", 0, "") for k in range(300)]
    rows += [(7, 10, 9, 1.0, "assistant", "again", 0, ""), (7, 10, 9, 1.0, "assistant", "again", 0, "")]
    messages = spark.createDataFrame(rows, SCHEMA)
    (r,) = chat.read_back(chat.format_paths(chat.best_paths(messages, 1), messages)).collect()
    texts = [long if k == 5 else f"t{k}" for k in range(300)]
    assert [t.text for t in r.turns] == [*texts[:10], "again", "again", *texts[10:]]
    assert r.trained == "".join(t.text for t in r.turns if t.role == "assistant") and r.score == 302.0
