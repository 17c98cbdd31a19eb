import random
import zlib
from collections import Counter, defaultdict

from platterlake.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string, slot string"


def test_sizes_groups_and_slots(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["a", "bb", "É"], k=rnd.randrange(1, 400))) for _ in range(400)]
    texts += [t for t in texts[:30] for _ in range(rnd.randrange(1, 5))] + ["hot " * 40] * 60
    rows = [(i if i % 50 else None, t, "c", "c", "c") for i, t in enumerate(texts)] + [(7, None, "", "", ""), (7, None, "", "", ""), (8, "", "", "", "")]
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = Counter(zlib.crc32(t.encode()) for t in texts)
    whole = [len(homes[c]) == 1 for c, n in copies.items() if 1 < n < 20]
    assert sum(whole) >= 0.8 * len(whole)


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text of the group", "", "", "") for i in range(200)] + [(i, f"text {i} " * 3, "", "", "") for i in range(200, 300)]
    loads = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 4


def test_groups_stay_whole_where_every_document_has_a_copy(spark):
    rows = [(i, f"text {i % 2000} " * (5 + i % 2000 % 7), "", "", "") for i in range(4000)]
    loads, homes = Counter(), defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect():
        loads[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 4
    assert sum(len(h) == 1 for h in homes.values()) >= 0.8 * len(homes)


def test_admission_respects_the_capacity():
    share = sharding.admitted({(0, 1): 50.0, (2, 1): 50.0, (1, 0): 10.0}, [60.0, 80.0, 60.0], 100.0)
    assert abs(share[1] - 0.3) < 1e-6 and share[0] == 1.0


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    rows = [(0, "é" * 2_000_000, "", "", "")] + [(i, f"text {i} " * 200, "", "", "") for i in range(1, 300)]
    found = {r.doc_id: r for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert found[0]["size"] == 4_000_001 and found[0].text_crc32 == zlib.crc32(("é" * 2_000_000).encode())
    loads = Counter()
    for r in found.values():
        loads[r.shard] += r["size"]
    assert len(found) == 300 and loads[found[0].shard] < 4_000_001 + 0.25 * 300 * 2000
