"""Sharding by balanced label propagation.

Documents are linked by a group (equal texts); the label of a document is its shard. Labels start from a hash. In every
round a join gives each linked document the shard that holds most bytes of its group, and it moves there under a quota:
from the bytes that ask to go from each shard to each other one (a table of shards x shards) the driver sets the share that
each shard admits without passing its capacity. A group is admitted or refused as one, unless it exceeds LUMP of a shard's
capacity: then each of its documents is. Unlinked documents, which cut nothing, fill what is left; a few more rounds move
shares of them from full to free shards, and at most EXCHANGE rows of every shard are moved or swapped singly at the end.

Law `bytes`: the shards' sizes, in UTF-8 bytes plus one for each document, are near equal. Slots number a shard's rows from
0 without gaps; they are counted in buckets, never in one task for a shard.

Defined results: a null text has no bytes and no group; crc32 of a null text is that of no bytes; rows that repeat a doc_id
are sharded as rows of their own and, if their texts are equal, linked; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import drop, numbered, read, table

SHARDS, ROUNDS, FILL_ROUNDS = 16, 4, 3
LUMP, SLACK = 0.05, 0.01
EXCHANGE, BUCKET_ROWS = 64, 2000
_UNIT = 1 << 30


def _chance(*key) -> Column:
    """A number in [0, 1) that hangs on the key."""
    return F.pmod(F.xxhash64(*key), F.lit(_UNIT)) / F.lit(float(_UNIT))


def _by_shard(values: list[float], shard: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values)), shard)


def _draw(weights: list[float], chance: Column) -> Column:
    """The shard on which a number in [0, 1) falls when shards share that range by weight."""
    total = sum(weights) or 1.0
    at, out, last = 0.0, None, max(range(len(weights)), key=lambda s: weights[s])
    for s, w in enumerate(weights):
        at += w / total
        if w > 0:
            out = F.when(chance < at, F.lit(s)) if out is None else out.when(chance < at, F.lit(s))
    return F.lit(last) if out is None else out.otherwise(F.lit(last))


def _loads(rows: DataFrame, shards: int) -> list[float]:
    found = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [float(found.get(s, 0)) for s in range(shards)]


def admitted(moves: dict[tuple[int, int], float], loads: list[float], capacity: float) -> list[float]:
    """The share of its wanted inflow that each shard admits, so that none passes the capacity once others have left it."""
    share = [1.0] * len(loads)
    for _ in range(50):
        worst = 0.0
        for t in range(len(loads)):
            inflow = sum(b for (a, c), b in moves.items() if c == t and a != t)
            outflow = sum(b * share[c] for (a, c), b in moves.items() if a == t and c != t)
            fits = 1.0 if not inflow else min(1.0, max(0.0, (capacity - loads[t] + outflow) / inflow))
            worst, share[t] = max(worst, abs(share[t] - fits)), fits
        if worst < 1e-9:
            break
    return share


def propagate(linked: DataFrame, capacity: float, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """linked: a table with uid, grp, size and shard. The same with its shards after the rounds."""
    for k in range(rounds):
        tally = table(linked.groupBy("grp", "shard").agg(F.sum("size").alias("held")), "tally")
        best = F.max_by("shard", F.struct("held", F.xxhash64("grp", "shard", F.lit(k)).alias("tie")))
        want = table(tally.groupBy("grp").agg(best.alias("want"), F.sum("held").alias("total")), "want")
        asked = tally.join(want, "grp").groupBy("shard", "want").agg(F.sum("held").alias("b")).collect()  # shards x shards rows
        moves = {(r["shard"], r["want"]): float(r["b"]) for r in asked}
        share = admitted(moves, _loads(linked, shards), capacity)
        if not any(a != t and share[t] > 0 for a, t in moves):
            drop(tally, want)
            break
        lump = F.col("total") > LUMP * capacity
        chance = F.when(lump, _chance("uid", F.lit(k))).otherwise(_chance("grp", F.lit(k)))
        moved = linked.join(want, "grp").withColumn("shard", F.when(chance < _by_shard(share, F.col("want")), F.col("want")).otherwise(F.col("shard")))
        after = table(moved.select(*linked.columns), "moved")
        drop(tally, want)
        linked = after
    return linked


def _exchanges(rows: list[tuple[int, int, int]], loads: list[float]) -> dict[int, int]:
    """rows: (uid, size, shard) that may move. New shards of some, which bring the loads closer together."""
    here = [dict() for _ in loads]
    for uid, size, shard in rows:
        here[shard][uid] = size
    out = {}
    for _ in range(40 * len(loads)):
        hi, lo = max(range(len(loads)), key=lambda s: loads[s]), min(range(len(loads)), key=lambda s: loads[s])
        gap = loads[hi] - loads[lo]
        options = [(abs(gap - 2 * (a - b)), u, v) for u, a in here[hi].items() for v, b in [(None, 0), *here[lo].items()] if 0 < a - b < gap]
        if not options:
            break
        _, u, v = min(options, key=lambda o: (o[0], o[1], -1 if o[2] is None else o[2]))
        a, b = here[hi].pop(u), here[lo].pop(v) if v is not None else 0
        here[lo][u], out[u] = a, lo
        if v is not None:
            here[hi][v], out[v] = b, hi
        loads[hi], loads[lo] = loads[hi] - a + b, loads[lo] + a - b
    return out


def _slots(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """rows and slot, gapless in every shard."""
    buckets = max(1, -(-count // (shards * BUCKET_ROWS)))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(buckets)))
    sizes = table(placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    starts = table(sizes.select("shard", "bucket", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS UNBOUNDED PRECEDING) - n").alias("first")), "starts")
    ranked = placed.withColumn("slot", F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY uid) - 1"))
    return ranked.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("slot") + F.col("first")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for every row of docs, linked by equal texts."""
    data = F.coalesce(F.col(text), F.lit(""))
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(F.col(text), 256)).alias("grp")), "documents", "uid")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    capacity = (total or 0) / shards
    groups = table(rows.where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "groups")
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = table(rows.join(groups, "grp", "left_semi").withColumn("shard", start), "linked")
    linked = propagate(linked, capacity * (1 + SLACK), shards)  # room to move in where linked rows are nearly all; the excess goes below
    # a shard that moves have overfilled gives up the share of its linked rows that is too much: whole groups, then, of what
    # remains, rows
    totals = table(linked.groupBy("grp").agg((F.sum("size") > LUMP * capacity).alias("lump")), "totals")
    linked = linked.join(totals, "grp")
    for salt, whole in ((101, True), (103, False)):
        loads = _loads(linked, shards)
        excess = [max(0.0, (x - capacity) / x) if x else 0.0 for x in loads]
        if max(excess) < 1e-9:
            break
        who = lambda k, whole=whole: F.when(F.lit(whole) & ~F.col("lump"), _chance("grp", F.lit(k))).otherwise(_chance("uid", F.lit(k)))
        moved = F.when(who(salt) < _by_shard(excess, F.col("shard")), _draw([max(0.0, capacity - x) for x in loads], who(salt + 1)))
        linked = table(linked.withColumn("shard", moved.otherwise(F.col("shard"))), "trimmed")
    weights = [max(0.0, capacity - x) for x in _loads(linked, shards)]
    free = rows.join(groups, "grp", "left_anti").withColumn("shard", _draw(weights, _chance("uid", F.lit(102))))
    columns = ["uid", "doc_id", "size", "text_crc32", "shard", "free"]
    placed = table(linked.withColumn("free", F.lit(False)).select(*columns).unionByName(free.withColumn("free", F.lit(True)).select(*columns)), "placed")
    for k in range(FILL_ROUNDS):
        loads, loose = _loads(placed, shards), _loads(placed.where("free"), shards)
        leave = [min(1.0, max(0.0, x - capacity) / y) if y else 0.0 for x, y in zip(loads, loose, strict=True)]
        chance, again = _chance("uid", F.lit(200 + k)), _chance("uid", F.lit(300 + k))
        moved = F.when(F.col("free") & (chance < _by_shard(leave, F.col("shard"))), _draw([max(0.0, capacity - x) for x in loads], again)).otherwise(F.col("shard"))
        after = table(placed.withColumn("shard", moved), "placed")
        drop(placed)
        placed = after
    few = placed.withColumn("k", F.expr("row_number() OVER (PARTITION BY shard ORDER BY free DESC, xxhash64(uid, 7), uid)")).where(F.col("k") <= EXCHANGE)
    chosen = [(r["uid"], r["size"], r["shard"]) for r in few.select("uid", "size", "shard").collect()]  # at most EXCHANGE rows of a shard
    if swaps := _exchanges(chosen, _loads(placed, shards)):
        found = F.create_map(*(F.lit(x) for u, s in swaps.items() for x in (u, s)))
        placed = placed.withColumn("shard", F.coalesce(F.element_at(found, F.col("uid")), F.col("shard")))
    placed = table(placed, "shards")
    return _slots(placed, count, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
