"""Toxicity: a factorization machine over hashed terms.

A text is the set of its lower-cased terms, hashed into SLOTS slots. The machine adds a weight for every slot and the
inner product of two vectors for every pair, so it learns that two terms together are toxic where neither is alone. It is
trained on at most MAX_LABELLED labelled rows of at most MAX_SLOTS_HELD terms (those first in the order of a hash of the id),
none of them held out, and scores every whole text. Every slot that at least MIN_ROWS rows of the training set have takes part in pairs. It carries a
weight of its own only if the share of toxic rows among them is MIN_Z standard errors or more from that of all. The vectors of
other slots start shorter (WEAK_START) and slower (WEAK_STEPS), so that they learn what many rows show, not what chance gives.
Pairs learn from epoch PAIRS_FROM on, after what a term shows by itself.

Defined results: a null or empty text has no terms and scores the bias; a null id is never held out and never trained on;
labels that are null, or that contradict each other for one id, are not trained on, and of an id's texts only the least;
without labels every score is 0;
repeated rows are scored row by row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import read, table

SLOTS, RANK, MAX_LABELLED, MIN_ROWS, MIN_Z = 1 << 18, 8, 20_000, 4, 3.0
#: Terms of all rows that train the machine together: 64 MB.
MAX_SLOTS_HELD = 1 << 24
EPOCHS, RATE, DECAY, SEED = 8, 0.1, 2e-5, 17
WEAK_START, WEAK_STEPS, PAIRS_FROM = 0.1, 100.0, 2
FOLDS = 5
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MAX_CACHE = 500_000
_slots: dict[bytes, int] = {}


def slots(text: bytes | None) -> np.ndarray:
    """The slots of a text's terms, each once, in order."""
    found = []
    for term in set((text or b"").translate(_TO_TERMS).split()):
        slot = _slots.get(term)
        if slot is None:
            if len(_slots) >= _MAX_CACHE:
                _slots.clear()
            slot = _slots[term] = xxhash.xxh64_intdigest(term) % SLOTS
        found.append(slot)
    return np.unique(np.array(found, np.int32))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # by slot
    factors: np.ndarray  # slot x rank
    known: np.ndarray  # whether a slot takes part

    def score(self, found: np.ndarray) -> float:
        found = found[self.known[found]]
        v = self.factors[found]
        pairs = 0.5 * (np.square(v.sum(0)).sum() - np.square(v).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum() + pairs, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Adaptive gradient descent on the logistic loss, over rows in a fixed random order for each epoch."""
    rnd = np.random.default_rng(SEED)
    seen = np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=SLOTS)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    toxic = np.bincount(np.concatenate([*(r for r, y in zip(rows, labels, strict=True) if y), np.empty(0, np.int32)]), minlength=SLOTS)
    known = seen >= MIN_ROWS
    strong = known & (np.abs(toxic - seen * rate) >= MIN_Z * np.sqrt(seen * rate * (1 - rate)))
    rows = [r[known[r]] for r in rows]
    start = 0.01 * np.where(strong, 1.0, WEAK_START) * known
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(SLOTS, np.float32), (rnd.standard_normal((SLOTS, RANK)) * start[:, None]).astype(np.float32), known)
    w, v = machine.weights, machine.factors
    gw, gv, gb = np.full(SLOTS, 1e-2, np.float32), np.full((SLOTS, RANK), 1e-2, np.float32), 1.0
    gv[~strong] = WEAK_STEPS
    own = strong.astype(np.float32)
    for epoch in range(EPOCHS):
        for k in rnd.permutation(len(rows)):
            found = rows[k]
            part = v[found]
            total = part.sum(0)
            z = machine.bias + w[found].sum() + 0.5 * (np.square(total).sum() - np.square(part).sum())
            g = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k])
            dw = g + DECAY * w[found]
            gw[found] += dw * dw
            w[found] -= own[found] * RATE * dw / np.sqrt(gw[found])
            if epoch >= PAIRS_FROM:
                dv = g * (total - part) + DECAY * part
                gv[found] += dv * dv
                v[found] = part - 0.2 * RATE * dv / np.sqrt(gv[found])
            gb += float(g) ** 2
            machine.bias -= RATE * float(g) / gb**0.5
    return machine


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Machine | None:
    """labels: (doc_id, toxic: 1 or 0)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2")
    order = F.xxhash64("key", F.lit(SEED))
    chosen = table(known.select(F.col("doc_id").alias("key"), "y").orderBy(order, "key").limit(MAX_LABELLED), "labelled")  # small enough to broadcast
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    terms = F.pandas_udf(lambda texts: texts.map(lambda t: slots(t).tobytes()), "binary")
    found, held = [], 0
    for r in rows.select("key", "y", terms(F.col("text").cast("binary")).alias("slots")).orderBy(order, "key").toLocalIterator():
        held += len(r.slots) // 4
        if held > MAX_SLOTS_HELD:
            break
        found.append((np.frombuffer(bytes(r.slots), np.int32), float(r.y)))
    if not found:
        return None
    return train([f for f, _ in found], np.array([y for _, y in found], np.float32))


def scores(docs: DataFrame, machine: Machine | None, text: str = "text"):
    """A column of scores of docs' texts."""
    if machine is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS x (RANK + 1) floats: 9 MB

    def each(texts: pd.Series) -> pd.Series:
        score = shared.value.score
        return pd.Series([score(slots(t)) for t in texts], dtype="float64")

    return F.pandas_udf(each, "double")(docs[text].cast("binary"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = fit(docs, read(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(docs, machine).alias("score"))
    return found.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
