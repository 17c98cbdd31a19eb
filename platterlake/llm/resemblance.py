"""Near-duplicates by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Pairs are found by ball hashing of SimHashes (simhash.py): every distinct text has a wide fingerprint of its set of shingles, whose
blocks emit variants; the variants are shuffled, and texts that share one meet. Two texts of similarity 0.8 meet nowhere with a
probability of about 2e-5, and more alike ones with less. Texts that meet are compared by the Hamming distance of four blocks, and what
passes by their whole sets of shingles (64-bit hashes): each with each where at most FEW share a variant; where more do, each
with that text which meets most others, since copies were made of it. What these links join needs no more pairs: the blocks are
taken in ROUNDS, and after each only texts of different components are still paired. Texts whose larger groups still hold two
components after a round are held: two of them are paired no more in later rounds, since in the end all pairs of held texts across
components are found by an exact filter: in the order of shingles by their frequency among these texts, rare ones first, the first
shingle that two alike sets share must leave enough places behind it in both. So a large group, of texts that are alike or only
nearly so, meets as single texts in the first blocks alone.

Defined results: words are lower-cased in ASCII; a text of up to five words is one shingle; null and wordless texts are alike;
of each component one row stays, that with the smallest non-null id, and of several such rows any one.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.llm import simhash
from platterlake.llm.common import MAX_BROADCAST, connected, drop, numbered, only, table, tidy

WORDS, SEED = 5, 42
#: Texts of one key that are compared each with each.
FEW = 8
#: First and last block, and one more, of those whose variants are shuffled at once: eight at most bound the disk that shuffles take.
ROUNDS = ((0, 3), (3, 8), (8, 16), (16, 24), (24, 32))
#: Of texts u and v with n and m shingles: they can be alike, no links join them yet, and they are not both held.
OPEN = "5 * least(n, m) >= 4 * greatest(n, m) and root != other and not (held and hold)"
UID = "__platterlake_uid"
SKETCH = "n long, screen_a long, screen_b long, marks binary"


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-WORDS])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :] or ends[-1:], strict=True)], np.uint64))


def _sketch(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    marks = [simhash.wide(s) for s in sets]
    a, b = zip(*(simhash.screen(m) for m in marks), strict=True) if marks else ((), ())
    return pd.DataFrame({"n": [len(s) for s in sets], "screen_a": a, "screen_b": b, "marks": [m.tobytes() for m in marks]})


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, not repeating anything, have a similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def ends(pairs: DataFrame) -> DataFrame:
    """A table of the nodes of the pairs (u, v)."""
    return table(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "wanted")


def hashed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """A table (node, hashes) of the texts of the table wanted."""
    return table(only(texts, wanted).select("node", F.pandas_udf(_sets, "array<long>")("text").alias("hashes")), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that are alike."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return table(both.where(F.pandas_udf(_alike, "boolean")("a", "b")).select("u", "v"), "links")


def across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """open_: (node, n, root) of texts; sets: (node, hashes). Pairs (u, v) of different roots, among them all that are alike.

    Of shingles that one text alone has, only their number counts. Two sets of similarity 0.8 share 4/9 of their sizes' sum,
    so the first shared shingle has at least that many places from itself to the end in either order; later shared ones have
    fewer, so a pair that comes out at all comes out by its first one.
    """
    tokens = only(sets, table(open_.select("node"), "wanted")).join(open_, "node").select("node", "n", "root", F.explode("hashes").alias("h"))
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = tokens.join(common, "h").groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("t"))
    alone = (F.col("n") - F.size("t")).cast("int")
    room = (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int") - alone  # places that any partner's size allows
    places = ranked.where(room > 0).select("node", "n", "root", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), room)).alias("k", "x"))
    postings = table(places.select(F.col("x.h").alias("h"), "node", "root", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("rest")), "postings")
    other = postings.select("h", F.col("node").alias("o"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("rest").alias("left"))
    near = postings.join(other, "h").where((F.col("root") < F.col("other")) & (9 * F.least("rest", "left") >= 4 * (F.col("n") + F.col("m"))))
    return near.select(F.least("node", "o").alias("u"), F.greatest("node", "o").alias("v"))


def mixed(rows: DataFrame, root=None) -> DataFrame:
    """The rows (key, root, ...) of the keys that hold several roots."""
    root = F.col("root") if root is None else root
    keys = rows.groupBy("key").agg(F.min(root).alias("a"), F.max(root).alias("b")).where("a < b").select("key")
    return rows.join(keys, "key")


def met(nodes: DataFrame, rooted: DataFrame, tried: list[DataFrame], first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Of the blocks first to last - 1, a table of the near pairs (u, v) of different roots that none of the tables tried holds, and
    one of the rows of keys with more than FEW nodes, not all held or of one root. rooted: a table (node, n, root, held) of all nodes."""
    entries = simhash.emitted(nodes, first, last)
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("u"), F.max("node").alias("v"))
    keys = table(counts.where("c > 1"), "keys")
    more = keys.where("c > 2").select("key", "c")
    more = F.broadcast(more) if more.count() <= MAX_BROADCAST else more
    groups = table(entries.join(more, "key").join(rooted, "node").select("key", "node", "n", "root", "held", "c"), "groups")
    u, v = ("u", "n", "root", "held"), ("v", "m", "other", "hold")
    pairs = [keys.where("c = 2").select("u", "v").join(rooted.toDF(*u), "u").join(rooted.toDF(*v), "v").where(OPEN)]
    few = groups.where(F.col("c") <= FEW).drop("c")
    pairs.append(few.toDF("key", *u).join(few.toDF("key", *v), "key").where(f"u < v and {OPEN}"))

    # of many texts of one key, pairs with the text that meets most others in such keys, then, of equals, any
    many = table(mixed(groups.where(F.col("c") > FEW), F.when(F.col("held"), -1).otherwise(F.col("root"))), "many")
    degrees = many.groupBy("node").agg(F.sum("c").alias("degree"))
    chosen = F.struct((-F.col("degree")).alias("d"), F.xxhash64("node", F.lit(SEED)).alias("h"))
    centers = many.join(degrees, "node").groupBy("key").agg(F.min_by(F.struct("node", "n", "root", "held"), chosen).alias("c"))
    stars = many.drop("c").toDF("key", *u).join(centers.select("key", "c.*").toDF("key", *v), "key").where(OPEN)
    pairs.append(stars)
    every = reduce(DataFrame.union, (p.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")) for p in pairs)).distinct()
    new = reduce(lambda p, t: p.join(t, ["u", "v"], "left_anti"), tried, every)
    found = table(simhash.near(new, nodes), "pairs")
    drop(keys, groups)
    return found, many


def labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes with a root: their label, or else themselves."""
    return nodes.withColumn("root", F.col("node")) if labels is None else nodes.join(labels.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def joined(links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """The labels (node, label) with what the links (u, v) join besides."""
    if links.isEmpty():
        return labels
    return connected(links if labels is None else links.union(labels))


def components(nodes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """nodes: (node, n, screen_a, screen_b, marks); texts: (node, text) of them and others. (node, label) for every node that is
    like another; None if there are none."""
    labels, tried = None, []
    with tidy(nodes.sparkSession):
        held = table(nodes.select("node").limit(0), "held")
        for first, last in ROUNDS:
            marked = nodes.select("node", "n").join(held.withColumn("held", F.lit(True)), "node", "left")
            rooted = table(labelled(marked, labels).select("node", "n", "root", F.coalesce("held", F.lit(False)).alias("held")), "rooted")
            pairs, many = met(nodes, rooted, tried, first, last)
            tried.append(pairs)
            sets = hashed(texts, wanted := ends(pairs))
            links = verified(pairs, sets)
            labels = joined(links, labels)
            before, held = held, table(held.union(mixed(labelled(many.select("key", "node"), labels)).select("node")).distinct(), "held")
            drop(rooted, many, wanted, sets, before)

    if held.isEmpty():
        return labels
    open_ = table(labelled(held.join(nodes.select("node", "n"), "node"), labels).select("node", "n", "root"), "open")
    sets = hashed(texts, held)
    pairs = table(across(open_, sets).distinct(), "pairs")
    return joined(verified(pairs, only(sets, ends(pairs))), labels)


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, of which one of each component stays."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sha, sketch = "__platterlake_sha", "__platterlake_sketch"
    base = numbered(docs.withColumn(sha, F.sha2(raw, 256)).withColumn(sketch, F.pandas_udf(_sketch, SKETCH)(raw)), "documents", UID)
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(UID).alias("uid"))
    nodes = table(base.groupBy(F.col(sha)).agg(F.min(F.struct(row.alias("row"), F.col(sketch).alias("s"))).alias("x")).select(F.col("x.row").alias("row"), F.col("x.row.uid").alias("node"), "x.s.*"), "nodes")
    labels = components(nodes.drop("row"), base.select(F.col(UID).alias("node"), raw.alias("text")))
    rooted = labelled(nodes.select("row", "node"), labels)
    best = rooted.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.uid").alias(UID))
    gone = table(base.select(UID).join(best, UID, "left_anti"), "gone")
    drop(nodes)
    return only(base, gone, "left_anti").select(*docs.columns)
