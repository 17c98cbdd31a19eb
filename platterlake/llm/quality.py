"""Quality rules: base limits, then a learned decision list of threshold conjunctions.

Statistics of every whole text are DataFrame expressions. The list is learned by sequential covering from at most
MAX_LABELLED labelled rows (those first in the order of a hash of the id): a rule grows by the threshold of the greatest
information gain on two thirds of them, is pruned on the rest, and is kept only while it is precise there. The rules become
one ordered conditional expression. Only DataFrame functions touch documents; the search over the bounded sample of
statistics runs on the driver.

Defined results: a null text has no words and fails the base limits; a document whose id is null is judged like any other
but never learned from; labels that are null, or that contradict each other for one id, are not learned from, and of an id's
texts only the least; without labels the base limits alone decide; repeated rows are judged row by row; further columns stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm.common import SPACE, read, table

MAX_LABELLED = 20_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 48
MIN_PRECISION, MIN_COVERED = 0.9, 4
GRAM = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words")
_P = "__platterlake_"


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and, under names of the prefix, the counts of every text."""
    c = lambda name: F.col(_P + name)
    body = F.coalesce(F.col(text), F.lit(""))
    chars = lambda pattern: F.char_length(F.regexp_replace(body, pattern, "")).cast("long")
    one = docs.select(
        "*",
        F.array_remove(F.split(body, SPACE + "+"), "").alias(_P + "words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(_P + "lines"),
        chars(rf"[^{SYMBOLS}]+").alias(_P + "n_symbols"), chars(r"[^\p{Lu}]+").alias(_P + "n_upper"),
        chars(r"[^0-9]+").alias(_P + "n_digits"), chars(r"[^!-/:-@\[-`{-~]+").alias(_P + "n_marks"),
    )
    n = F.size(c("words"))
    gram = lambda i: F.struct(F.xxhash64(*(F.get(c("words"), i + k) for k in range(GRAM))).alias("h"), i.cast("long").alias("at"))
    two = one.select("*", n.cast("long").alias(_P + "n_words"))
    # a gram's whole hash and its place: sorting brings equal grams together
    three = two.withColumn(_P + "grams", F.when(n >= GRAM, F.sort_array(F.transform(F.sequence(F.lit(0), n - GRAM), gram))).otherwise(F.array().cast("array<struct<h:bigint,at:bigint>>")))
    again = lambda x, i: F.coalesce(x["h"] == F.get(c("grams"), i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(c("grams"), i + 1)["h"], F.lit(False))
    four = three.withColumn(_P + "repeats", F.sort_array(F.transform(F.filter(c("grams"), again), lambda x: x["at"])))
    zero = F.lit(0).cast("long")
    step = lambda a, p: F.struct((a["n"] + p + GRAM - F.greatest(p, a["end"])).alias("n"), (p + GRAM).alias("end"))
    covered = F.aggregate(c("repeats"), F.struct(zero.alias("n"), zero.alias("end")), step, lambda a: a["n"])
    five = four.select(
        *docs.columns, *(c(x) for x in ("n_words", "n_symbols", "n_upper", "n_digits", "n_marks")),
        F.char_length(F.array_join(c("words"), "")).cast("long").alias(_P + "word_chars"),
        F.size(c("lines")).cast("long").alias(_P + "n_lines"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(_P + "n_dup_lines"),
        covered.alias(_P + "n_repeat_words"),
    )
    return five


def base_failed() -> Column:
    return F.expr(f"{_P}n_words < 10 OR 100 * {_P}n_repeat_words > 20 * {_P}n_words")


def features() -> list[Column]:
    """The learned rules' statistics, in the order of FEATURES."""
    share = lambda a, b: F.coalesce(F.col(_P + a) / F.nullif(F.col(_P + b), F.lit(0)), F.lit(0.0))
    pairs = (("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_marks", "word_chars"), ("n_words", "n_lines"))
    return [F.col(_P + "n_words").cast("double"), *(share(a, b) for a, b in pairs)]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    limit: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.limit:g}"

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.limit if self.above else x[:, self.feature] <= self.limit


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and y.any() and not y.all():
        before, best = math.log2(y.mean()), (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, THRESHOLDS)))
            values = np.unique(np.concatenate([values, np.quantile(x[y, f], np.linspace(0, 1, THRESHOLDS))]))
            order = np.argsort(x[:, f], kind="stable")
            ranked, hits = x[order, f], np.concatenate([[0], np.cumsum(y[order])])
            for above in (True, False):
                at = np.searchsorted(ranked, values, "left" if above else "right")
                p, n = (hits[-1] - hits[at], len(y) - at) if above else (hits[at], at)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - before), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(f, above, float(values[k])))
        if best[1] is None:
            break
        rule.append(_centred(best[1], x))
        inside = best[1].holds(x)
        x, y = x[inside], y[inside]
    return tuple(rule)


def _centred(c: Condition, x: np.ndarray) -> Condition:
    """The condition with its limit halfway to the next value that it excludes, so rows not seen fall on the nearer side."""
    out = x[~c.holds(x), c.feature]
    if not len(out):
        return c
    return Condition(c.feature, c.above, float((c.limit + (out.max() if c.above else out.min())) / 2))


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules, each a conjunction that marks a document as bad. Rows must come in an arbitrary but fixed order."""
    held = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < MAX_RULES:
        g, p = left & ~held, left & held
        rule = _grow(x[g], bad[g])
        if not rule:
            break

        def worth(r: Rule, p=p) -> float:
            got = _holds(r, x[p])
            return (2 * bad[p][got].sum() - got.sum()) / max(1, got.sum())

        rule = max((rule[:n] for n in range(len(rule), 0, -1)), key=worth)
        hit = _holds(rule, x) & left
        seen = hit & held
        if hit.sum() < MIN_COVERED or bad[hit].mean() < MIN_PRECISION or (seen.any() and bad[seen].mean() < MIN_PRECISION) or not seen.any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """Whether the list keeps a document, as one ordered conditional expression over with_counts' columns."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> list[Rule]:
    """Rules from labels (doc_id, quality: 1 good, 0 bad) of at most MAX_LABELLED documents that pass the base limits."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    order = F.xxhash64("key", F.lit(11))
    chosen = known.select(F.col("doc_id").alias("key"), "q").orderBy(order, "key").limit(MAX_LABELLED)
    chosen = table(chosen, "labelled")  # at most MAX_LABELLED rows of two numbers: small enough to broadcast
    rows = docs.select(F.col("doc_id").alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "q").agg(F.min("text").alias("text"))
    counted = table(with_counts(rows).select("key", "q", base_failed().alias("failed"), F.array(*features()).alias("x")), "statistics")
    found = counted.where("NOT failed").orderBy(order, "key").collect()
    if not found:
        return []
    return learn(np.array([r.x for r in found]), np.array([r.q == 0 for r in found]))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs, their counts, base_failed and kept, the new columns under names of the prefix."""
    return with_counts(docs, text).withColumn(_P + "base_failed", base_failed()).withColumn(_P + "kept", ~F.col(_P + "base_failed") & decision_list(rules))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    # the row number keeps the filter above the projections: pushed below them, it would spell out the counts again and again
    found = judged(docs, fit(docs, labels, text), text).withColumn(_P + "row", F.monotonically_increasing_id())
    return found.where(F.col(_P + "kept") & (F.col(_P + "row") >= 0)).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", *(F.col(_P + c).alias(c) for c in (*COUNTS, "base_failed", "kept")))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
