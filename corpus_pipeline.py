"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Stages that write tables on the way end in
one of their own and drop the others at once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platterlake.llm import decontamination, packing, quality, resemblance, suffixes
from platterlake.llm.common import as_table, drop, finished, read

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or a learned rule go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word similarity of 0.8 or more the document with the smallest id stays."""
    return finished(lambda: resemblance.survivors(docs), "near-duplicates")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes, or of over 50 words, that occur twice go, and documents of which no word is left."""
    return finished(lambda: suffixes.remove_repeats(docs), "repeated-passages")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows go, and documents of which no word is left."""
    return decontamination.remove_spans(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of a packed sequence."""
    return packing.pack(packing.tokenized(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("packing", packed)]

#: Components of near-duplicates and suffix sorting are not expressed in SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, as_table(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
