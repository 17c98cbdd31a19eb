"""Tables in the folder the cluster shares, connected components, and small helpers of the operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.shipping import ship
from platterlake.staging import checkpoint_dir

#: ASCII white space, as the contracts of the word-based operators name it.
SPACE = r"[\x20\x09-\x0D]"
BATCH, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys of some tens of bytes that may be broadcast.
MAX_BROADCAST = 500_000
#: Rows of two numbers that make a file worth writing.
FILE_ROWS = 100_000
_RUN = uuid.uuid4().hex[:12]
_kept: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> None:
    """Send the package, and let Python see BATCH rows at a time where the session does not say otherwise: ten thousand texts, or
    sets of their shingles, would take hundreds of megabytes in the JVM and in the worker."""
    ship(spark)
    if spark.conf.get(BATCH_SETTING) == "10000":  # Spark's own value
        spark.conf.set(BATCH_SETTING, BATCH)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the table: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{checkpoint_dir(spark)}/platterlake-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._platterlake_path = path
    return out


def as_table(df: DataFrame, name: str) -> DataFrame:
    """df where it is a table already, else a table of it."""
    return df if getattr(df, "_platterlake_path", None) in _kept else table(df, name)


def drop(*tables: DataFrame) -> None:
    """Delete tables that no frame still to be computed reads."""
    for df in tables:
        path = getattr(df, "_platterlake_path", None)
        if path and _kept.pop(path, None) is not None:
            _delete(df.sparkSession, path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s frame as a table; all other tables that were written on the way to it are dropped."""
    before = set(_kept)
    out = table(make(), name)
    for path in set(_kept) - before - {out._platterlake_path}:
        _delete(_kept.pop(path), path)
    return out


@contextmanager
def tidy(spark: SparkSession):
    """Within it, every execution deletes its shuffles as it ends, not when the driver's memory is next collected."""
    before = spark.conf.get(TIDY_SETTING, None)
    spark.conf.set(TIDY_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY_SETTING) if before is None else spark.conf.set(TIDY_SETTING, before)


def drop_all() -> None:
    """Delete every table that table() wrote; call it once the results have been written."""
    while _kept:
        path, spark = _kept.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_all)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """df as a table with a number of its own for every row, so that repeated rows stay apart."""
    return table(df.withColumn(column, F.monotonically_increasing_id()), name)


def only(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows that have (left_semi), or have not (left_anti), a key of the table keys, whose columns they share.

    Up to MAX_BROADCAST keys are sent to the rows, so that wide rows stay where they are; more are joined by a shuffle.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys, keys.columns, how)


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(7)))).first())


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: two columns of longs. Returns (node, label), label the smallest node reachable, for every node with an edge
    to another one. Each step is written as a table before it is joined, so both join sides are exchanged by the join
    alone and adaptive execution can split a hub's partition. The number of rounds is logarithmic in the longest path.
    """
    a, b = edges.columns
    e = table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    now = _state(e)
    while now[0]:
        few = lambda df, n=now[0]: df.coalesce(n // FILE_ROWS + 1)  # noqa: E731  no step has more than twice the edges' rows
        both = e.union(e.select("v", "u"))
        low = table(few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "low")
        big = table(few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "big")
        low2 = table(few(big.groupBy("u").agg(F.min("v").alias("m"))), "low")
        pairs = big.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = table(few(pairs.union(low2.select("u", F.col("m").alias("v"))).distinct()), "small")
        then = _state(small)
        drop(e, low, big, low2)
        e = small
        if then == now:
            break
        now = then
    return table(e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct()).coalesce(now[0] // FILE_ROWS + 1), "labels")
