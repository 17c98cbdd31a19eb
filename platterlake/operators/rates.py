"""Transfer rates over samples, and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, LEAST_SECONDS = 10, 0.25


def rolling_rate(samples: DataFrame, keys: list[str], ts: str, counter: str, stage: str, seconds: float = WINDOW_SECONDS, least: float = LEAST_SECONDS) -> DataFrame:
    """samples and rate: bytes a second over the window, null with fewer than two samples or too short a span.

    A new stage, or a counter that falls, begins a new run of samples.
    """
    order = Window.partitionBy(*keys).orderBy(ts, counter)
    fresh = F.when(F.lag(stage).over(order).eqNullSafe(F.col(stage)) & (F.lag(counter).over(order) <= F.col(counter)), 0).otherwise(1)
    runs = samples.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(order))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    runs = runs.withColumn("__t", micros)
    span = Window.partitionBy(*keys, "run").orderBy("__t").rangeBetween(-int(seconds * 1_000_000), 0)
    elapsed = (F.col("__t") - F.min("__t").over(span)) / 1_000_000
    moved = F.col(counter) - F.min(counter).over(span)
    rate = F.when((F.count(F.lit(1)).over(span) >= 2) & (elapsed >= least), moved / elapsed)
    return runs.withColumn("rate", rate).drop("__fresh", "__t")


def eta_seconds(current: Column, total: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.floor(F.greatest(total - current, F.lit(0)) / rate))
