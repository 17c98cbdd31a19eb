"""Streams: samples of progress, late data, and files that arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files as they are put into a folder; the checkpoint resumes where an upload stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in tumbling windows; events later than the watermark are dropped."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events without those that were delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rolling(events: DataFrame, key: str, seconds: float = 10, least: float = 0.25) -> DataFrame:
    """(key, ts, stage, bytes, rate) of samples (key, ts, stage, bytes): the rate over the window, from state kept for each key.

    A new stage or a falling counter empties the state. Samples of a key must arrive in order across batches.
    """

    def each(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, stage = ([], None) if not state.exists else (list(zip(state.get[0], state.get[1], strict=True)), state.get[2])
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, now, count in zip(rows["ts"], rows["stage"], rows["bytes"], strict=True):
            t = ts.timestamp()
            if now != stage or (held and count < held[-1][1]):
                held, stage = [], now
            held = [h for h in held if t - h[0] <= seconds] + [(t, count)]
            span = t - held[0][0]
            out.append((keys[0], ts, now, count, (count - held[0][1]) / span if len(held) >= 2 and span >= least else None))
        state.update(([h[0] for h in held], [h[1] for h in held], stage))
        yield pd.DataFrame(out, columns=["key", "ts", "stage", "bytes", "rate"])

    kind = dict(events.dtypes)[key]
    samples = events.select(F.col(key).alias("key"), "ts", "stage", "bytes")
    return samples.groupBy("key").applyInPandasWithState(each, f"key {kind}, ts timestamp, stage string, bytes long, rate double", "t array<double>, b array<long>, stage string", "append", "NoTimeout")
