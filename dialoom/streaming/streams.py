"""Streaming forms: file source, deduplication, windowed rates, stalls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def first_seen(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rates(df: DataFrame, time: str, width: str, late: str, by: str, bad: str) -> DataFrame:
    """Tumbling windows: rows and bad rows."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.count_if(F.expr(bad)).alias("n_bad"))


def stalls(df: DataFrame, key: str, time: str, progress: str, gap_s: int, throttle_s: int) -> DataFrame:
    """An alert when a key's progress has not changed for gap_s seconds of event time, at most one each throttle_s."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, since, told = state.get if state.exists else (None, None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("t").itertuples():
            now = row.t.timestamp()
            if value is None or row.v != value:
                value, since = row.v, now
            elif now - since > gap_s and (told is None or now - told >= throttle_s):
                out.append((k[0], row.t, float(now - since)))
                told = now
        state.update((value, since, told))
        yield pd.DataFrame(out, columns=["key", "at", "stalled_s"])

    flat = df.select(F.col(key).cast("string").alias("key"), F.col(time).alias("t"), F.col(progress).cast("double").alias("v"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, stalled_s double", "value double, since double, told double", "append", GroupStateTimeout.NoTimeout)


def append(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """An append sink; exactly once by its checkpoint."""
    return df.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").start(path)
