"""A keyed store of tool results, a Parquet table: look up, and add what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(calls: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """calls with ok, error and cached of their key; cached is false where the store has none. The store has one row a key."""
    r = results.select(F.col(key).alias("r_key"), "ok", "error")
    return calls.join(r, F.col(key) == F.col("r_key"), "left").withColumn("cached", F.col("r_key").isNotNull()).drop("r_key")


def missing(calls: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """The distinct keys that the store has not; to be executed once each."""
    return calls.select(key).distinct().join(results.select(key), key, "left_anti")


def compact_route(route: DataFrame) -> DataFrame:
    """Summaries of routes(summary struct<lengthInMeters, travelTimeInSeconds>): kilometres to one place, whole minutes."""
    return route.select("*", F.round(F.col("summary.lengthInMeters") / 1000, 1).alias("distance_km"), F.round(F.col("summary.travelTimeInSeconds") / 60).cast("long").alias("minutes"))
