"""Storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one in local mode only, where that is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="dialoom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage replaced by files in the shared folder; Spark removes them with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dialoom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: columnar, and without the partitioning that df had. packed: its bytes are compressed already."""
    df.write.options(**{"compression": "uncompressed"} if packed else {}).parquet(path := new_path(df.sparkSession, name))
    scratch(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that stored() and scratch() have made and that are still there.
MADE: list[str] = []


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends, if nothing deletes it before."""
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    MADE.append(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders that no frame will read any more."""
    for path in paths:
        fs, at = _at(spark, path)
        fs.delete(at, True)
        MADE.remove(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of results that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()
