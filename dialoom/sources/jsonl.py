"""JSON-lines sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_line"


def read_tolerant(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of all lines; a line that is no JSON object keeps its text in _bad_line and has nulls else. Blank lines are skipped."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(list(paths) if not isinstance(paths, str) else paths)


def good(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNull()).drop(BAD)


def bad_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_lines"), F.count(BAD).alias("n_bad"))


def read_strict(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """A bad line is an error when rows are read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths) if not isinstance(paths, str) else paths)


def read_numbered(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """src_file, src_line (from 1, blank lines counted) and row (a struct, null for a bad line). Each file is one task's."""
    files = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True)
    lines = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("src_file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("src_file", (F.col("at") + 1).alias("src_line"), F.from_json("line", schema).alias("row"))


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def union_in_order(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, missing columns null, with source_ord for precedence."""
    out = frames[0].withColumn("source_ord", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("source_ord", F.lit(i)), allowMissingColumns=True)
    return out


def write(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def markdown(summary: dict[str, DataFrame], top: int = 25) -> str:
    """A report of small aggregates, a table for each, `top` rows at most."""
    out = []
    for title, df in summary.items():
        rows = df.limit(top).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
