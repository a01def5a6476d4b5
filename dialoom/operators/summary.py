"""Aggregates over verdicts: totals, stages, groups, reasons, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(df: DataFrame, passed: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"), F.round(F.try_divide(F.count_if(passed), F.count("*")), 4).alias("pass_rate"))


def stages(df: DataFrame, names: Sequence[str], failed: str = "stages_failed", skipped: str = "stages_skipped") -> DataFrame:
    """stage, n_pass, n_fail, n_skip: each row counted once for each stage, in one pass."""
    state = [F.struct(F.lit(s).alias("stage"), F.array_contains(failed, s).alias("f"), F.array_contains(skipped, s).alias("k")) for s in names]
    return df.select(F.explode(F.array(*state)).alias("s")).groupBy("s.stage").agg(F.count_if(~F.col("s.f") & ~F.col("s.k")).alias("n_pass"), F.count_if("s.f").alias("n_fail"), F.count_if(F.col("s.k") & ~F.col("s.f")).alias("n_skip"))


def groups(df: DataFrame, by: Sequence[str], passed: Column) -> DataFrame:
    """dim, value, n, n_passed, pass_rate for each column of `by` (missing: ?), by grouping sets."""
    named = df.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")).alias(c) for c in by], passed.alias("_ok"))
    dim = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in by))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c)) for c in by))
    sets = named.groupingSets([[F.col(c)] for c in by], *map(F.col, by))
    return sets.agg(dim.alias("dim"), value.alias("value"), F.count("*").alias("n"), F.count_if("_ok").alias("n_passed"), F.round(F.avg(F.col("_ok").cast("int")), 4).alias("pass_rate")).select("dim", "value", "n", "n_passed", "pass_rate")


def reasons(df: DataFrame, by_stage: str = "reasons", cap: int = 110) -> DataFrame:
    """stage, reason (cut), n of a map stage -> reasons."""
    return df.select(F.explode(by_stage).alias("stage", "r")).select("stage", F.explode("r").alias("reason")).groupBy("stage", F.left("reason", F.lit(cap)).alias("reason")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """bin, n for every whole number from low to high, zero bins kept, and as far beyond as there are values."""
    n = df.select(value.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    least, most = n.agg(F.min("bin"), F.max("bin")).first()
    bins = df.sparkSession.range(min(low, low if least is None else least), max(high, high if most is None else most) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def judge_means(df: DataFrame, dims: Sequence[str], model: str = "model") -> DataFrame:
    """model, dim, mean, n: the mean of each dimension by each model, of those it scored; one aggregate over the rows as they are."""
    sums = df.groupBy(model).agg(*[F.struct(F.lit(d).alias("dim"), F.round(F.avg(d), 2).alias("mean"), F.count(d).alias("n")).alias(d) for d in dims])
    return sums.select(model, F.explode(F.array(*dims)).alias("x")).select(model, "x.*")


def split_strata(df: DataFrame, strata: Sequence[str], split: str = "split") -> DataFrame:
    return df.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "val").alias("n_val"))


def shrink(df: DataFrame, before: Column, after: Column) -> DataFrame:
    b, a = F.sum(F.octet_length(before)), F.sum(F.octet_length(after))
    return df.agg(F.count("*").alias("n"), b.alias("bytes_before"), a.alias("bytes_after"), F.round(100 * F.try_divide(a, b), 1).alias("percent"))
