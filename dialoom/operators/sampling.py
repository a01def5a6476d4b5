"""Deterministic sampling: rows are ordered by md5(seed:id), so results do not depend on partitions or engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _ranked(df: DataFrame, strata: Sequence[str], seed: int, id_col: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(order_key(seed, id_col), F.col(id_col))))


def stratified_split(df: DataFrame, strata: Sequence[str], ratio: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """df with split: in each stratum of two or more, between 1 and n - 1 rows, about ratio * n, are val."""
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    k = F.when(F.col("_n") >= 2, F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0).cast("long")), F.col("_n") - 1)).otherwise(0)
    return _ranked(df, strata, seed, id_col).join(n, list(strata)).withColumn("split", F.when(F.col("_rn") <= k, "val").otherwise("train")).drop("_rn", "_n")


def proportional(df: DataFrame, strata: Sequence[str], n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """round(n * share) rows of each stratum, cut to n by the same order only if there are more."""
    total = df.count()
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    quota = F.bround(F.lit(n) * F.col("_n") / F.lit(max(total, 1)), 0).cast("long")
    return _ranked(df, strata, seed, id_col).join(sizes, list(strata)).where(F.col("_rn") <= quota).drop("_rn", "_n").orderBy(order_key(seed, id_col), id_col).limit(n)


def first_by_hash(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """n rows in hash order; Spark keeps n rows a task, no full sort."""
    return df.orderBy(order_key(seed, id_col), id_col).limit(n)


def mixed(train: DataFrame, pool: DataFrame, share: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """train and round(share * its rows) rows of the pool."""
    n = round(train.count() * share)
    return train.withColumn("origin", F.lit("train")).unionByName(first_by_hash(pool, n, seed + 1, id_col).withColumn("origin", F.lit("general")), allowMissingColumns=True)


def uniform(seed: int, id_col: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the order key."""
    return F.conv(F.substring(order_key(seed, id_col), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_choice(seed: int, id_col: str, weights: Sequence[tuple[str, float]]) -> Column:
    total, upto = sum(w for _, w in weights), 0.0
    u, out = uniform(seed, id_col), None
    for name, w in weights:
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(weights[-1][0])


def capability_sample(tools: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """tools(name, capability null for others): one tool of each capability, then others up to n, by name."""
    key = order_key(seed, "name")
    core = tools.where("capability is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("capability").orderBy(key, "name"))).where("_rn = 1").drop("_rn")
    rest = tools.join(core.select("name"), "name", "left_anti")
    first = core.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1)))
    return first.orderBy("_o", key, "name").limit(n).drop("_o").orderBy("name")


def round_robin(df: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """plan: names in turn, by order. Meant for plans of a size that one task can number."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    return df.withColumn("plan", F.element_at(F.array(*map(F.lit, names)), (F.pmod(at, F.lit(len(names))) + 1).cast("int")))


def replicated(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """n copies of each row, ids with -d0, -d1, ..."""
    return df.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit("-d"), "_d")).drop("_d")
