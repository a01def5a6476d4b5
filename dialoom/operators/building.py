"""Gold sets and training files: reference texts, call transport, counters, seed choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import order_key


def rubric(origin: Column, destination: Column, providers: Column, lang: Column) -> Column:
    """Known facts, in order, joined by "; "."""
    fact = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("; ", fact("origin", origin), fact("destination", destination), fact("providers", F.concat_ws(", ", providers)), fact("answer language", lang))


def transported(calls: Column) -> Column:
    """Arguments as JSON text in every call, whatever structure they have."""
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments")))


def top_places(results: Column, k: int) -> Column:
    """The first k results with what training needs of them."""
    return F.transform(F.slice(results, 1, k), lambda r: F.struct(r["name"].alias("name"), F.round(r["meters"] / 1000, 1).alias("km"), F.round(r["seconds"] / 60).cast("long").alias("minutes")))


def multi_call_steps(calls: DataFrame, item: str, step: str) -> DataFrame:
    return calls.groupBy(item, step).agg(F.count("*").alias("n")).where("n > 1").groupBy(item).agg(F.count("*").alias("n_multi"))


def token_counters(df: DataFrame, tokens: Column, cap: int, least_kept: float = 0.7) -> DataFrame:
    """Rows, tokens, tokens kept under the cap, rows cut, and rows dropped because too little of them would stay."""
    kept = F.least(tokens, F.lit(cap))
    return df.agg(F.count("*").alias("n"), F.sum(tokens).alias("n_tokens"), F.sum(kept).alias("n_kept"), F.count_if(tokens > cap).alias("n_cut"), F.count_if(kept < least_kept * tokens).alias("n_dropped"))


def source_counters(df: DataFrame, passed: Column, id_col: str, source: str) -> DataFrame:
    """Per source: rows read, failed, without id, repeated (after the filter), kept."""
    ok = df.withColumn("_ok", passed).withColumn("_rn", F.when(F.col("_ok") & F.col(id_col).isNotNull(), F.row_number().over(Window.partitionBy("_ok", id_col).orderBy(source))))
    return ok.groupBy(source).agg(F.count("*").alias("n_read"), F.count_if(~F.col("_ok")).alias("n_failed"), F.count_if(F.col("_ok") & F.col(id_col).isNull()).alias("n_no_id"), F.count_if(F.col("_rn") > 1).alias("n_repeated"), F.count_if(F.col("_rn") == 1).alias("n_kept"))


def pick_seed(items: DataFrame, seeds: DataFrame, lang: str, seed: int = 42) -> DataFrame:
    """items(id, lang) each with a seed of its language, or any if there is none; by hash, the pools numbered once."""
    w = Window.partitionBy("s_lang").orderBy(order_key(seed, "seed_id"), "seed_id")
    both = seeds.select("seed_id", F.col(lang).alias("s_lang")).unionByName(seeds.select("seed_id", F.lit("*").alias("s_lang")))
    pool = both.withColumn("s_rn", F.row_number().over(w) - 1)
    size = pool.groupBy(F.col("s_lang").alias("z_lang")).agg(F.count("*").alias("z_n"))
    named = items.join(size, F.col(lang) == F.col("z_lang"), "left").withColumn("pool", F.coalesce("z_lang", F.lit("*"))).drop("z_lang", "z_n")
    sized = named.join(size, F.col("pool") == F.col("z_lang"))
    at = F.conv(F.substring(order_key(seed, "id"), 1, 13), 16, 10).cast("long") % F.col("z_n")
    return sized.withColumn("at", at).join(pool, (F.col("pool") == F.col("s_lang")) & (F.col("at") == F.col("s_rn"))).select("id", lang, "seed_id")


def category_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)
