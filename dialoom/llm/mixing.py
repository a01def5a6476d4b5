"""Mixing sources to target weights with hash thresholds; DataFrame operations only.

A document's place in its source is a 60-bit hash of its id and text. A source that must give t of its n words
takes floor(t / n) copies of every document and one more of those below a hash threshold. The threshold comes from
nested histograms: words by source and hash bucket, then only the bucket in which the budget ends is looked at
again in finer buckets, twice. No document is sorted, and rows are summed before they are shuffled, so a source
with a third of all rows is no larger than another. The last document taken is the one that brings the source
nearest to its target.

Weights go round over the sources in code point order, null last. Targets share budget * all words by weight; none
may pass max_repeats times its source's words, and what is over is shared again by weight among the others.

Defined results: a null text has size 0; a source of no words has target 0; documents that are equal in id and text
are taken alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, stored

#: Bits of the nested histograms.
LEVELS = (12, 24, 24)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc: Column, text: Column, seed: int) -> Column:
    """60 bits, the same for every run and every engine: of an md5, so that SQL can follow."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """rank of each source from 0, in code point order, null last, over range partitions."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["no_source", "source"]
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    done = cut(sources.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), "part": part}))
    # one row a partition
    before = done.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return done.join(F.broadcast(before), "part").select("no_source", "source", "source_size", (F.col("before") + F.col("at")).alias("rank"))


def targets(sizes: DataFrame, weights: Sequence[int], budget: float, max_repeats: int) -> DataFrame:
    """no_source, source, source_size and target. sizes has no_source, source and size of each document."""
    by = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut(_ranked(by).select("no_source", "source", "source_size", weight.alias("weight"), (max_repeats * F.col("source_size")).alias("most")))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * budget
    # each round fixes the sources whose share is above their most; sums only come to the driver
    fixed, free, full = 0, s.agg(F.sum("weight")).first()[0] or 0, F.lit(False)
    level = (total, free)
    while free:
        over = F.col("most") * level[1] < level[0] * F.col("weight")
        got = s.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (got[0], got[1]) == (fixed, free) or not got[1]:
            fixed, free = got[0], got[1]
            break
        fixed, free = got[0], got[1]
        level = (total - fixed, free)
    share = F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1] or 1))
    full = F.col("most") * level[1] < level[0] * F.col("weight")
    return s.select("no_source", "source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(F.least(share, F.col("most").cast("double"))).alias("target"))


def _bucket(level: int) -> Column:
    behind = sum(LEVELS[level + 1 :])
    return F.shiftright(F.col("place"), behind).bitwiseAND((1 << LEVELS[level]) - 1)


_KEY = ["no_source", "source"]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["no_source"] == b["no_source"]) & (a["source"] == b["source"])


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with copies (of every document) and below (one more copy where place < below)."""
    goals = stored(
        goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")),
        "mix-goals",
    )
    rows, ends = sizes.where("size > 0"), goals.select(*_KEY, "need", F.lit(0).cast("long").alias("start"))
    run = Window.partitionBy(*_KEY).orderBy("bucket")
    for level in range(len(LEVELS)):
        sums = rows.groupBy(*_KEY, _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        h = sums.withColumn("upto", F.sum("words").over(run))
        h = h.join(ends.select(F.col("no_source").alias("e_no"), F.col("source").alias("e_source"), "need", "start"), (F.col("no_source") == F.col("e_no")) & (F.col("source") == F.col("e_source")))
        # the bucket in which the budget ends: the first whose sum reaches it
        behind = sum(LEVELS[level + 1 :])
        hit = h.where("upto >= need and upto - words < need").select(*_KEY, (F.col("need") - F.col("upto") + F.col("words")).alias("need"), (F.col("start") + F.shiftleft(F.col("bucket"), behind)).alias("start"), "words", F.lit(behind).alias("behind"))
        hit = stored(hit, f"mix-level-{level}")
        edge = hit.select(F.col("no_source").alias("e_no"), F.col("source").alias("e_source"), F.col("start").alias("e_start"))
        if level + 1 < len(LEVELS):
            inside = (F.col("no_source") == F.col("e_no")) & (F.col("source") == F.col("e_source"))
            rows = rows.join(edge, inside).where(F.shiftright("place", behind) == F.shiftright("e_start", behind)).select(*_KEY, "size", "place")
            if not level:
                rows = stored(rows, "mix-edge")
        ends = hit.select(*_KEY, "need", "start")
    # what is left in the last bucket is one document (or equal ones): take it if that is nearer
    last = hit.select(F.col("no_source").alias("e_no"), F.col("source").alias("e_source"), (F.col("start") + F.when(2 * F.col("need") >= F.col("words"), 1).otherwise(0)).alias("below"))
    return goals.join(last, (F.col("no_source") == F.col("e_no")) & (F.col("source") == F.col("e_source")), "left").select(*_KEY, "source_size", "target", "copies", F.coalesce("below", F.lit(0).cast("long")).alias("below"))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    s = F.col(source_col).cast("string")
    return df.select(s.isNull().alias("no_source"), F.coalesce(s, F.lit("")).alias("source"), F.col(id_col).alias("doc_id"), size_of(F.col(text_col)).alias("size"), place_of(F.col(id_col), F.col(text_col), seed).alias("place"))


def plan(df: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, max_repeats: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sized documents and the sources' thresholds."""
    sizes = cut(_keyed(df, id_col, text_col, source_col, seed))
    return sizes, stored(thresholds(sizes.select(*_KEY, "size", "place"), targets(sizes, weights, budget, max_repeats)), "mix-plan")


def _copies() -> Column:
    return F.col("copies") + (F.col("place") < F.col("below")).cast("int")


def taken(df: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    sizes, goals = plan(df, **how)
    g = goals.select(F.col("no_source").alias("e_no"), F.col("source").alias("e_source"), "source_size", "target", "copies", "below")
    return sizes.join(g, (F.col("no_source") == F.col("e_no")) & (F.col("source") == F.col("e_source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def apply(df: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """df, all columns, each document as often as the mix takes it; documents of no words go."""
    _, goals = plan(df, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    g = goals.select(F.col("no_source").alias("__no"), F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("below").alias("__below"))
    s = df[source_col].cast("string")
    both = df.join(g, (s.isNull() == g["__no"]) & (F.coalesce(s, F.lit("")) == g["__source"]))
    n = F.when(size_of(df[text_col]) > 0, g["__copies"] + (place_of(df[id_col], df[text_col], seed) < g["__below"]).cast("int")).otherwise(0)
    return both.select(*[df[c] for c in df.columns], F.explode(F.array_repeat(F.lit(0), n)).alias("__copy")).drop("__copy")
