"""Exact and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import MADE, cut, discard, release, stored

#: Grams put last in the order at most, of those that are in more than so many sets of one text in SAMPLE. Sets a step of a worker.
COMMON, COMMON_DOCS, SAMPLE, SLICE = 1 << 19, 2, 8, 512
#: Sets on a side of a cell, about; hashes that are broadcast at most.
TILE, FEW = 256, 1 << 18


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; rows without a key go. order must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = df
    for k in key:
        known = known.where(F.col(k).isNotNull())
    return known.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def without(df: DataFrame, guard: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the guard list."""
    return df.join(guard.select(on).distinct(), on, "left_anti")


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def profiles(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """id, n (distinct k-grams) and g (one 64-bit k-gram hash a row). Tokens are made once: a lambda binds them."""
    grams = F.transform(F.array(F.regexp_extract_all(F.lower(text_col), F.lit(X.TOKENS), F.lit(0))), lambda t: X.shingles(t, k))[0]
    one = df.select(F.col(id_col).alias("id"), grams.alias("grams"))
    return one.select("id", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram")).where("gram is not null").select("id", "n", F.xxhash64("gram").alias("g"))


def _sets(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """h (the text's hash) and s, the distinct hashes of its k-grams, ascending. Tokens are made once: a lambda binds them."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    made = F.transform(F.array(F.regexp_extract_all(F.lower(text_col), F.lit(X.TOKENS), F.lit(0))), lambda w: F.when(F.size(w) >= k, F.sort_array(F.array_distinct(hashes(w)))))[0]
    return df.select(F.xxhash64(text_col).alias("h"), F.coalesce(made, F.array().cast("array<bigint>")).alias("s"))


def _first_grams(sizes: np.ndarray, values: np.ndarray, known: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and gram of the first n - ceil(n num / den) + 1 of each row's ascending grams, those in known (ascending) behind the others, by rank (from 1)."""
    n = sizes.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        last = np.where(known[at] == values, rank[at], 0)
        values = values[np.argsort(row * (len(known) + 1) + last, kind="stable")]
    first = np.arange(len(values)) - (np.cumsum(n) - n)[row] < (n - (n * num + den - 1) // den + 1)[row]
    return row[first], values[first]


def _prefixes(sets: DataFrame, num: int, den: int, often: np.ndarray) -> DataFrame:
    """g, h and n: a row for each gram of the prefix of each set; n is the size of the whole set. often: grams put last, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(often)
        known, rank = often[by], by + 1
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                row, g = _first_grams(sizes, b.column(1).flatten().to_numpy(zero_copy_only=False), known, rank, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), b.column(0).take(pa.array(row)), pa.array(sizes[row], pa.int32())], ["g", "h", "n"])

    return sets.mapInArrow(rows, "g long, h long, n int")


def _often(texts: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Of a sample of texts, the grams that many of them have in common, COMMON at most, rarest first."""
    part = texts.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    seen = _sets(part, text_col, k).select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > COMMON_DOCS)
    return seen.orderBy(F.desc("n"), "g").limit(COMMON).select("g").toArrow().column(0).to_numpy()[::-1].copy()


def _met(texts: DataFrame, text_col: str, num: int, den: int, k: int) -> DataFrame:
    """g, h, n: the grams of prefixes in which different texts meet."""
    often, w = _often(texts, text_col, k), Window.partitionBy("g")
    release(texts.sparkSession)
    rows = _prefixes(_sets(texts, text_col, k), num, den, often).withColumns({"low": F.min("h").over(w), "high": F.max("h").over(w)})
    return stored(rows.where("low < high").select("g", "h", "n").dropDuplicates(["g", "h"]), "grams-met")


def _candidates(met: DataFrame, num: int, den: int) -> DataFrame:
    """a < b: the texts that meet often enough in their prefixes."""
    side = lambda x: met.select("g", F.col("h").alias(x), F.col("n").alias(f"n{x}"))
    both = side("a").join(side("b"), "g").where("a < b").where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    # behind both prefixes, sets share no more than the rest of that whose prefix ends first
    most = F.count("*") + F.floor((F.greatest("na", "nb") * num + den - 1) / den) - 1
    return stored(both.groupBy("a", "b", "na", "nb").agg(most.alias("most")).where(F.col("most") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b"), "grams-pairs")


def similar_texts(df: DataFrame, text_col: str, least: float, k: int = 5) -> DataFrame:
    """a < b, similarity: the pairs of different texts, by their hashes, whose sets of k-grams have a Jaccard similarity of `least` or more.

    In any one order of all grams, two sets this similar share one of their first n - ceil(least * n) + 1, so only these
    are shuffled and joined. The order is that of the hashes, with the grams that many texts have in common last, the
    most frequent at the end: a list of bounded length, from a sample, and any such list gives the same pairs. Sets stay
    in their rows; those of candidates only are made again and intersected."""
    share = Fraction(str(least))
    num, den = share.numerator, share.denominator
    texts, spark, before = df.select(text_col), df.sparkSession, list(MADE)
    met = _met(texts, text_col, num, den, k)
    release(spark)
    pairs = _candidates(met, num, den)
    discard(spark, [x for x in MADE[:-1] if x not in before])
    release(spark)
    return _verified(pairs, texts, text_col, least, k)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members sets i and j have in common, for each pair of indices."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = times[column] > 1  # only these are shared
    column, row = np.unique(column[more], return_inverse=True)[1], row[more]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - first)), np.float32)
        m[row[a:z], column[a:z] - first] = 1
        both += m @ m.T
    return both[i, j]


def _verified(pairs: DataFrame, texts: DataFrame, text_col: str, least: float, k: int) -> DataFrame:
    """a, b, similarity of the stored pairs of text hashes that are this similar.

    A pair is counted in the cell of the smallest text that is paired with one of both, so that of a group of near
    copies each set is moved about once and not once a pair; large cells are cut in tiles of both sides."""
    low = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).groupBy(F.col("p.x").alias("x")).agg(F.least(F.first("p.x"), F.min("p.y")).alias("low"))
    low = stored(low, "grams-low")
    side = lambda c: low.select(F.col("x").alias(c), F.col("low").alias(f"l{c}"))
    named = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.least("la", "lb").alias("l")), "grams-named")
    tiles = named.select("l", F.explode(F.array("a", "b")).alias("h")).distinct().groupBy("l").agg(F.ceil(F.count("*") / TILE).alias("t"))
    tile = lambda c: F.pmod(F.xxhash64(F.lit(1), c), "t")
    cells = stored(named.join(tiles, "l").select("l", tile("a").alias("i"), tile("b").alias("j"), "a", "b"), "grams-cells")
    release(texts.sparkSession)
    within = cells.select("l", "i", "j", F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted = low.select(F.col("x").alias("wanted"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted  # texts of no pair stay where they are
    once = texts.withColumn("h", F.xxhash64(text_col)).join(wanted, F.col("h") == F.col("wanted"), "left_semi").dropDuplicates(["h"])
    full = within.join(_sets(once, text_col, k), "h").select(F.col("l").alias("cl"), F.col("i").alias("ci"), F.col("j").alias("cj"), "h", "s")

    def count(p: pa.Table, q: pa.Table) -> pa.Table:
        h = q.column("h").to_numpy()
        sets = [x.values.to_numpy() for x in q.column("s")]
        by = np.argsort(h)
        i, j = (by[np.searchsorted(h[by], p.column(c).to_numpy())] for c in ("a", "b"))
        size, both = np.array([len(x) for x in sets], np.int64), _shared(sets, i, j).astype(np.int64)
        share = both / (size[i] + size[j] - both)
        near = share >= least
        return pa.table({"a": p.column("a").filter(pa.array(near)), "b": p.column("b").filter(pa.array(near)), "similarity": pa.array(share[near], pa.float64())})

    return cells.groupBy("l", "i", "j").cogroup(full.groupBy("cl", "ci", "cj")).applyInArrow(count, "a long, b long, similarity double")


def _copies(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id and h (the text's hash) of rows with k tokens or more."""
    token, other = X.TOKENS[:-1], "[^" + X.TOKENS[1:-1]
    some = F.lower(text_col).rlike(f"^{other}*+(?:{token}++{other}++){{{k - 1}}}{token}")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), some.alias("some")).where("some and id is not null").select("id", "h").distinct()


def jaccard_edges(df: DataFrame, id_col: str, text_col: str, least: float, k: int = 5) -> DataFrame:
    """a < b, similarity: all pairs of rows whose sets of k-grams have a Jaccard similarity of `least` or more. Copies are compared once; all their pairs are in the result."""
    rows = cut(_copies(df, id_col, text_col, k))
    side = lambda x: rows.select(F.col("id").alias(x), F.col("h").alias(f"h{x}"))
    near = similar_texts(df, text_col, least, k).select(F.col("a").alias("hx"), F.col("b").alias("hy"), "similarity")
    apart = near.join(side("x"), "hx").join(side("y"), "hy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").where("a < b")
    alike = side("a").join(side("b"), F.col("ha") == F.col("hb")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return apart.unionByName(alike)


def kept_texts(df: DataFrame, id_col: str, text_col: str, least: float, k: int = 5) -> DataFrame:
    """id, kept, sim_max as of greedy() over the edges, without edges between copies: of copies only the first can stay,
    and if it goes, by an earlier kept row, the others do too."""
    rows = cut(_copies(df, id_col, text_col, k))
    first = rows.groupBy("h").agg(F.min("id").alias("id"))
    near = cut(similar_texts(df, text_col, least, k))
    side = lambda x: first.select(F.col("h").alias(f"h{x}"), F.col("id").alias(x))
    both = near.select(F.col("a").alias("hx"), F.col("b").alias("hy"), "similarity").join(side("x"), "hx").join(side("y"), "hy")
    edges = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    stay = cut(greedy(edges, first.select("id")).where("kept").select(F.col("id").alias("k")).join(first, F.col("k") == F.col("id")).select("k", F.col("h").alias("kh")))
    # what each row's text is near to: a kept first row of the same text, or of others
    same = rows.join(stay, F.col("h") == F.col("kh")).where("k < id").select("id", F.lit(1.0).alias("sim"))
    ends = near.select("a", "b", "similarity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    other = ends.join(stay, F.col("b") == F.col("kh")).join(rows, F.col("a") == F.col("h")).where("k < id").select("id", F.col("similarity").alias("sim"))
    gone = same.unionByName(other).groupBy(F.col("id").alias("g")).agg(F.max("sim").alias("sim"))
    return df.select(F.col(id_col).alias("id")).join(gone, F.col("id") == F.col("g"), "left").select("id", F.col("g").isNull().alias("kept"), F.coalesce("sim", F.lit(0.0)).alias("sim_max"))


def greedy(edges: DataFrame, nodes: DataFrame, most_rounds: int = 100) -> DataFrame:
    """The rows that a pass in id order keeps, dropping each that is near an earlier kept one; sim_max is the largest
    similarity to an earlier kept row. Rounds until nothing is open: a row without an open or kept earlier neighbour
    stays, neighbours of kept rows go. nodes(id) are all rows that may stay."""
    both = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    open_e = cut(both.select("a", "b", "similarity"))
    all_e, kept = open_e, None
    touched = state = cut(open_e.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    for _ in range(most_rounds):
        if state.isEmpty():
            break
        free = cut(state.join(open_e.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        kept = free if kept is None else cut(kept.unionByName(free))
        gone = open_e.join(free.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        state = cut(state.join(free, "id", "left_anti").join(gone, "id", "left_anti"))
        alive = state.select("id")
        open_e = cut(open_e.join(alive.select(F.col("id").alias("a")), "a", "left_semi").join(alive.select(F.col("id").alias("b")), "b", "left_semi"))
    else:
        raise RuntimeError("more rounds needed")
    if kept is None:
        return nodes.select("id", F.lit(True).alias("kept"), F.lit(0.0).alias("sim_max"))
    sims = all_e.join(kept.select(F.col("id").alias("a")), "a", "left_semi").groupBy("b").agg(F.max("similarity").alias("sim"))
    out = nodes.join(touched.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left").join(kept.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left").join(sims, F.col("id") == F.col("b"), "left")
    return out.select("id", (F.col("t").isNull() | F.col("k").isNotNull()).alias("kept"), F.coalesce("sim", F.lit(0.0)).alias("sim_max"))
