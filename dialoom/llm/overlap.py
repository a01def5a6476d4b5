"""Near-duplicates by what their word shingles share: what all pairs at or above a Jaccard similarity connect, exactly.

In any one order of all shingles, two sets of similarity t share one of their first n - ceil(t n) + 1, so only texts
that meet in these prefixes are compared. The order is that of the hashes, with the shingles that many sets have in
common put last, the most frequent at the end, so that a passage found in many documents makes few candidates. Any such
list gives the same result, so it is taken from a sample; its length is bounded.

A large group of near copies meets in each of its shingles, and all its pairs would be the square of its size. So at
first each text is compared with one other at a shingle, the first in an order by hash (twice, with two orders). Then
only pairs that these links have not connected yet are left: at shingles where texts of several components meet, those
from different ones. What two prefixes share, and the rest of the set whose prefix ends first, bound what the sets
share, and so do the places of the last shingle that both prefixes have; pairs that this rules out go, the others are
counted in full. Nothing is left out, so the components are those of all pairs. Sets are stored for the texts of one
step only, and go with its shuffle files when the step is done.

Defined results: words and letter case are those of SimHash; fewer words than a shingle make one shingle; texts without
words have no shingles and are near to nothing but their exact copies; repeated rows are one; of ties the smallest id,
then the smallest text hash stays; null ids come last; extra columns of any name are left as they are; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MADE, among, cut, discard, one_row_each, release, ship, slices, stored, text_hash
from .components import components

#: Shingles put last in the order at most, of those that are in more than so many sets of one text in SAMPLE.
COMMON, COMMON_DOCS, SAMPLE = 1 << 19, 12, 8
#: Texts left at a shingle beyond which they are compared in cells, and texts of a tile.
MANY, TILE = 256, 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct hashes of k words, ascending. The words are made once: a lambda binds them."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+", " ")), " ")
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
    hashes = lambda w: F.transform(at(w), lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(k))))
    made = F.transform(F.array(words), lambda w: F.when(F.get(w, F.lit(0)) != "", F.sort_array(F.array_distinct(hashes(w)))))[0]
    return F.coalesce(made, F.array().cast("array<bigint>"))


def sets(df: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """h (the text's hash) and its shingles s, a row for each row of df."""
    return df.select(text_hash(df[text_col]).alias("h"), shingles(F.coalesce(df[text_col].cast("string"), F.lit("")), k).alias("s"))


def prefixes(sizes: np.ndarray, values: np.ndarray, known: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place from 1 and shingle of the first n - ceil(n num / den) + 1 of each row's ascending shingles, those in known (ascending) behind the others, by rank (from 1)."""
    n = sizes.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        last = np.where(known[at] == values, rank[at], 0)
        values = values[np.argsort(row * (len(known) + 1) + last, kind="stable")]
    place = np.arange(len(values)) - (np.cumsum(n) - n)[row] + 1
    first = place <= (n - (n * num + den - 1) // den + 1)[row]
    return row[first], place[first], values[first]


def _prefix(s: DataFrame, num: int, den: int, often: np.ndarray) -> DataFrame:
    """h, n, p and g: the shingles of the prefix of each row (h, s), their places and the size of the whole set. often: those put last, in order."""
    ship(s.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(often)
        known, rank = often[by], by + 1
        for b in slices(batches, 512):
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            row, place, g = prefixes(sizes, b.column(1).flatten().to_numpy(zero_copy_only=False), known, rank, num, den)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array(place, pa.int32()), pa.array(g, pa.int64())], ["h", "n", "p", "g"])

    return s.select("h", "s").mapInArrow(rows, "h long, n int, p int, g long")


def _met(df: DataFrame, num: int, den: int, k: int, text_col: str, common_docs: int, sample: int) -> DataFrame:
    """g, h, n, p: the shingles of prefixes in which several texts meet; n is the size of h's set, p the place of g in it."""
    part = df.where(F.pmod(text_hash(df[text_col]), F.lit(sample)) == 0)
    # of whole sets, since what is put last lets others into the prefixes
    seen = _prefix(sets(part, k, text_col), 0, 1, np.zeros(0, np.int64)).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > common_docs)
    # COMMON numbers at most
    often = seen.orderBy(F.desc("n"), "g").limit(COMMON).select("g").toArrow().column(0).to_numpy()[::-1].copy()
    rows = _prefix(sets(df, k, text_col), num, den, often)
    # most shingles are in one prefix only
    met = rows.withColumn("in", F.count("*").over(Window.partitionBy("g"))).where("in > 1").drop("in")
    return stored(met.dropDuplicates(["g", "h"]), "overlap-met")


def _alike(num: int, den: int) -> Column:
    """Sizes na and nb that sets of the similarity can have."""
    return (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)


def _wanted(hashes: DataFrame, df: DataFrame, k: int, text_col: str) -> DataFrame:
    """h and its shingles s for each text whose hash is among x."""
    wanted = stored(hashes, "overlap-wanted")
    texts = among(df.select(text_hash(df[text_col]).alias("h"), df[text_col].cast("string").alias("t")), wanted, F.col("h") == F.col("x"), "left_semi").dropDuplicates(["h"])
    return stored(texts.select("h", shingles(F.coalesce("t", F.lit("")), k).alias("s")), "overlap-sets")


def _done(df: DataFrame, name: str, before: list[str]) -> DataFrame:
    """df, stored; scratch folders that are not among before go, and so do the shuffle files of this step."""
    out = stored(df, name)
    discard(df.sparkSession, [x for x in MADE[:-1] if x not in before])
    release(df.sparkSession)
    return out


def _counted(pairs: DataFrame, df: DataFrame, num: int, den: int, k: int, text_col: str) -> DataFrame:
    """a and b of the stored pairs whose sets have the similarity."""
    before = list(MADE)
    whole = _wanted(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), df, k, text_col)
    release(df.sparkSession)  # the shuffled texts
    both = pairs.join(whole.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return _done(both.where(shared * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b"), "overlap-links", before)


def close(sets: list[np.ndarray], root: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different roots, as many as hold together what all such links do."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    more = times[column] > 1  # only these are shared
    column, row = np.unique(column[more], return_inverse=True)[1], row[more]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:z], column[a:z] - first] = 1
        shared += m @ m.T
    u, v = np.nonzero(np.triu(shared * (num + den) >= (sizes[:, None] + sizes) * num, 1))
    label, out = {int(r): int(r) for r in root}, []

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for i, j in zip(u.tolist(), v.tolist()):
        a, b = top(int(root[i])), top(int(root[j]))
        if a != b:
            label[a] = b
            out.append((i, j))
    return out


def _cells(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Streams rows (g, cell, h, r, s) sorted by g and cell; one cell is held at a time."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        found = close([x[4] for x in held], np.array([x[3] for x in held]), num, den) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][2] for i, _ in found]), pa.array([held[j][2] for _, j in found])], ["a", "b"])

    for b in batches:
        g, cell, h, r = (b.column(i).to_pylist() for i in range(4))
        for k, s in enumerate(b.column(4)):
            if held and held[0][:2] != (g[k], cell[k]):
                yield from flush()
                held = []
            held.append((g[k], cell[k], h[k], r[k], s.values.to_numpy()))
    yield from flush()


def _crowded(rest: DataFrame, crowds: DataFrame, df: DataFrame, num: int, den: int, k: int, text_col: str) -> DataFrame:
    """Links among the texts at crowded shingles. crowds(cg, tiles)."""
    ship(df.sparkSession)
    before = list(MADE)
    rows = rest.join(crowds, F.col("g") == F.col("cg")).select("g", "h", "r", "tiles")
    own = F.pmod(F.xxhash64("h"), F.col("tiles"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, own) * F.col("tiles") + F.greatest(t, own))
    rows = rows.withColumn("cell", F.explode(others))
    whole = _wanted(rows.select(F.col("h").alias("x")).distinct(), df, k, text_col).select(F.col("h").alias("sh"), "s")
    release(df.sparkSession)  # the shuffled texts
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(whole, F.col("h") == F.col("sh")).select("g", "cell", "h", "r", "s").repartition(parts, "g", "cell").sortWithinPartitions("g", "cell")
    return _done(full.mapInArrow(lambda b: _cells(b, num, den), "a long, b long"), "overlap-crowd-links", before)


def links(df: DataFrame, num: int = 4, den: int = 5, k: int = 5, text_col: str = "text", common_docs: int = COMMON_DOCS, sample: int = SAMPLE, many: int = MANY) -> DataFrame:
    """a, b: pairs of text hashes whose shingle sets have a Jaccard similarity of num / den or more, as many as connect all that such pairs connect."""
    spark, before = df.sparkSession, list(MADE)
    met = _met(df, num, den, k, text_col, common_docs, sample)
    release(spark)
    leads = []
    for order in (1, 2):
        first = met.groupBy("g").agg(F.min_by(F.struct("h", "n"), F.xxhash64(F.lit(order), "h")).alias("f")).select(F.col("g").alias("fg"), F.col("f.h").alias("b"), F.col("f.n").alias("nb"))
        both = met.join(first, F.col("g") == F.col("fg")).select(F.col("h").alias("a"), "b", F.col("n").alias("na"), "nb").where(_alike(num, den)).where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        # a passage in common is no near copy: what leaves out pairs here leaves them to the rest below
        small = F.least("na", "nb")
        leads.append(both.where(4 * F.col("c") >= small - F.floor((small * num + den - 1) / den) + 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    led = stored(leads[0].unionByName(leads[1]).distinct(), "overlap-first")
    release(spark)
    found = _counted(led, df, num, den, k, text_col)
    root = components(found)
    named = met.join(root, F.col("h") == F.col("node"), "left").select("g", "h", "n", "p", F.coalesce("root", "h").alias("r"))
    several = named.groupBy("g").agg(F.min("r").alias("least"), F.max("r").alias("most"), F.count("*").alias("size")).where("least < most").select(F.col("g").alias("sg"), "size")
    rest = stored(named.join(several, F.col("g") == F.col("sg")).drop("sg"), "overlap-rest")
    release(spark)
    crowds = stored(rest.where(F.col("size") > many).groupBy(F.col("g").alias("cg")).agg(F.ceil(F.first("size") / TILE).alias("tiles")), "overlap-crowds")
    if not crowds.isEmpty():
        found = found.unionByName(_crowded(rest.where(F.col("size") > many), crowds, df, num, den, k, text_col))
    few = rest.where(F.col("size") <= many)
    side = lambda x: few.select("g", F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), F.col("r").alias(f"r{x}"))
    both = side("a").join(side("b"), "g").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _alike(num, den)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # the longer set has ceil(n num / den) - 1 shingles after its prefix, the shorter one no more
    after = F.floor((F.greatest("na", "nb") * num + den - 1) / den) - 1
    # behind the last shingle that both prefixes have, sets share no more than the shorter rest
    most = F.col("c") + F.least(after, F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    last = stored(both.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b"), "overlap-last")
    release(spark)
    done = cut(found.unionByName(_counted(last, df, num, den, k, text_col)))
    discard(spark, [x for x in MADE if x not in before])
    release(spark)
    return done


def representatives(df: DataFrame, num: int = 4, den: int = 5, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all columns, one row of each component of near texts: that with the smallest id (null last), then the smallest text hash."""
    root = components(links(df, num, den, k, text_col))
    named = df.select(df[id_col].alias("id"), text_hash(df[text_col]).alias("h")).join(root, F.col("h") == F.col("node"), "left")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    best = named.groupBy(F.coalesce("root", "h").alias("r")).agg(F.min(key).alias("best")).select("best.id", F.col("best.h").alias("hash"))
    return one_row_each(df, stored(best, "overlap-kept"), id_col, text_col)
