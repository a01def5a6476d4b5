"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

Fingerprints that differ in at most r of 64 bits agree on at least one of r + 1 blocks of bits (pigeonhole), or on
two of r + 2, and so on. So equal block values make the groups in which fingerprints are compared, without loss;
more blocks make smaller groups for more fingerprints. A group is compared in tiles of distinct fingerprints,
ordered by population count, by exclusive-or and bit count in numpy; tile pairs whose population counts differ by
more than r are skipped. Groups beyond TILE are themselves cut into tiles that different tasks compare pair by
pair. Each comparison returns only a spanning forest of the links it found, never all pairs of a group.

Defined results: a text without words (null, empty, white space) has fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; exact copies and repeated rows meet as one fingerprint; ties in the
smallest id do not matter; null ids are linked but never the name of a component unless it has no other id; an
empty table gives an empty table; extra columns of any name are left as they are. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, one_row_each, ship, slices, stored, text_hash, text_of
from .components import components, forest

TILE = 4096
_SUB = 512


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) + 1 for w in words])) - 1
    a, z = [0, *(ends[: len(words) - k] + 1).tolist()], ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    n, counts = len(a), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(a[i : i + 65536], z[i : i + 65536])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of each row."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            fp = np.array([fingerprint(t, k, seed) for t in byte_values(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    src = text_of(df, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    return src.mapInArrow(rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def masks(n: int, radius: int, group: int = 2048) -> list[int]:
    """64-bit masks, one for each table: for n fingerprints, the fewest blocks whose groups hold about `group` or less. Any choice is exact."""
    for extra in range(1, 5):
        blocks = radius + extra
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(edges, edges[1:])]
        out = [sum(c) for c in combinations(parts, extra)]
        if n >> min(m.bit_count() for m in out) <= group:
            break
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, root) for what the links among distinct fingerprints connect; with side, the links between its two values only."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    ones = np.bitwise_count(fps).astype(np.int64)
    side = None if side is None else side[order]
    us, vs = [], []
    for i in range(0, len(fps), _SUB):
        a = fps[i : i + _SUB]
        for j in range(i, len(fps), _SUB):
            if ones[j] - ones[min(i + _SUB, len(fps)) - 1] > radius:
                break  # and so do all later tiles
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + _SUB]) <= radius
            if side is not None:
                near &= side[i : i + _SUB, None] != side[None, j : j + _SUB]
            u, v = np.nonzero(near)
            new = u + i < v + j
            u, v = u[new] + i, v[new] + j
            if len(u) > 2 * _SUB:  # only what holds the tiles' nodes together
                nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                root = forest(len(nodes), at[: len(u)], at[len(u) :])
                own = np.flatnonzero(root != np.arange(len(nodes)))
                u, v = nodes[own], nodes[root[own]]
            us.append(u)
            vs.append(v)
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))
    root = forest(len(fps), u, v)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Streams rows (group, cell, side, fp) sorted by group and cell; one cell is held at a time."""
    held: list[np.ndarray] = []

    def flush(cell: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, fps = cell[2], cell[3].view(np.uint64)
        if len(fps) > 1:
            u, v = links_in(fps, radius, side if side.any() else None)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cuts = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            if z - a > 1:
                yield from flush([c[a:z] for c in cols])
        held = [c[cuts[-1] :] for c in cols]
    if held:
        yield from flush(held)


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """a, b: pairs of the distinct fingerprints fp that connect exactly what all links connect (a pair may stand for a chain of links)."""
    ship(distinct.sparkSession)
    n = distinct.count()
    tables = masks(n, radius)
    # the table's number goes into the group's hash: 64 bits of (table, masked bits); a clash only adds comparisons
    group = F.transform(F.array(*(F.lit(_signed(m)) for m in tables)), lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
    rows = distinct.select("fp", F.explode(group).alias("g"), F.bit_count("fp").alias("ones"))
    by = rows.groupBy("g", "ones").agg(F.count("*").alias("n"))
    big = by.groupBy("g").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles")).where(F.col("all") > tile)
    big = stored(big.select(F.col("g").alias("k"), "tiles"), "simhash-large")
    both = rows.join(big, F.col("g") == F.col("k"), "left")
    small = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side")))
    # tile (ones, part) meets every tile whose count is within the radius; the smaller of the two comes first
    name = lambda ones, part: ones.cast("long") * (1 << 24) + part
    own = name(F.col("ones"), F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("ones"))))
    near = F.filter(F.map_keys("tiles"), lambda o: F.abs(o - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda o: F.transform(F.sequence(F.lit(0), F.element_at(F.col("tiles"), o) - 1), lambda p: name(o, p))))
    meets = F.transform(others, lambda t: F.struct(F.xxhash64(F.least(t, own), F.greatest(t, own)).alias("cell"), F.when(t == own, 0).when(own < t, 1).otherwise(2).alias("side")))
    cells = both.select("g", "fp", F.explode(F.when(F.col("k").isNull(), small).otherwise(meets)).alias("x")).select("g", "x.cell", "x.side", "fp")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cells = cells.repartition(parts, "g", "cell").sortWithinPartitions("g", "cell")
    return cells.mapInArrow(lambda b: _compare(b, radius), "a long, b long")


def cluster(df: DataFrame, radius: int = 4, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links) and root (the component's fingerprint) of each row."""
    docs = cut(fingerprints(df, k, seed, id_col, text_col))
    first = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(first.select("fp"), radius))
    named = cut(first.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).select(F.expr("root ^ 0L").alias("r"), "component_id")
    of_fp = stored(named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "simhash-components")
    return docs.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", "text_hash", "fp", "component_id", "root")


def representatives(df: DataFrame, radius: int = 4, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all columns, one row of each component: that with the smallest id (null last), then the smallest text hash."""
    rows = cluster(df, radius, k, seed, id_col, text_col)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash")
    best = rows.groupBy("root").agg(F.min(key).alias("best")).select("best.id", F.col("best.text_hash").alias("hash"))
    return one_row_each(df, stored(best, "simhash-kept"), id_col, text_col)


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
