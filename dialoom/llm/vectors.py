"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Each vector is scaled to length one and rounded to int8; the length of what rounding lost is kept with it. By the
Cauchy-Schwarz inequality the true cosine lies within a bound of the int8 product that these lengths give, so only
pairs whose bound reaches the threshold are computed again in double precision; no link is lost and none is
invented. Equal vectors are compared as one. Vectors meet by label and length in tiles; every pair of tiles of a
label is one cell, so a label with a third of all rows is many tasks, and a cell returns counts of links and a
spanning forest, never its pairs.

Defined results: a vector that is null, empty, all zero, or has null or non-finite components, and one whose label
is null, links with nothing and is its own component; repeated rows count as vectors each; a null id is never the
name of a component unless it has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, stored
from .components import components, forest

TILE = 2048
_SUB = 1024


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: int8 levels, the step, the length of its rounded form, and an upper bound on the length of the error."""
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None])
    near = q * step[:, None]
    slack = 1e-12  # of the double-precision arithmetic here
    return q.astype(np.int8), step, np.sqrt((near * near).sum(axis=1)) + slack, np.sqrt(((unit - near) ** 2).sum(axis=1)) + slack


def close_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a and b, or i < j of a) with cosine >= threshold."""
    qa = quantised(a)
    qb = qa if b is None else quantised(b)
    own, b = b is None, a if b is None else b
    exact = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64  # a float product of int8 levels is exact
    la, lb = qa[0].astype(exact), qb[0].astype(exact)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for i in range(0, len(a), _SUB):
        for j in range(i if own else 0, len(b), _SUB):
            s, t = slice(i, i + _SUB), slice(j, j + _SUB)
            most = (la[s] @ lb[t].T).astype(np.float64) * qa[1][s, None] * qb[1][None, t]
            most += qa[2][s, None] * qb[3][None, t] + qa[3][s, None]
            u, v = np.nonzero(most >= threshold - 1e-9)
            u, v = u + i, v + j
            if own:
                u, v = u[u < v], v[u < v]
            for k in range(0, len(u), 1 << 16):
                x, y = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                hit = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
                yield x[hit], y[hit]


def _prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dims, key (a hash of label and vector; null where nothing can link) and vector bytes."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, raws = [], [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2)):
                ok = label is not None and v.is_valid and len(v.values) > 0 and not v.values.null_count
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") if ok else None
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any()) and np.isfinite(x @ x) and (x @ x) > 0
                raw = x.tobytes() if ok else None
                keys.append(hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).hexdigest() if ok else None)
                dims.append(len(x) if ok else 0)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.string()), pa.array(raws, pa.binary())], ["vec_id", "label", "dims", "key", "raw"])

    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return src.mapInArrow(rows, "vec_id long, label string, dims int, key string, raw binary")


def _cells(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Streams rows (cell, side, node, n, raw) sorted by cell. Out: node, n_links to add, or a link a-b of the forest."""
    names = ["node", "n_links", "a", "b"]
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        side = np.array([r[1] for r in held])
        node, n = np.array([r[2] for r in held]), np.array([r[3] for r in held])
        v = np.frombuffer(b"".join(r[4] for r in held), "<f8").reshape(len(held), -1)
        one, two = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
        more = np.zeros(len(held), np.int64)
        root = np.arange(len(held))
        if not side.any():
            pairs = close_pairs(v, None, threshold)
        else:
            pairs = close_pairs(v[one], v[two], threshold) if len(one) and len(two) else iter(())
        for x, y in pairs:
            if side.any():
                x, y = one[x], two[y]
            np.add.at(more, x, n[y])
            np.add.at(more, y, n[x])
            root = forest(len(held), np.concatenate([np.arange(len(held)), x]), np.concatenate([root, y]))
        hit, own = np.flatnonzero(more), np.flatnonzero(root != np.arange(len(held)))
        if len(hit):
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(more[hit]), none, none], names)
        if len(own):
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(node[own]), pa.array(node[root[own]])], names)

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and r[0] != held[0][0]:
                if len(held) > 1:
                    yield from flush()
                held = []
            held.append(r)
    if len(held) > 1:
        yield from flush()


def cluster(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    spark = df.sparkSession
    rows = cut(_prepared(df, id_col, vector_col, label_col))
    # equal vectors are one class; its node is a number, its name the smallest id
    classes = rows.where("key is not null").groupBy("key", "label", "dims").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("raw").alias("raw"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    size = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    size = size.select(F.concat(F.lit("k"), "label").alias("l"), F.col("dims").alias("d"), "tiles")
    src = classes.join(size, (F.concat(F.lit("k"), "label") == F.col("l")) & (F.col("dims") == F.col("d")))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.concat_ws(":", F.col("label"), F.col("dims"), F.least(t, own), F.greatest(t, own)).alias("cell"), F.when(t == own, 0).when(own < t, 1).otherwise(2).alias("side")))
    cells = src.select("node", "n", "raw", F.explode(meets).alias("x")).select("x.cell", "x.side", "node", "n", "raw")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda b: _cells(b, threshold), "node long, n_links long, a long, b long"))
    more = found.where("node is not null").groupBy(F.col("node").alias("m")).agg(F.sum("n_links").alias("more"))
    root = components(found.where("a is not null").select("a", "b")).select(F.col("node").alias("r_node"), "root")
    named = cut(classes.select("key", "n", "first", "node").join(more, F.col("node") == F.col("m"), "left").join(root, F.col("node") == F.col("r_node"), "left").select("key", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).select(F.expr("root ^ 0L").alias("r"), "component_id")
    of_key = stored(named.join(least, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "n_links", "component_id"), "vector-components")
    linked = rows.where("key is not null").select("vec_id", "key").join(of_key, F.col("key") == F.col("k")).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
