"""Connected components of a link table, on the cluster.

Rounds of large-star and small-star: every node's links move to the smallest node it knows, first for its larger
neighbours, then for its smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
largest component. Only counts and check sums come to the driver. A node with a large share of all links is
summed before it is shuffled, and its side of each join is one that Spark can split at run time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node index reachable from each of n nodes over links u-v, in one process."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        live = low != high
        if not live.any():
            break
        u, v = u[live], v[live]
        np.minimum.at(label, high[live], low[live])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _smallest(links: DataFrame) -> DataFrame:
    """k and m: the smallest of each node u's neighbours v and itself. k is no longer the column that rows were dealt by."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0L").alias("k"), F.least("m", "u").alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node in links(a long, b long)."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        # large star: both directions; each larger neighbour goes to the smallest node known
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _smallest(both)
        large = e.join(m, F.col("v") == F.col("k")).select("u", F.col("m").alias("v"))
        # small star: of the links to smaller nodes, all go to the smallest of them
        large = large.where("u <> v").distinct()
        low = _smallest(large)
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    # at rest every node but the roots has one link, to its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
