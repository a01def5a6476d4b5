"""Queries over all of their rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from dialoom.operators import summary
from dialoom.plans import registry
from test_queries import rows

#: Larger sizes at which these have several ids of each kind.
SIZES = {"selection_match": "sf0.01", "argument_fractions": "sf0.001", "top_results": "sf0.001", "seed_choice": "sf0.001", "guard_ids": "sf0.001", "scored_items": "sf0.001", "score_rollup": "sf0.001"}


def whole(spark, name, sql, size):
    at = SF.replace("sf0.001", size)
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "lineitem", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, at), con.sql(sql)
    got = df.collect()
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(SIZES))
def test_all_rows(spark, name):
    """The SQL has no filter on ids either."""
    assert " % 3 = 0)" not in registry.ORACLES[name] and "event_id <" not in registry.ORACLES[name] and "doc_id <" not in registry.ORACLES[name]
    whole(spark, name, registry.ORACLES[name], SIZES[name])


def test_all_orders_reach_providers(spark):
    """Reference calls of all providers are the lines of all orders."""
    got = registry.QUERIES["provider_scores"](spark, SF).agg({"ref_calls": "sum"}).first()[0]
    assert got == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_histogram_loses_no_value(spark):
    got = registry.QUERIES["value_histogram"](spark, SF.replace("sf0.001", "sf0.1")).collect()
    at = [r["bin"] for r in got]
    assert sum(r["n"] for r in got) == 100_000 and len(set(at)) == len(at) == max(at) - min(at) + 1 and min(at) == 0 and max(at) == 560
    low = summary.histogram(spark.createDataFrame([(-2,), (7,)], "v int"), F.col("v"), 0, 5).collect()
    assert {r["bin"]: r["n"] for r in low} == {b: int(b in (-2, 7)) for b in range(-2, 8)}
