"""Every registered query against DuckDB at the smallest scale."""

import pytest

from conftest import SF
from dialoom.plans import registry


def plain(v):
    return repr(v) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in at]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert got or name in {"cache_missing", "benchmark_overlap", "near_places", "failure_streaks"}
