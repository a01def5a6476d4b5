"""Near-duplicates by shared shingles against all pairs in plain Python."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_corpus import brute_components, docs, empty, raw, rows  # noqa: F401

import corpus_pipeline
from dialoom.llm import components, overlap
from dialoom.llm.common import text_hash


def grams(t):
    words = raw(t).lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return bool(a) and 9 * len(a & b) >= 4 * (len(a) + len(b))


def roots(texts):
    g = [grams(t) for t in texts]
    return brute_components(len(g), lambda i, j: raw(texts[i]) == raw(texts[j]) or near(g[i], g[j]))


def test_representatives(docs, rows, empty):  # noqa: F811
    texts = [r[1] for r in rows]
    root = roots(texts)
    got = overlap.representatives(docs)
    assert got.columns == docs.columns and got.count() == len(set(root))
    assert sorted(root[texts.index(r["text"])] for r in got.collect()) == sorted(set(root))
    assert overlap.representatives(empty).count() == 0


def test_links_of_documents(spark):
    """Links are links, and connect what all links connect; with a group of near copies that are not all near each other."""
    base = [f"v{i}" for i in range(120)]
    chain = [(10**6 + i, " ".join([*(f"x{i}.{j}" for j in range(3 * (i % 7))), *base[i % 11 :], f"y{i}"])) for i in range(60)]
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string")).repartition(4)
    g = {r["h"]: grams(r["text"]) for r in df.select(text_hash(F.col("text")).alias("h"), "text").collect()}
    ids = sorted(g)
    at = {h: i for i, h in enumerate(ids)}
    want = brute_components(len(ids), lambda i, j: near(g[ids[i]], g[ids[j]]))
    assert len(set(want)) < len(ids) - 40
    for common_docs, sample, many in ((overlap.COMMON_DOCS, overlap.SAMPLE, overlap.MANY), (2, 1, 2), (10**6, 1, 1)):
        e = [(r["a"], r["b"]) for r in overlap.links(df, common_docs=common_docs, sample=sample, many=many).collect()]
        assert all(near(g[a], g[b]) for a, b in e)
        assert components.forest(len(ids), np.array([at[a] for a, _ in e]), np.array([at[b] for _, b in e])).tolist() == want


def test_close():
    """Of sets with different roots, links that hold together what all links do; with one set twice and one that is far."""
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(0, 100), np.arange(9, 109), np.arange(50, 150), np.arange(1000, 1003)]
    found = overlap.close(sets, np.array([1, 2, 3, 4, 5, 6]), 4, 5)
    assert sorted(components.forest(6, np.array([i for i, _ in found]), np.array([j for _, j in found])).tolist()) == [0, 0, 0, 0, 4, 5]
    assert overlap.close(sets[:3], np.array([7, 7, 7]), 4, 5) == []


def test_bounds(spark):
    """Just at 0.8 (8 shared of 10) and just below (8 of 11), and a passage of which there is more than the common list's limit."""
    w = [f"w{i}" for i in range(400)]
    cases = [w[:13], [*w[:12], "x"], w[20:33], [*w[20:32], "y", "z"], *[[*w[100:160], *(f"d{i}.{j}" for j in range(40))] for i in range(60)]]
    cases += [w[200:280], [*w[200:279], "q"]]
    texts = [" ".join(c) for c in cases]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = roots(texts)
    assert {r["doc_id"] for r in overlap.representatives(df).collect()} == set(root) and root[1] == 0 and root[3] == 3 and len(set(root)) == 64


def test_many_passages(spark):
    """Passages with more frequent shingles than 2000 make no text meet another, so none is sent to be compared."""
    texts = [" ".join([*(f"p{i % 60}.{j}" for j in range(45)), *(f"u{i}.{j}" for j in range(60))]) for i in range(840)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert overlap._met(df, 4, 5, 5, "text", 12, 1).count() == 0


def test_prefixes():
    """Frequent shingles stand behind the others, by rank; of n shingles the first n - ceil(0.8 n) + 1, with their places."""
    row, place, g = overlap.prefixes(np.array([10, 0, 1, 5]), np.array([*range(10), 3, 0, 1, 2, 3, 9]), np.array([0, 1, 2, 3]), np.array([4, 3, 2, 1]), 4, 5)
    assert row.tolist() == [0, 0, 0, 2, 3, 3] and place.tolist() == [1, 2, 3, 1, 1, 2] and g.tolist() == [4, 5, 6, 3, 9, 3]


def test_places_rule_out(spark, monkeypatch):
    """A shingle at the end of both prefixes leaves too little to share, so that sets are not fetched for the pair."""
    seen = []
    monkeypatch.setattr(overlap, "_counted", lambda pairs, *a, f=overlap._counted: (seen.append(pairs.count()), f(pairs, *a))[1])
    words = lambda name: [f"{name}{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join([*words(f"a{i}."), *(f"s{j}" for j in range(30))])) for i in range(40)], "doc_id long, text string")
    found = overlap.links(df, common_docs=10**6)
    assert found.count() == 0 and seen[1] == 0


def test_pipeline_leaves_no_near_copies(spark, docs):  # noqa: F811
    keep = docs
    for name, stage in corpus_pipeline.STAGES:
        if name == "source mix":
            break
        keep = stage(spark, keep, "").cache()
    g = [grams(r["text"]) for r in keep.collect()]
    assert len(g) > 10 and not [1 for i in range(len(g)) for j in range(i) if near(g[i], g[j])]
    mixed = corpus_pipeline.source_mix(spark, keep, "").collect()
    assert {r["text"] for r in mixed} <= {r["text"] for r in keep.collect()}
