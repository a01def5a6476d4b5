"""Sampling queries: md5 order, checked by SQL."""

from pyspark.sql import functions as F

from ..operators import sampling, summary
from .base import query

_D = "(SELECT doc_id, lang, source, md5('42:' || doc_id) AS h FROM documents)"


def _docs(t):
    return t("documents").select(F.col("doc_id").alias("id"), "lang", "source")


@query(f"""
SELECT doc_id AS id, lang, source, CASE WHEN r <= CASE WHEN n >= 2 THEN least(greatest(1, round_even(n * 0.05, 0)), n - 1) ELSE 0 END THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM {_D})""")
def stratified_split(t):
    return sampling.stratified_split(_docs(t), ["lang", "source"], 0.05)


@query(f"""
SELECT lang, count(*) AS n, count(*) FILTER (r > k) AS n_train, count(*) FILTER (r <= k) AS n_val FROM (SELECT *, CASE WHEN n >= 2 THEN least(greatest(1, round_even(n * 0.1, 0)), n - 1) ELSE 0 END AS k
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM {_D})) GROUP BY lang""")
def split_strata(t):
    return summary.split_strata(sampling.stratified_split(_docs(t), ["lang"], 0.1), ["lang"])


@query(f"""
SELECT doc_id AS id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r, round_even(100 * count(*) OVER (PARTITION BY lang) / (SELECT count(*) FROM documents), 0) AS q FROM {_D}) WHERE r <= q ORDER BY h, doc_id LIMIT 100""")
def proportional_sample(t):
    return sampling.proportional(_docs(t), ["lang"], 100)


@query(f"""SELECT doc_id AS id, lang, source FROM {_D} ORDER BY h, doc_id LIMIT 50""")
def hash_ordered_sample(t):
    return sampling.first_by_hash(_docs(t), 50)


@query("""
WITH t AS (SELECT doc_id, 'train' AS origin FROM documents WHERE lang = 'en'), p AS (SELECT doc_id, 'general' AS origin FROM documents WHERE lang <> 'en' ORDER BY md5('43:' || doc_id), doc_id LIMIT (SELECT round_even(count(*) * 0.12, 0)::BIGINT FROM t))
SELECT doc_id AS id, origin FROM t UNION ALL SELECT * FROM p""")
def general_mix(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "lang")
    return sampling.mixed(d.where("lang = 'en'").select("id"), d.where("lang <> 'en'").select("id"), 0.12)


@query("""
SELECT mode, count(*) AS n FROM (SELECT CASE WHEN u < 0.8 THEN 'tool_use' WHEN u < 0.9 THEN 'no_tool' ELSE 'error_recovery' END AS mode FROM (SELECT ('0x' || left(md5('7:' || doc_id), 13))::BIGINT / 4503599627370496.0 AS u FROM documents)) GROUP BY mode""")
def mode_choice(t):
    m = sampling.weighted_choice(7, "doc_id", [("tool_use", 0.8), ("no_tool", 0.1), ("error_recovery", 0.1)])
    return t("documents").select(m.alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT p_name || '-' || p_partkey AS name, CASE WHEN p_size <= 5 THEN 'c' || p_size END AS capability, md5('42:' || p_name || '-' || p_partkey) AS h FROM part),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY h, name) AS r FROM b WHERE capability IS NOT NULL) WHERE r = 1),
a AS (SELECT name, capability, 0 AS o, h FROM c UNION ALL SELECT name, capability, 1, h FROM b WHERE name NOT IN (SELECT name FROM c))
SELECT name, capability FROM (SELECT * FROM a ORDER BY o, h, name LIMIT 14)""")
def capability_tools(t):
    p = t("part").select(F.concat_ws("-", "p_name", "p_partkey").alias("name"), F.when(F.col("p_size") <= 5, F.concat(F.lit("c"), "p_size")).alias("capability"))
    return sampling.capability_sample(p, 14)


@query("""
SELECT r_regionkey AS id, ['here', 'tomtom', 'keyless'][(row_number() OVER (ORDER BY r_regionkey) - 1) % 3 + 1] AS plan FROM region""")
def provider_plan(t):
    return sampling.round_robin(t("region").select(F.col("r_regionkey").alias("id")), ["here", "tomtom", "keyless"], "id")


@query("""
SELECT r_regionkey || '-d' || k AS id, r_name FROM region, (SELECT unnest(range(0, 3)) AS k)""")
def replicated_rows(t):
    return sampling.replicated(t("region").select(F.col("r_regionkey").cast("string").alias("id"), "r_name"), 3)


@query("""
SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, 1 LIMIT 25""")
def top_parts(t):
    rev = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t("lineitem").groupBy("l_partkey").agg(rev.alias("r")).orderBy(F.desc("r"), "l_partkey").limit(25).select("l_partkey", F.round("r", 2).alias("revenue"))
