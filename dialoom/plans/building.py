"""Queries for gold sets and training files."""

from pyspark.sql import functions as F

from ..operators import building
from .base import query


@query("""
SELECT c_custkey, 'origin: ' || c_name || CASE WHEN c_nationkey % 2 = 0 THEN '; destination: ' || c_mktsegment ELSE '' END || '; providers: here, tomtom; answer language: en' AS rubric FROM customer""")
def rubric_texts(t):
    r = building.rubric(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")), F.array(F.lit("here"), F.lit("tomtom")), F.lit("en"))
    return t("customer").select("c_custkey", r.alias("rubric"))


@query("""
SELECT o_orderkey, 'find' AS name, '{"cust":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS arguments FROM orders""")
def transported_calls(t):
    c = F.array(F.struct(F.lit("find").alias("name"), F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).alias("arguments")))
    return t("orders").select("o_orderkey", F.explode(building.transported(c)).alias("c")).select("o_orderkey", "c.name", "c.arguments")


@query("""
SELECT l_orderkey, l_partkey || '' AS name, round(l_quantity * 1234 / 1000, 1) AS km, round(l_quantity * 77 / 60)::BIGINT AS minutes FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r <= 3""")
def top_results(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    made = F.transform("x", lambda r: F.struct(r["l_partkey"].cast("string").alias("name"), (r["l_quantity"] * 1234).alias("meters"), (r["l_quantity"] * 77).alias("seconds")))
    return rows.select("l_orderkey", F.explode(building.top_places(made, 3)).alias("r")).select("l_orderkey", "r.name", "r.km", "r.minutes")


@query("""
SELECT user_id, count(*) AS n_multi FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1) GROUP BY user_id""")
def multi_call_steps(t):
    return building.multi_call_steps(t("events"), "user_id", "event_type")


@query("""
SELECT count(*) AS n, sum(n_chars)::BIGINT AS n_tokens, sum(least(n_chars, 2048))::BIGINT AS n_kept, count(*) FILTER (n_chars > 2048) AS n_cut, count(*) FILTER (least(n_chars, 2048) < 0.7 * n_chars) AS n_dropped FROM documents""")
def token_counters(t):
    return building.token_counters(t("documents"), F.col("n_chars"), 2048)


@query("""
WITH d AS (SELECT source, lang <> 'fr' AS ok, CASE WHEN doc_id % 10 > 0 THEN n_chars % 500 END AS id FROM documents),
r AS (SELECT *, CASE WHEN ok AND id IS NOT NULL THEN row_number() OVER (PARTITION BY ok, id ORDER BY source) END AS rn FROM d)
SELECT count(*) AS n_read, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (ok AND id IS NULL) AS n_no_id, source, count(*) FILTER (rn > 1) AS n_repeated, count(*) FILTER (rn = 1) AS n_kept FROM r GROUP BY source""")
def source_counters(t):
    d = t("documents").select("source", "lang", F.when(F.col("doc_id") % 10 > 0, F.col("n_chars") % 500).alias("id"))
    return building.source_counters(d, F.col("lang") != "fr", "id", "source")


@query("""
WITH s AS (SELECT doc_id AS seed_id, lang, md5('42:' || doc_id) AS h FROM documents WHERE lang <> 'es'),
p AS (SELECT seed_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, seed_id) - 1 AS rn FROM s UNION ALL SELECT seed_id, '*', row_number() OVER (ORDER BY h, seed_id) - 1 FROM s),
z AS (SELECT lang, count(*) AS n FROM p GROUP BY lang), i AS (SELECT doc_id AS id, d.lang, coalesce(z.lang, '*') AS pool FROM documents d LEFT JOIN z ON d.lang = z.lang)
SELECT i.id, i.lang, p.seed_id FROM i JOIN z ON z.lang = i.pool JOIN p ON p.lang = i.pool AND p.rn = ('0x' || left(md5('42:' || i.id), 13))::BIGINT % z.n""")
def seed_choice(t):
    d = t("documents")
    return building.pick_seed(d.select(F.col("doc_id").alias("id"), "lang"), d.where("lang <> 'es'").select(F.col("doc_id").alias("seed_id"), "lang"), "lang")


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def category_counts(t):
    return building.category_counts(t("documents"), ["lang", "source"])


@query("""SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels""")
def guard_ids(t):
    return t("documents").select(F.col("doc_id").alias("id")).union(t("labels").select("doc_id")).distinct()
