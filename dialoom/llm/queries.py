"""The corpus operators as registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ans, curve, lattice, licenses, lines, mixing, quality, simhash, vectors, warc
from .common import table


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, memo=900_000)


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"), radius=4, k=4, seed=42)
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), k=5, least=0.8)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, max_repeats=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.digests(docs, lines.bitmaps(lines.dropped(docs, min_docs=10, min_chars=1, mode="all")))


def op7_ans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.with_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op9_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_simhash_tiles": op3_simhash_tiles,
    "op4_license_scan": op4_license_scan,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_ans_ids": op7_ans_ids,
    "op8_quality_ledger": op8_quality_ledger,
    "quality_ablations": quality_ablations,
    "op9_int8_tiles": op9_int8_tiles,
    "op10_warc_segments": op10_warc_segments,
}


def _license_sql() -> str:
    """Exact containment in every window, without MinHash."""
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licenses.NOTICES.items())
    words = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    return f"""
WITH t AS (SELECT license, {words.format("x")} AS w FROM (VALUES {rows}) v(license, x)),
ts AS (SELECT license, len(w) - 4 AS places, unnest(range(1, len(w) - 3)) AS i, w FROM t),
tg AS (SELECT DISTINCT license, (2 ** ceil(log2(places)))::INT AS c, array_to_string(w[i:i+4], ' ') AS g FROM ts),
tn AS (SELECT license, c, count(*) AS shingles FROM tg GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT r, doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
h AS (SELECT r, doc_id, pos, g FROM ds SEMI JOIN tg ON ds.g = tg.g),
cl AS (SELECT DISTINCT c, greatest(c // 2, 1) AS s, c + greatest(c // 2, 1) - 1 AS wide FROM tg),
p AS (SELECT r, doc_id, pos, g, c, unnest(range(greatest(0, (floor((pos - wide + s) / s))::INT), pos // s + 1)) AS n FROM h, cl),
f AS (SELECT r, c, n, min(pos) AS first_word FROM p GROUP BY ALL),
m AS (SELECT p.r, p.doc_id, p.c, p.n, tg.license, count(DISTINCT p.g) AS matched FROM p JOIN tg ON p.g = tg.g AND p.c = tg.c GROUP BY ALL)
SELECT m.doc_id, license, max_by(matched, matched * 1e9 - first_word)::BIGINT AS matched, shingles, max_by(first_word, matched * 1e9 - first_word)::BIGINT AS first_word
FROM m JOIN f USING (r, c, n) JOIN tn USING (license, c) WHERE matched >= 0.8 * shingles GROUP BY m.r, m.doc_id, license, shingles"""


#: The mix without histograms: documents in place order, budgets by running sums.
_MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || left(md5('1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * n / w::DOUBLE AS ratio FROM s),
c AS (SELECT *, sum(2 * n) OVER o - 2 * n AS fixed, sum(w) OVER () - sum(w) OVER o + w AS free FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT (1.5 * (SELECT sum(n) FROM s) - fixed)::DOUBLE AS left_, free::DOUBLE AS free FROM c WHERE 2 * n * free >= (1.5 * (SELECT sum(n) FROM s) - fixed) * w ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, n, least(left_ * w / free, (2 * n)::DOUBLE) AS target FROM s, l),
k AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::INT ELSE 0 END AS copies FROM g),
q AS (SELECT source, place, sum(size) AS size FROM d WHERE size > 0 GROUP BY ALL),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM q),
e AS (SELECT u.source, u.place, u.upto - u.size + CASE WHEN 2 * (target - copies * n - (u.upto - u.size)) >= u.size THEN 0 ELSE u.size END AS before, target - copies * n AS need FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source)
SELECT d.doc_id, d.size, k.n AS source_size, k.target, d.size * (k.copies + CASE WHEN e.before < e.need AND e.need > 0 AND e.place IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.place = d.place"""


#: The measures and the failure bits of each document.
_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i:i+4] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
pos AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM
       (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(pos.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_words
      FROM w LEFT JOIN pos USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 25 * n_words THEN 8 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 100 * n_same_words > 30 * n_words THEN 32 ELSE 0 END
      + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)"""


ORACLES: dict[str, str] = {
    "op5_mixing": _MIX_SQL,
    "op4_license_scan": _license_sql(),
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, p, ls[p] AS line, translate(regexp_replace(ls[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op8_quality_ledger": _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 47 = 0 AS kept, fail_bits FROM b""",
    "quality_ablations": _LEDGER_SQL + """
, r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('word_length', 4), ('symbols', 8), ('same_words', 32))
SELECT 'production-1' AS policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & 47 = bit) AS n_failed_alone,
       count(*) FILTER (fail_bits & 47 & ~bit = 0) AS n_kept_without, count(*) AS n_docs FROM b, r GROUP BY rule""",
    "op9_int8_tiles": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.n),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id""",
    "op10_warc_segments": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS m FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM f""",
}
