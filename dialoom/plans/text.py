"""Queries over texts."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, summary, validate
from .base import query

_WORDS = r"[\p{L}\p{Nl}\p{No}]+"
_TOKENS = r"[\p{L}\p{N}_''-]+"


def _scores_sql() -> str:
    def one(lang: str) -> str:
        stop = ", ".join(f"'{w}'" for w in dict.fromkeys(X.STOPWORDS[lang].split()))
        marks = f"length(low) - length(translate(low, '{X.DIACRITICS[lang]}', ''))" if X.DIACRITICS[lang] else "0"
        return f"len(list_filter(tok, lambda x: x IN ({stop})))::DOUBLE / len(tok) + 0.05 * (({marks})::DOUBLE / len(tok)) AS s_{lang}"

    names = list(X.STOPWORDS)
    best = "greatest(" + ", ".join(f"s_{x}" for x in names) + ")"
    guess = "CASE " + " ".join(f"WHEN s_{x} = best THEN '{x}'" for x in names) + " END"
    own = "CASE lang " + " ".join(f"WHEN '{x}' THEN s_{x}" for x in names) + " END"
    return f"""
WITH t AS (SELECT doc_id, lang, lower(text) AS low, regexp_extract_all(lower(text), '{_WORDS}') AS tok FROM documents),
s AS (SELECT doc_id, lang, {", ".join(map(one, names))} FROM t WHERE len(tok) >= 6),
b AS (SELECT *, {best} AS best FROM s), g AS (SELECT *, {guess} AS guess, {own} AS own FROM b)
SELECT lang, guess, coalesce(guess <> lang AND best >= 0.12 AND best > own + 0.04, false) AS mismatch, count(*) AS n FROM g GROUP BY ALL"""


@query(_scores_sql())
def language_confusion(t):
    d = validate.language(t("documents").select("doc_id", "lang", "text")).where("scores is not null")
    return d.groupBy("lang", "guess", "mismatch").agg(F.count("*").alias("n"))


_URL = "url || CASE page_id % 3 WHEN 0 THEN '&api_key=' || md5(url) WHEN 1 THEN '{\"token\": \"' || md5(url) || '\"}' ELSE '' END"


def _leaky(t):
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("&api_key="), F.md5("url"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"token": "'), F.md5("url"), F.lit('"}'))).otherwise("")
    return t("pages").select("page_id", F.concat("url", tail).alias("text"))


@query(f"""
WITH p AS (SELECT page_id, {_URL} AS t FROM pages),
a AS (SELECT page_id, regexp_replace(t, '(?i)\\b(api[-_]?key|access[-_]?token|subscription[-_]?key|token|key)\\s*=\\s*([A-Za-z0-9_.\\-]{{8,}})', '\\1=***', 'g') AS t FROM p)
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END AS n_secrets,
regexp_replace(t, '(?i)["''](api[-_]?key|access[-_]?token|subscription[-_]?key|token|key)["'']\\s*:\\s*["'']([A-Za-z0-9_.\\-]{{8,}})["'']', '\\1=***', 'g') AS text FROM a""")
def secrets_scrubbed(t):
    return validate.secrets(_leaky(t), "text")


@query(f"""
SELECT page_id, regexp_replace({_URL}, '(?i)\\b(api[-_]?key|access[-_]?token|subscription[-_]?key|token|key)=([A-Za-z0-9_\\-.]{{6,}})', '\\1=***', 'g') AS text FROM pages""")
def secrets_redacted(t):
    return _leaky(t).withColumn("text", X.redact(F.col("text")))


@query("""
SELECT lang, CASE WHEN doc_id % 4 = 0 AND lang <> 'de' THEN 'de' WHEN doc_id % 4 = 1 AND lang <> 'en' THEN 'en' WHEN doc_id % 4 = 2 AND lang <> 'es' THEN 'es' END AS looks, count(*) AS n FROM documents GROUP BY ALL""")
def phrase_gate(t):
    said = F.element_at(F.array(*map(F.lit, ("Wir: ich brauche Hilfe", "Could you help?", "necesito ir a casa", "nothing"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("lang", X.phrase_mismatch(F.col("lang"), said).alias("looks")).groupBy("lang", "looks").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 350) || chr(10) || '…[' || (length(text) - 475) || ' chars cut]…' || chr(10) || right(text, 125) ELSE text END) AS digest FROM documents""")
def head_tail_cut(t):
    return t("documents").select("doc_id", F.md5(X.head_tail(F.col("text"), 500)).alias("digest"))


@query("""
SELECT doc_id, left(string_split(string_split(text, '. ')[1], chr(10))[1], 110) AS sentence FROM documents""")
def first_sentence(t):
    return t("documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("""SELECT conv_id, turn, trim(text) AS text FROM conversations""")
def cleaned_messages(t):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('User: "'), F.trim("text"), F.lit('"'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```text\n"), F.trim("text"), F.lit("\n```"))).otherwise(F.concat(F.lit(" Fahrer - driver: "), F.trim("text")))
    return t("conversations").select("conv_id", "turn", X.clean_user_message(raw).alias("text"))


@query("""
SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes_before, sum(strlen(left(text, 100)))::BIGINT AS bytes_after, round(100 * sum(strlen(left(text, 100))) / sum(strlen(text)), 1) AS percent FROM documents""")
def shrink_stats(t):
    return summary.shrink(t("documents"), F.col("text"), F.left("text", F.lit(100)))


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text""")
def first_seen_documents(t):
    d = t("documents").select("doc_id", F.md5("text").alias("digest"))
    return dedup.first_seen(d, ["digest"], ["doc_id"])


_GRAMS = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKENS}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)"""


@query(_GRAMS + """
, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p.a, p.b, round(s / (x.n + y.n - s), 6) AS similarity FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE s / (x.n + y.n - s) >= 0.6""")
def near_duplicate_edges(t):
    e = dedup.jaccard_edges(t("documents"), "doc_id", "text", 0.6)
    return e.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def near_duplicate_kept(t):
    return dedup.kept_texts(t("documents"), "doc_id", "text", 0.6).select(F.col("id").alias("doc_id"), "kept", F.round("sim_max", 6).alias("sim_max"))


@query(_GRAMS + f"""
, b AS (SELECT DISTINCT array_to_string(w[i:i+4], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT regexp_extract_all(lower(text), '{_TOKENS}') AS w FROM benchmark) WHERE len(w) >= 5))
SELECT g.doc_id, count(*) AS n_shared FROM g SEMI JOIN b ON g.g = b.g GROUP BY g.doc_id""")
def benchmark_overlap(t):
    d, b = dedup.profiles(t("documents"), "doc_id", "text"), dedup.profiles(t("benchmark"), "item_id", "text").select("g").distinct()
    return d.join(b, "g", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_shared"))


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def documents_without_labels(t):
    return dedup.without(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")


@query("""SELECT min(doc_id) AS doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents GROUP BY 2""")
def first_seen_normalized(t):
    d = t("documents").select("doc_id", F.md5(dedup.normalized(F.col("text"))).alias("digest"))
    return dedup.first_seen(d, ["digest"], ["doc_id"])


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_matches(html, '[一-鿿]') AS cjk, octet_length(encode(html))::BIGINT AS n_bytes FROM pages""")
def page_scalars(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), X.has_cjk(F.col("html")).alias("cjk"), F.octet_length("html").cast("long").alias("n_bytes"))
