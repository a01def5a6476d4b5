"""Queries over dialogues."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import dialogs, summary, validate, views
from .base import query


def _nested(t):
    """conversations as neutral dialogues; the table has no calls."""
    c = t("conversations").select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(f"array<{dialogs.CALL}>").alias("tool_calls"))
    rows = dialogs.nested(c, "dialog_id", "pos", "role", "content", "tool_call_id", "name", "tool_calls")
    return rows.withColumn("messages", F.transform("messages", lambda m: m.dropFields("pos")))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations),
r AS (SELECT 'first message is not system' AS reason FROM c WHERE a = 1 AND role <> 'system'
UNION ALL SELECT role || ' content empty' FROM c WHERE role IN ('user', 'system', 'tool') AND trim(coalesce(text, '')) = ''
UNION ALL SELECT 'no user turns' FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = 0
UNION ALL SELECT 'does not end with non-empty assistant text' FROM c WHERE z = 1 AND (role <> 'assistant' OR trim(coalesce(text, '')) = ''))
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def structural_reasons(t):
    found = validate.structural(_nested(t), [])
    # outer: else Spark filters by reasons first, and makes them thrice
    return found.select(F.explode_outer("reasons").alias("r")).where("r is not null").select(F.regexp_replace("r", r"^msg\[\d+\] ", "").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS step FROM conversations""")
def step_of_turn(t):
    return dialogs.with_step(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "step")


@query("""
WITH m AS (SELECT *, 2 * sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS island FROM conversations)
SELECT conv_id, min(turn) AS first_pos, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS content, max(CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END) AS role FROM m GROUP BY conv_id, island""")
def folded_turns(t):
    return dialogs.folded(t("conversations"), "conv_id", "turn").select("conv_id", "first_pos", "n_turns", F.md5("content").alias("content"), "role")


@query("""
SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(role, turn) AS last_role,
arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS last_answer FROM conversations GROUP BY conv_id""")
def dialogue_ends(t):
    return dialogs.ends(t("conversations"), "conv_id", "turn")


@query("""
SELECT conv_id, md5(string_agg(upper(role) || ': ' || left(text, CASE role WHEN 'assistant' THEN 4000 WHEN 'tool' THEN 300 ELSE 2000 END), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def judge_transcript(t):
    return dialogs.transcript(t("conversations"), "conv_id", "turn").select("conv_id", F.md5("transcript").alias("digest"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations)
SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || left(text, 300), chr(10) ORDER BY turn)) AS digest FROM r WHERE z <= 8 GROUP BY conv_id""")
def recent_context(t):
    c = dialogs.recent(F.col("messages"))
    return _nested(t).select(F.col("dialog_id").alias("conv_id"), F.size(c).cast("long").alias("n"), F.md5(F.concat_ws("\n", c)).alias("digest"))


@query("""
WITH m AS (SELECT *, CASE WHEN role IN ('system', 'assistant') THEN role ELSE 'user' END AS k FROM conversations),
g AS (SELECT *, sum(CASE WHEN k = 'user' AND p = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM m)),
f AS (SELECT conv_id, island, min(k) AS k, string_agg(text, chr(10) ORDER BY turn) AS t FROM g GROUP BY conv_id, island)
SELECT conv_id, count(*) AS n_messages, md5(string_agg(k || ':' || t, '|' ORDER BY island)) AS digest FROM f GROUP BY conv_id""")
def alternating_view(t):
    v = views.alternating(_nested(t))
    return v.select(F.col("dialog_id").alias("conv_id"), F.size("messages").cast("long").alias("n_messages"), F.md5(F.concat_ws("|", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])))).alias("digest"))


@query("""
WITH s AS (SELECT conv_id, turn, role, '<|' || role || '|>' || coalesce(text, '') || chr(10) AS s FROM conversations),
o AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM s),
w AS (SELECT conv_id, string_agg(s, '' ORDER BY turn) AS x FROM s GROUP BY conv_id),
t AS (SELECT conv_id, unnest(regexp_extract_all(x, '[^\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+')) AS tok, generate_subscripts(regexp_extract_all(x, '[^\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+'), 1) AS i FROM w),
p AS (SELECT *, sum(length(tok)) OVER (PARTITION BY conv_id ORDER BY i) AS z FROM t)
SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.conv_id = p.conv_id AND o.role = 'assistant' AND o.z - length(o.s) <= p.z - length(p.tok) AND p.z <= o.z)) AS n_trained FROM p GROUP BY conv_id""".replace("\\\\", "\\"))
def label_mask(t):
    v = views.labels(views.segments(_nested(t)))
    return v.select(F.col("dialog_id").alias("conv_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_trained").cast("long").alias("n_trained"))


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS users, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id),
m AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'no_tool' WHEN 1 THEN 'tool_use' ELSE 'error_recovery' END AS mode FROM c)
SELECT mode, CASE WHEN users = 0 THEN 'no user turns' WHEN last_role <> 'assistant' OR trim(coalesce(last_text, '')) = '' THEN 'missing final assistant answer'
WHEN mode = 'tool_use' THEN 'tool_use dialog without any tool call' WHEN mode = 'error_recovery' AND users < 2 THEN 'error_recovery without error or clarification turn' ELSE 'ok' END AS gate, count(*) AS n FROM m GROUP BY ALL""")
def quality_gate(t):
    mode = F.when(F.col("dialog_id") % 3 == 0, "no_tool").when(F.col("dialog_id") % 3 == 1, "tool_use").otherwise("error_recovery")
    df = _nested(t).withColumns({"mode": mode, "lang": F.lit("fr"), "exec_log": F.array().cast("array<struct<name:string,args:string,ok:boolean,error:string>>")})
    return validate.gate(df).select("mode", F.coalesce("gate", F.lit("ok")).alias("gate")).groupBy("mode", "gate").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN true ELSE false END AS passed FROM documents""")
def verdict_passed(t):
    v = F.element_at(F.array(F.lit(None).cast("string"), F.lit("true"), F.lit("false"), F.lit('{"passed": true}'), F.lit('{"passed": false}'), F.lit("{}"), F.lit('"yes"')), (F.col("doc_id") % 7 + 1).cast("int"))
    return t("documents").select("doc_id", dialogs.passed(v).alias("passed"))


@query("""
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'en') AS language FROM documents""")
def alias_language(t):
    return t("documents").withColumn("language", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))).select("doc_id", dialogs.alias("language", "source", default="en").alias("language"))


@query("""
WITH j AS (SELECT doc_id, 1 + 9.0 * quality AS q, CASE WHEN toxic = 1 THEN 4.0 ELSE 12.0 END AS s FROM labels),
c AS (SELECT doc_id, greatest(1.0, least(10.0, q)) AS q, greatest(1.0, least(10.0, s)) AS s FROM j)
SELECT doc_id, q::DOUBLE AS min_avg_quality, least(q, s)::DOUBLE AS min_dim, 2::BIGINT AS n_judges, (least(q, s) >= 7.0) AS passed FROM c""")
def judge_verdicts(t):
    a = t("labels").select(F.col("doc_id").alias("id"), F.lit("a").alias("model"), (1 + 9.0 * F.col("quality")).alias("alignment"))
    b = t("labels").select(F.col("doc_id").alias("id"), F.lit("b").alias("model"), F.when(F.col("toxic") == 1, 4.0).otherwise(12.0).alias("alignment"))
    v = validate.judges(a.unionByName(b), ["alignment"])
    q = t("labels").select(F.col("doc_id").alias("id"), X.clamp_score(1 + 9.0 * F.col("quality")).alias("min_avg_quality"))
    return v.join(q, "id").select(F.col("id").alias("doc_id"), "min_avg_quality", "min_dim", "n_judges", "passed")


@query("""
SELECT flagged, judged, CASE WHEN flagged THEN judged IS NULL OR judged <> lang ELSE false END AS fails, count(*) AS n
FROM (SELECT lang, doc_id % 2 = 0 AS flagged, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'en' END AS judged FROM documents) GROUP BY ALL""")
def language_reconciled(t):
    d = t("documents").select("lang", (F.col("doc_id") % 2 == 0).alias("flagged"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "en").alias("judged"))
    return d.withColumn("fails", validate.reconcile_language(F.col("flagged"), F.col("judged"), F.col("lang"))).groupBy("flagged", "judged", "fails").agg(F.count("*").alias("n"))


@query("""
SELECT stage, count(*) FILTER (NOT f AND NOT k) AS n_pass, count(*) FILTER (f) AS n_fail, count(*) FILTER (k AND NOT f) AS n_skip FROM (
SELECT 'short' AS stage, n_chars < 500 AS f, false AS k FROM documents UNION ALL SELECT 'lang', lang <> 'en', false FROM documents UNION ALL SELECT 'mmr', false, n_chars < 500 FROM documents) GROUP BY stage""")
def stage_counts(t):
    d = t("documents").select(F.filter(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") != "en", "lang")), lambda x: x.isNotNull()).alias("stages_failed"), F.filter(F.array(F.when(F.col("n_chars") < 500, "mmr")), lambda x: x.isNotNull()).alias("stages_skipped"))
    return summary.stages(d, ["short", "lang", "mmr"])


@query("""
SELECT dim, value, count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(ok::INT), 4) AS pass_rate FROM (
SELECT 'o_orderstatus' AS dim, coalesce(nullif(o_orderstatus, ''), '?') AS value, o_totalprice > 150000 AS ok FROM orders
UNION ALL SELECT 'o_orderpriority', coalesce(nullif(o_orderpriority, ''), '?'), o_totalprice > 150000 FROM orders) GROUP BY dim, value""")
def pass_rate_by_group(t):
    return summary.groups(t("orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 150000)


@query("""
SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_passed, round(count(*) FILTER (quality = 1) / count(*), 4) AS pass_rate FROM labels""")
def totals(t):
    return summary.totals(t("labels"), F.col("quality") == 1)


@query("""
SELECT stage, reason, count(*) AS n FROM (SELECT 'length' AS stage, left('too short: ' || (n_chars // 100), 110) AS reason FROM documents WHERE n_chars < 500
UNION ALL SELECT 'language', 'not english: ' || lang FROM documents WHERE lang <> 'en') GROUP BY ALL""")
def reject_reasons(t):
    few = F.when(F.col("n_chars") < 500, F.array(F.concat(F.lit("too short: "), F.floor(F.col("n_chars") / 100).cast("string"))))
    other = F.when(F.col("lang") != "en", F.array(F.concat(F.lit("not english: "), F.col("lang"))))
    none = F.array().cast("array<string>")
    return summary.reasons(t("documents").select(F.create_map(F.lit("length"), F.coalesce(few, none), F.lit("language"), F.coalesce(other, none)).alias("reasons")))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS n_faults, CASE WHEN event_id % 4 = 3 THEN 'x' END AS extra FROM events""")
def schema_faults(t):
    k = F.get_json_object("props", "$.k")
    args = F.element_at(F.array(F.concat(F.lit('{"k": '), k, F.lit(', "mode": "a"}')), F.lit('{"mode": "b"}'), F.concat(F.lit('{"k": "'), k, F.lit('"}')), F.lit('{"k": true, "mode": "z", "x": 1}')), (F.col("event_id") % 4 + 1).cast("int"))
    spec = F.lit('{"type": "object", "properties": {"k": {"type": "integer"}, "mode": {"type": "string", "enum": ["a", "b"]}}, "required": ["k"]}')
    e = t("events").select("event_id", args.alias("args"), spec.alias("spec"))
    return e.select("event_id", F.size(V.schema_faults_of("args", "spec")).cast("long").alias("n_faults"), F.nullif(F.concat_ws(",", V.extra_keys_of("args", "spec")), F.lit("")).alias("extra"))


@query("""
SELECT conv_id, turn, 'f' || turn AS name, '{"a": ' || conv_id || '}' AS args FROM conversations""")
def calls_in_text(t):
    one = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('ok <tool_call>\n{"name": "f'), "turn", F.lit('", "arguments": {"a": '), "conv_id", F.lit("}}\n</tool_call>"))).otherwise(F.concat(F.lit('functools[{"name": "f'), "turn", F.lit('", "arguments": {"a": '), "conv_id", F.lit("}}]")))
    c = t("conversations").select("conv_id", "turn", one.alias("text"))
    return c.select("conv_id", "turn", F.explode(V.text_calls_of("text")).alias("c")).select("conv_id", "turn", "c.name", "c.args")
