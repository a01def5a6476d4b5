"""Queries over dialogues with tool calls: an order is a dialogue, each of its lines a call; some calls have no answer."""

from pyspark.sql import functions as F

from ..operators import dialogs, summary, validate, views
from .base import query

#: Lines numbered within orders; the second one of every fifth order has no answer.
_LINES = """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
o AS (SELECT k, count(*) AS n, k % 5 = 0 AND count(*) > 1 AS short FROM l GROUP BY k)"""


def _called(t):
    """l_orderkey and messages: system, user, one turn of all calls, the answers, the reply."""
    none = F.lit(None).cast("string")
    turn = lambda role, content, call=none, calls=F.lit(None): F.struct(F.lit(role).alias("role"), content.alias("content"), call.alias("tool_call_id"), none.alias("name"), calls.cast(f"array<{dialogs.CALL}>").alias("tool_calls"))
    own = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ids = lambda i: F.concat_ws(":", "l_orderkey", i + 1)
    calls = F.transform("x", lambda r, i: F.struct(ids(i).alias("id"), F.lit("function").alias("type"), F.struct(F.lit("look_up").alias("name"), F.concat(F.lit('{"part":'), r["l_partkey"], F.lit("}")).alias("arguments")).alias("function")))
    answers = F.transform("x", lambda r, i: F.when((F.col("l_orderkey") % 5 != 0) | (i != 1), turn("tool", F.concat(F.lit("part "), r["l_partkey"]), ids(i))))
    before = F.array(turn("system", F.lit("parts")), turn("user", F.lit("which parts?")), turn("assistant", F.lit(""), calls=calls))
    return own.select("l_orderkey", F.concat(before, F.filter(answers, lambda m: m.isNotNull()), F.array(turn("assistant", F.lit("these")))).alias("messages"))


@query(f"""{_LINES}
SELECT k AS l_orderkey, 'tool_call ' || k || ':2 has no tool response' AS reason FROM o WHERE short""")
def unanswered_calls(t):
    found = validate.structural(_called(t).withColumnRenamed("l_orderkey", "dialog_id"), ["look_up"])
    # outer: else Spark filters by reasons first, and makes them thrice
    return found.select(F.col("dialog_id").alias("l_orderkey"), F.explode_outer("reasons").alias("reason")).where("reason is not null")


@query(f"""{_LINES}
SELECT k AS l_orderkey, 0 AS pos, 'system' AS role, 0 AS n_calls, 'parts' AS content, short AS refused FROM o
UNION ALL SELECT k, 1, 'user', 0, 'which parts?', short FROM o
UNION ALL SELECT k, 2, 'assistant', n, '', short FROM o WHERE short
UNION ALL SELECT k, 2 * i, 'assistant', 1, '', short FROM l JOIN o USING (k) WHERE NOT short
UNION ALL SELECT k, CASE WHEN NOT short THEN 2 * i + 1 WHEN i = 1 THEN 3 ELSE i + 1 END, 'tool', 0, 'part ' || part, short FROM l JOIN o USING (k) WHERE NOT (short AND i = 2)
UNION ALL SELECT k, CASE WHEN short THEN n + 2 ELSE 2 * n + 2 END, 'assistant', 0, 'these', short FROM o""")
def one_call_turns(t):
    # outer: else Spark filters by messages first, and makes them thrice
    seen = views.one_call_a_turn(_called(t)).select("l_orderkey", F.posexplode_outer("messages").alias("pos", "m"), F.col("view_error").isNotNull().alias("refused")).where("pos is not null")
    return seen.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "m.role", F.coalesce(F.size("m.tool_calls"), F.lit(0)).cast("long").alias("n_calls"), "m.content", "refused")


@query(f"""{_LINES}
SELECT k AS l_orderkey, 'functools[' || string_agg('{{"name": "look_up", "arguments": {{"part":' || part || '}}}}', ', ' ORDER BY i) || ']' AS content FROM l GROUP BY k""")
def folded_calls(t):
    return views.calls_in_content(_called(t)).select("l_orderkey", F.col("messages")[2]["content"].alias("content"))


@query("""
SELECT conv_id, turn, turn > coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), -1) AS after_last_user FROM conversations""")
def after_last_user(t):
    return dialogs.after_last_user(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "after_last_user")


@query("""
WITH s AS (SELECT 'a' AS model, 1 + 9 * quality AS alignment, 10 - 6 * toxic AS safety FROM labels UNION ALL SELECT 'b', 2 + 7 * quality, CASE WHEN toxic = 1 THEN 3 END FROM labels)
SELECT model, 'alignment' AS dim, round(avg(alignment), 2) AS mean, count(alignment) AS n FROM s GROUP BY model
UNION ALL SELECT model, 'safety', round(avg(safety), 2), count(safety) FROM s GROUP BY model""")
def judge_means(t):
    own = lambda model, alignment, safety: t("labels").select(F.lit(model).alias("model"), alignment.alias("alignment"), safety.alias("safety"))
    a = own("a", 1 + 9 * F.col("quality"), 10 - 6 * F.col("toxic"))
    b = own("b", 2 + 7 * F.col("quality"), F.when(F.col("toxic") == 1, 3))
    return summary.judge_means(a.unionByName(b), ["alignment", "safety"])
