"""Dialogues: nested messages[] and the flat form (dialog_id, pos, role, content, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,name:string,tool_calls:array<{CALL}>>"


def alias(*names: str, default: str | None = None) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), F.lit(default))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once; Spark may else make it again wherever f uses it."""
    return F.transform(F.array(value), f)[0]


def passed(verdict: Column) -> Column:
    """Of a verdict as JSON text: absent passes, a boolean is itself, an object passes if its passed is true, all else fails."""
    t = F.trim(verdict)
    member = F.to_json(F.try_variant_get(F.try_parse_json(verdict), "$.passed", "variant"))
    return F.when(verdict.isNull() | (t == "null"), True).otherwise((t == "true") | F.coalesce(member == "true", F.lit(False)))


def flat(df: DataFrame, id_col: str = "dialog_id") -> DataFrame:
    return df.select(F.col(id_col).alias("dialog_id"), F.posexplode("messages").alias("pos", "m")).select("dialog_id", "pos", "m.*")


def calls(df: DataFrame, id_col: str = "dialog_id") -> DataFrame:
    """dialog_id, pos, call_idx, call_id, type, name, arguments."""
    return flat(df, id_col).select("dialog_id", "pos", F.posexplode("tool_calls").alias("call_idx", "c")).select("dialog_id", "pos", "call_idx", F.col("c.id").alias("call_id"), F.col("c.type").alias("type"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def nested(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """One row a key with messages[] in order. A dialogue must fit in a row."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("messages"))


def _run(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def with_step(df: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """step: user turns up to and with this one."""
    return df.withColumn("step", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(_run(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def after_last_user(df: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """after_last_user: whether a turn stands behind the dialogue's last user turn, where thinking is shown; without user turns all do."""
    last = F.max(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("after_last_user", F.coalesce(F.col(order) > last, F.lit(True)))


def folded(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Turns between assistant turns joined to one by line ends; strict alternation."""
    w = _run(key, order).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col(role) == "assistant", 1).otherwise(0)
    marked = df.withColumn("island", 2 * F.sum(mine).over(w) - mine)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(key, "island").agg(F.min(order).alias("first_pos"), F.count("*").alias("n_turns"), F.concat_ws("\n", F.transform(parts, lambda p: p["t"])).alias("content"), F.max(F.when(F.col(role) == "assistant", "assistant").otherwise("user")).alias("role"))


def ends(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """First user text, last role and last non-blank assistant text of each dialogue, in one aggregate."""
    said = F.when((F.col(role) == "assistant") & (F.trim(text) != ""), F.col(order))
    return df.groupBy(key).agg(F.min_by(text, F.when(F.col(role) == "user", F.col(order))).alias("first_user"), F.max_by(role, order).alias("last_role"), F.max_by(text, said).alias("last_answer"))


def recent(messages: Column, n: int = 8, chars: int = 300) -> Column:
    """The last n messages, cut, as a context."""
    return F.transform(F.slice(messages, F.greatest(F.size(messages) - n + 1, F.lit(1)), F.lit(n)), lambda m: F.concat(m["role"], F.lit(": "), F.left(m["content"], F.lit(chars))))


def transcript(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text", caps: tuple[tuple[str, int], ...] = (("assistant", 4000), ("tool", 300)), cap: int = 2000) -> DataFrame:
    """Dialogue as text, each turn cut by its role."""
    most = F.coalesce(*(F.when(F.col(role) == r, F.lit(n)) for r, n in caps), F.lit(cap))
    line = F.concat(F.upper(role), F.lit(": "), F.left(F.col(text), most))
    return df.groupBy(key).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda p: p["t"])).alias("transcript"))
