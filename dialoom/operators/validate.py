"""Verification stages. A stage is a column of reasons (an array, empty if it passes) or a frame keyed by dialogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from . import dialogs

ROLES = ("system", "user", "assistant", "tool")


def reasons(*tests: tuple[Column, Column | str]) -> Column:
    """The texts of the tests that hold, in order."""
    said = F.array(*(F.when(hit, F.lit(why) if isinstance(why, str) else why) for hit, why in tests))
    # mostly none holds
    return F.when(reduce(or_, (hit for hit, _ in tests)), F.filter(said, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def structural(df: DataFrame, tools: Sequence[str], id_col: str = "dialog_id") -> DataFrame:
    """dialog_id and reasons. One pass over the nested messages, no shuffle: pairing is set arithmetic inside the row."""
    at = lambda i: F.concat(F.lit("msg["), i.cast("string"), F.lit("] "))

    def call_reasons(c: Column, i: Column) -> Column:
        return dialogs.bound(F.try_parse_json(c["function"]["arguments"]), lambda args: reasons(
            (F.coalesce(c["id"], F.lit("")) == "", F.concat(at(i), F.lit("tool_call missing id"))),
            (~c["type"].eqNullSafe("function"), F.concat(at(i), F.lit("tool_call type != function"))),
            (~F.coalesce(c["function"]["name"].isin(list(tools)), F.lit(False)), F.concat(at(i), F.lit("tool_call name not in registry: "), F.coalesce(c["function"]["name"], F.lit("null")))),
            (c["function"]["arguments"].isNull(), F.concat(at(i), F.lit("tool_call arguments not a JSON string"))),
            (c["function"]["arguments"].isNotNull() & args.isNull(), F.concat(at(i), F.lit("tool_call arguments invalid JSON"))),
            (args.isNotNull() & ~F.ltrim(c["function"]["arguments"]).startswith("{"), F.concat(at(i), F.lit("tool_call arguments not a JSON object"))),
        ))

    def message_reasons(x: Column, i: Column) -> Column:
        own = reasons(
            (~F.coalesce(x["role"].isin(*ROLES), F.lit(False)), F.concat(at(i), F.lit("invalid role "), F.coalesce(x["role"], F.lit("null")))),
            (F.coalesce(x["role"].isin("user", "system", "tool"), F.lit(False)) & _blank(x["content"]), F.concat(at(i), x["role"], F.lit(" content empty"))),
            ((x["role"] == "tool") & (F.coalesce(x["tool_call_id"], F.lit("")) == ""), F.concat(at(i), F.lit("tool message missing tool_call_id"))),
        )
        calls = F.when(x["role"] == "assistant", F.flatten(F.transform(F.coalesce(x["tool_calls"], F.array().cast(f"array<{dialogs.CALL}>")), lambda c: call_reasons(c, i))))
        return F.concat(own, F.coalesce(calls, F.array().cast("array<string>")))

    def unmatched(ids: Column, answers: Column) -> Column:
        return F.concat(
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.transform(dialogs.bound(F.sort_array(ids), lambda o: F.array_intersect(ids, F.filter(o, lambda c, i: c == F.get(o, i + 1)))), lambda c: F.concat(F.lit("duplicate tool_call id "), c))).otherwise(F.array().cast("array<string>")),
            F.transform(F.array_except(ids, answers), lambda c: F.concat(F.lit("tool_call "), c, F.lit(" has no tool response"))),
            F.transform(F.array_except(answers, ids), lambda c: F.concat(F.lit("tool response "), c, F.lit(" matches no tool_call id"))),
        )

    def found_in(m: Column) -> Column:
        ids = F.filter(F.flatten(F.transform(F.filter(m, lambda x: (x["role"] == "assistant") & x["tool_calls"].isNotNull()), lambda x: x["tool_calls"]["id"])), lambda c: F.coalesce(c, F.lit("")) != "")
        answers = F.filter(F.transform(F.filter(m, lambda x: x["role"] == "tool"), lambda x: x["tool_call_id"]), lambda c: F.coalesce(c, F.lit("")) != "")
        last = F.element_at(m, -1)
        found = F.concat(
            reasons((~F.get(m, F.lit(0))["role"].eqNullSafe("system"), "first message is not system")),
            F.flatten(F.transform(m, message_reasons)),
            dialogs.bound(ids, lambda i: dialogs.bound(answers, lambda a: unmatched(i, a))),
            reasons((~F.exists(m, lambda x: x["role"].eqNullSafe("user")), "no user turns"), (~(last["role"].eqNullSafe("assistant")) | _blank(last["content"]), "does not end with non-empty assistant text")),
        )
        none = F.array(F.lit("messages missing or not a list"))
        return F.when(F.coalesce(F.size(m), F.lit(0)) < 1, none).otherwise(found)

    return df.select(F.col(id_col).alias("dialog_id"), dialogs.bound(F.col("messages"), found_in).alias("reasons"))


def schema(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls(dialog_id, call_id, name, arguments) against schemas(name, parameters): dialog_id, call_id, faults, extra. Arguments are brought into the tools' form first; the registry is broadcast by size."""
    known = schemas.select(F.col("name").alias("s_name"), "parameters")
    both = calls.join(known, F.col("name") == F.col("s_name")).withColumn("norm", V.normal_arguments_of("name", "arguments"))
    return both.select("dialog_id", "call_id", V.schema_faults_of("norm", "parameters").alias("faults"), V.extra_keys_of("norm", "parameters").alias("extra")).where("faults is not null")


def replayed(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """calls(dialog_id, name, cache_key, ok) with outcome: unknown_tool, failed (recorded ok, replay not), recovered (the other way), same, or not_replayed."""
    r = results.select(F.col("cache_key").alias("r_key"), F.col("ok").alias("r_ok"))
    t = tools.select(F.col("name").alias("t_name")).distinct()
    both = calls.join(r, F.col("cache_key") == F.col("r_key"), "left").join(t, F.col("name") == F.col("t_name"), "left")
    return both.select("dialog_id", "name", "ok", F.when(F.col("t_name").isNull(), "unknown_tool").when(F.col("r_ok").isNull(), "not_replayed").when(F.col("ok") & ~F.col("r_ok"), "failed").when(~F.col("ok") & F.col("r_ok"), "recovered").otherwise("same").alias("outcome"))


def secrets(df: DataFrame, text_col: str) -> DataFrame:
    """df with n_secrets and the text scrubbed."""
    return df.withColumns({"n_secrets": X.secret_count(F.col(text_col)), text_col: X.scrub(F.col(text_col))})


def language(turns: DataFrame, declared: str = "lang", text_col: str = "text") -> DataFrame:
    """turns with guess, score and mismatch. Tokens are made once, in a projection that Spark keeps apart."""
    tokens = turns.withColumn("tokens", X.language_tokens(F.col(text_col)))
    scored = tokens.withColumn("scores", X.language_scores(F.col(text_col), F.col("tokens")))
    return scored.withColumns({"guess": X.language_guess(F.col("scores")), "mismatch": X.language_mismatch(F.col(declared), F.col("scores"))}).drop("tokens")


def reconcile_language(flagged: Column, judged: Column, declared: Column) -> Column:
    """Whether a flagged dialogue fails: it does unless a judge agrees with what is declared."""
    return flagged & F.coalesce(judged != declared, F.lit(True))


def judges(scores: DataFrame, dims: Sequence[str], least_mean: float = 7.0, least_dim: float = 5.0, n_judges: int = 2) -> DataFrame:
    """scores(id, model, dims...) -> id, min_avg, min_dim, n_judges, passed, note. Scores are clamped to 1..10."""
    clean = [X.clamp_score(F.col(d)) for d in dims]
    one = scores.select("id", F.array_min(F.array(*clean)).alias("low"), (sum(clean[1:], clean[0]) / len(clean)).alias("avg"))
    return one.groupBy("id").agg(F.min("avg").alias("min_avg"), F.min("low").alias("min_dim"), F.count("avg").alias("n_judges")).withColumn("passed", (F.col("min_avg") >= least_mean) & (F.col("min_dim") >= least_dim) & (F.col("n_judges") > 0)).withColumn("note", F.when(F.col("n_judges") < n_judges, "judge missing"))


def failure_order(log: DataFrame, key: str, order: Sequence[str], ok: str = "ok") -> DataFrame:
    """For each key: failures, and whether any success follows the first failure. One aggregate, no window: struct maxima keep the order."""
    at = F.struct(*order)
    return log.groupBy(key).agg(F.count_if(~F.col(ok)).alias("n_failed"), F.coalesce(F.max(F.when(F.col(ok), at)) > F.min(F.when(~F.col(ok), at)), F.lit(False)).alias("recovered"))


def repeated_failures(log: DataFrame, key: str, same: Sequence[str], ok: str = "ok") -> DataFrame:
    """Keys with two failures alike in all of `same`."""
    return log.where(~F.col(ok)).groupBy(key, *same).agg(F.count("*").alias("n")).groupBy(key).agg((F.max("n") > 1).alias("repeated"))


RAW_MARKUP = r"<(?:function|tool)_call\b|\"(?:arguments|tool_calls)\"\s*:|\btool_call\b"


def gate(df: DataFrame) -> DataFrame:
    """df(dialog_id, mode, lang, messages, exec_log array<struct<name,args,ok,error>>) with gate: the first rule that a dialogue breaks, or null."""
    m, log = F.col("messages"), F.col("exec_log")
    users = F.filter(m, lambda x: x["role"] == "user")
    other = F.coalesce(*(F.get(F.transform(users, lambda x: X.phrase_mismatch(F.col("lang"), F.coalesce(x["content"], F.lit("")))), F.lit(i)) for i in (0, 1)))
    n_calls = F.size(F.filter(m, lambda x: F.coalesce(F.size(x["tool_calls"]), F.lit(0)) > 0))
    last = F.element_at(m, -1)
    failed = F.filter(log, lambda e: ~e["ok"])
    keys = F.transform(failed, lambda e: F.concat_ws("\x01", e["name"], e["args"]))
    n_ok = F.size(log) - F.size(failed)
    first = F.array_position(F.transform(log, lambda e: e["ok"]), F.lit(False))
    after = F.exists(F.slice(log, F.greatest(first, F.lit(1)).cast("int"), F.size(log) + 1), lambda e: e["ok"])
    raw = F.coalesce(last["content"], F.lit("")).rlike(RAW_MARKUP)
    mode = F.col("mode")
    why = (
        F.when(F.size(users) == 0, "no user turns")
        .when(other.isNotNull(), "user turn language mismatch")
        .when((last["role"] != "assistant") | _blank(last["content"]), "missing final assistant answer")
        .when(raw, "final answer contains raw tool-call markup")
        .when(F.exists(log, lambda e: F.coalesce(e["error"], F.lit("")).contains("budget exceeded")), "hit tool budget cap")
        .when(mode == "no_tool", F.when(n_calls > 0, "no_tool dialog contains tool calls"))
        .when(mode == "tool_use", F.when(n_calls == 0, "tool_use dialog without any tool call").when(n_ok == 0, "tool_use dialog without any successful tool execution").when(F.size(failed) > 4, "too many failed tool executions").when(F.size(keys) != F.size(F.array_distinct(keys)), "identical failed tool call repeated"))
        .when((F.size(failed) == 0) & (F.size(users) < 2), "error_recovery without error or clarification turn")
        .when((F.size(failed) > 0) & ~after, "error_recovery never executed a successful call after the failure")
    )
    return df.withColumn("gate", why)


def streaks(log: DataFrame, key: str, order: Sequence[str], bad: Column, least: int = 3) -> DataFrame:
    """Runs of `least` or more bad rows in a row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    run = log.withColumn("bad", bad).withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("bad").groupBy(key, "island").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first")).where(F.col("n") >= least)
