"""Message views for training templates, and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialogs import bound


def _args(call: Column) -> Column:
    """Arguments as a JSON value in text, compact; what does not parse is an empty object."""
    return F.coalesce(F.to_json(F.try_parse_json(call["function"]["arguments"])), F.lit("{}"))


def _object(call: Column) -> Column:
    return F.concat(F.lit('{"name": "'), call["function"]["name"], F.lit('", "arguments": '), _args(call), F.lit("}"))


def identity(df: DataFrame) -> DataFrame:
    return df


def one_call_a_turn(df: DataFrame) -> DataFrame:
    """Assistant turns of k calls become k turns with a call each, its result behind it. view_error if the results are not k.

    Messages are made once: a lambda binds them. Where all results are there, those of several turns do not overlap, so
    what is between two such turns stays as it is, and the work is linear in a dialogue."""
    k = lambda x: F.when(x["role"] == "assistant", F.coalesce(F.size(x["tool_calls"]), F.lit(0))).otherwise(0)

    def single(x: Column, c: Column) -> Column:
        return F.struct(x["role"].alias("role"), x["content"].alias("content"), x["tool_call_id"].alias("tool_call_id"), x["name"].alias("name"), F.array(c).alias("tool_calls"))

    def split(m: Column, many: Column) -> Column:
        """many: at (position) and k of each turn of several calls, in order."""
        calls = lambda i: F.flatten(F.transform(m[i]["tool_calls"], lambda c, n: F.array(single(m[i], c), F.get(m, i + n + 1))))
        behind = lambda x, n: x["at"] + x["k"] + 1
        rest = lambda x, n: F.slice(m, behind(x, n) + 1, F.coalesce(F.get(many, n + 1)["at"], F.size(m)) - behind(x, n))
        return F.concat(F.slice(m, F.lit(1), many[0]["at"]), F.flatten(F.transform(many, lambda x, n: F.concat(calls(x["at"]), rest(x, n)))))

    def viewed(m: Column, many: Column) -> Column:
        full = lambda x: F.size(F.filter(F.slice(m, x["at"] + 2, x["k"]), lambda r: r["role"] == "tool")) == x["k"]
        short = F.exists(many, lambda x: ~full(x))
        return bound(short, lambda s: F.struct(F.when(s, "results do not match calls").alias("view_error"), F.when(s | (F.size(many) == 0), m).otherwise(split(m, many)).alias("messages")))

    several = lambda m: F.filter(F.transform(m, lambda x, i: F.struct(i.alias("at"), k(x).alias("k"))), lambda x: x["k"] > 1)
    view = bound(F.col("messages"), lambda m: bound(several(m), lambda many: viewed(m, many)))
    return df.withColumn("_view", view).withColumns({"view_error": F.col("_view.view_error"), "messages": F.col("_view.messages")}).drop("_view")


def calls_in_content(df: DataFrame) -> DataFrame:
    """Calls folded into the assistant's text as functools[...]."""

    def fold(x: Column) -> Column:
        block = F.concat(F.lit("functools["), F.concat_ws(", ", F.transform(x["tool_calls"], _object)), F.lit("]"))
        text = F.concat_ws("\n", F.nullif(x["content"], F.lit("")), block)
        return F.when((x["role"] == "assistant") & (F.size(x["tool_calls"]) > 0), x.withField("content", text).withField("tool_calls", F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))).otherwise(x)

    return df.withColumn("messages", F.transform("messages", fold))


def alternating(df: DataFrame) -> DataFrame:
    """Strict alternation: what stands between assistant turns is one user turn; calls and results become tagged blocks. array<struct<role, content>>."""
    m = F.col("messages")

    def text(x: Column) -> Column:
        blocks = F.transform(x["tool_calls"], lambda c: F.concat(F.lit("<tool_call>\n"), _object(c), F.lit("\n</tool_call>")))
        return F.when(x["role"] == "assistant", F.concat_ws("\n", F.nullif(x["content"], F.lit("")), F.concat_ws("\n", F.filter(blocks, lambda b: b.isNotNull())))).when(x["role"] == "tool", F.concat(F.lit("<tool_result>\n"), F.coalesce(x["content"], F.lit("")), F.lit("\n</tool_result>"))).otherwise(F.coalesce(x["content"], F.lit("")))

    kind = lambda x: F.when(x["role"].isin("system", "assistant"), x["role"]).otherwise("user")
    start = F.array().cast("array<struct<role:string,content:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(kind(x).alias("role"), F.regexp_replace(text(x), r"\n$", "").alias("content"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n", last["content"], one["content"]).alias("content"))))
        return F.when((F.size(acc) > 0) & (kind(x) == "user") & (F.try_element_at(acc, F.lit(-1))["role"] == "user"), joined).otherwise(F.concat(acc, F.array(one)))

    return df.withColumn("messages", F.aggregate(m, start, step))


VIEWS = {"identity": identity, "one_call_a_turn": one_call_a_turn, "calls_in_content": calls_in_content, "alternating": alternating}


def segments(df: DataFrame) -> DataFrame:
    """segments array<struct<text, train>>: each message as text; only assistant text is trained on."""
    seg = F.transform("messages", lambda x: F.struct(F.concat(F.lit("<|"), x["role"], F.lit("|>"), F.coalesce(x["content"], F.lit("")), F.lit("\n")).alias("text"), (x["role"] == "assistant").alias("train")))
    return df.withColumn("segments", seg)


def labels(df: DataFrame, token: str = r"\S+|\s+") -> DataFrame:
    """n_tokens and n_trained: a token is trained if it lies within one trained segment. Offsets and spans stay in the row, no range join."""
    seg = F.col("segments")
    ends = F.aggregate(seg, F.array().cast("array<int>"), lambda acc, s: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(s["text"]))))
    spans = F.filter(F.transform(seg, lambda s, i: F.struct(s["train"].alias("train"), (F.get(F.col("_ends"), i) - F.length(s["text"])).alias("a"), F.get(F.col("_ends"), i).alias("z"))), lambda s: s["train"])
    toks = F.regexp_extract_all(F.concat_ws("", F.transform(seg, lambda s: s["text"])), F.lit(f"({token})"), F.lit(1))
    stops = F.aggregate(F.col("_toks"), F.array().cast("array<int>"), lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(t))))
    inside = F.filter(F.transform(F.col("_toks"), lambda t, i: F.struct((F.get(F.col("_stops"), i) - F.length(t)).alias("a"), F.get(F.col("_stops"), i).alias("z"))), lambda t: F.exists(F.col("_spans"), lambda s: (s["a"] <= t["a"]) & (t["z"] <= s["z"])))
    return df.withColumn("_ends", ends).withColumn("_spans", spans).withColumn("_toks", toks).withColumn("_stops", stops).withColumns({"n_tokens": F.size("_toks"), "n_trained": F.size(inside)}).drop("_ends", "_spans", "_toks", "_stops")


def stripped(df: DataFrame) -> DataFrame:
    """Tool schemas reduced to their names."""
    return df.withColumn("tool_names", F.transform("tools", lambda t: t["function"]["name"])).drop("tools")
