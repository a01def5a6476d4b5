"""Hand-made cases for what the driver's tables cannot show."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF
from dialoom.functions import text as X
from dialoom.functions import values as V
from dialoom.operators import convert, dedup, dialogs, sampling, scoring, validate, views
from dialoom.plans import registry
from dialoom.sources import cache, jsonl, seeds
from dialoom.streaming import streams

MESSAGES = f"dialog_id string, messages array<{dialogs.MESSAGE}>"


def msg(role, content=None, call=None, answer=None):
    calls = None if call is None else [(i, t, (n, a)) for i, t, n, a in call]
    return (role, content, answer, None, calls)


def one(call_id, name="f", args='{"a": 1}', kind="function"):
    return (call_id, kind, name, args)


OK = [msg("system", "s"), msg("user", "u"), msg("assistant", "", [one("1"), one("2")]), msg("tool", "r2", answer="2"), msg("tool", "r1", answer="1"), msg("assistant", "done")]
BROKEN = {
    "messages missing": None,
    "first message is not system": OK[1:],
    "invalid role": [OK[0], msg("robot", "x"), *OK[1:]],
    "user content empty": [OK[0], msg("user", " "), *OK[1:]],
    "missing id": [*OK[:2], msg("assistant", "", [one("")]), OK[-1]],
    "type != function": [*OK[:2], msg("assistant", "", [one("1", kind="x"), one("2")]), *OK[3:]],
    "not in registry: g": [*OK[:2], msg("assistant", "", [one("1", "g"), one("2")]), *OK[3:]],
    "arguments invalid JSON": [*OK[:2], msg("assistant", "", [one("1", args="{"), one("2")]), *OK[3:]],
    "arguments not a JSON object": [*OK[:2], msg("assistant", "", [one("1", args="[1]"), one("2")]), *OK[3:]],
    "duplicate tool_call id 1": [*OK[:2], msg("assistant", "", [one("1"), one("1"), one("2")]), *OK[3:]],
    "tool_call 2 has no tool response": [*OK[:3], *OK[4:]],
    "tool response 9 matches no tool_call id": [*OK[:3], msg("tool", "x", answer="9"), *OK[3:]],
    "no user turns": [OK[0], *OK[2:]],
    "does not end with": OK[:-1],
}


def test_structural(spark):
    df = spark.createDataFrame([("ok", OK), *BROKEN.items()], MESSAGES)
    got = {r[0]: r[1] for r in validate.structural(df, ["f"]).collect()}
    assert got["ok"] == []
    for why in BROKEN:
        assert any(why in x for x in got[why]), (why, got[why])


def test_gate(spark):
    log = "array<struct<name:string,args:string,ok:boolean,error:string>>"
    good, bad = ("f", "1", True, None), ("f", "1", False, None)
    cases = [
        (None, "tool_use", OK, [good]),
        ("tool_use dialog without any successful tool execution", "tool_use", OK, [bad]),
        ("identical failed tool call repeated", "tool_use", OK, [bad, bad, good]),
        ("too many failed tool executions", "tool_use", OK, [("f", str(i), False, None) for i in range(5)] + [good]),
        ("hit tool budget cap", "tool_use", OK, [("f", "1", False, "budget exceeded: 5")]),
        ("no_tool dialog contains tool calls", "no_tool", OK, []),
        ("user turn language mismatch", "tool_use", [OK[0], msg("user", "necesito ir"), *OK[2:]], [good]),
        ("final answer contains raw tool-call markup", "tool_use", [*OK[:-1], msg("assistant", "<tool_call>")], [good]),
        ("error_recovery without error or clarification turn", "error_recovery", OK, [good]),
        ("error_recovery never executed a successful call after the failure", "error_recovery", OK, [good, bad]),
        (None, "error_recovery", OK, [bad, good]),
    ]
    df = spark.createDataFrame([(str(i), c[1], "en", c[2], c[3]) for i, c in enumerate(cases)], f"dialog_id string, mode string, lang string, messages array<{dialogs.MESSAGE}>, exec_log {log}")
    got = {r["dialog_id"]: r["gate"] for r in validate.gate(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [c[0] for c in cases]


def test_views(spark):
    df = spark.createDataFrame([("a", OK), ("b", OK[:4])], MESSAGES)
    split = {r["dialog_id"]: r for r in views.one_call_a_turn(df).collect()}
    assert [m["role"] for m in split["a"]["messages"]] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert [m["tool_calls"][0]["id"] for m in split["a"]["messages"] if m["tool_calls"]] == ["1", "2"]
    assert split["b"]["view_error"]
    folded = views.calls_in_content(df).first()["messages"][2]
    assert folded["tool_calls"] is None and V.calls_in(folded["content"], "functools") == [{"name": "f", "arguments": {"a": 1}}] * 2
    turns = views.alternating(df).first()["messages"]
    assert [m["role"] for m in turns] == ["system", "user", "assistant", "user", "assistant"]
    assert turns[3]["content"].count("<tool_result>") == 2 and len(V.calls_in(turns[2]["content"])) == 2


def test_convert(spark):
    system = 'Tools: [{"name": "f", "parameters": {"type": "object", "properties": {"a": {}}}}]'
    call, reply = ("assistant", "[f(a='x, [y]', b={'k': 1})]"), ("tool", '[{"results": [1]}]')
    cases = {
        "ok": (system, [("user", "u"), call, reply, ("assistant", "done")]),
        "tools_extract_fail": ("none", []),
        "tools_normalize_fail": ("[1]", []),
        "empty_assistant": (system, [("assistant", " ")]),
        "call_parse_fail": (system, [("assistant", "[f]")]),
        "empty_call_list": (system, [("assistant", "[]")]),
        "call_name_not_in_tools": (system, [("assistant", "[g(a=1)]")]),
        "answer_before_results": (system, [call, ("assistant", "x")]),
        "tool_json_fail": (system, [call, ("tool", "{")]),
        "result_count_mismatch": (system, [call, ("tool", "[1, 2]")]),
        "dangling_calls": (system, [call]),
        "no_assistant_turn": (system, [("user", "u")]),
        "unknown_role_x": (system, [("x", "u")]),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "uid string, system string, conversations array<struct<from:string,value:string>>")
    got = {r["uid"]: r for r in convert.foreign(df).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: k for k in cases}
    made = json.loads(got["ok"]["messages"])
    assert json.loads(made[2]["tool_calls"][0]["function"]["arguments"]) == {"a": "x, [y]", "b": {"k": 1}} and made[3]["content"] == "[1]"


def test_single_turn(spark):
    tools = '[{"function": {"name": "f"}}]'
    call = "<tool_call>\\n{'name': '%s', 'arguments': {'a': True}}\\n</tool_call>"
    rows = [("kept", tools, [("human", "u"), ("gpt", call % "f")]), ("tools_parse_fail", "x", [("human", "u")]), ("no_user_turn", tools, [("human", " ")]), ("no_calls", tools, [("human", "u"), ("gpt", "x")]), ("name_not_in_tools", tools, [("human", "u"), ("gpt", call % "g")])]
    df = spark.createDataFrame(rows, "id string, tools string, conversations array<struct<from:string,value:string>>")
    assert all(r["id"] == r["reason"] for r in convert.single_turn(df).collect())


def test_matching():
    near, far = {"lat": 52.0, "lon": 21.0}, {"lat": 52.01, "lon": 21.0}
    assert V.matches(near, "52.004,21.0") and not V.matches(near, far) and V.matches([52.0, 21.0], near)
    assert V.matches(100, 102) and not V.matches(100, 102.1) and V.matches(" Ab", "aB ") and not V.matches(True, 1.5)
    assert V.argument_fraction("{}", "{}") == 1.0 and V.argument_fraction('{"a": 1}', None) == 0.0
    assert V.argument_fraction('{"origin": "52.0,21.0", "mode": "car"}', '{"origin": [52.0, 21.0], "mode": "bus"}') == 0.5
    assert json.loads(V.normal_arguments("tomtom-routing", '{"origin": [21.0, 52.0], "x": null}')) == {"origin": {"lat": 52.0, "lon": 21.0}}
    assert json.loads(V.compact_payload('{"geometry": 1, "a": "52.5", "l": [1,2,3,4,5,6,7,8,9]}')) == {"a": 52.5, "l": [1, 2, 3, 4, 5, 6, 7, 8]}
    assert V.calls_in("<function=f>\n<parameter=a>\n1\n</parameter>\n</function>") == [{"name": "f", "arguments": {"a": 1}}]
    assert V.calls_in('<|start_header_id|>assistant<|end_header_id|>\n\n{"name": "f", "parameters": {}}<|eot_id|>') == [{"name": "f", "arguments": {}}]
    assert V.calls_in('functools[{"name": "f", "arguments": {"a": "]"}}]')[0]["arguments"] == {"a": "]"}


def test_greedy(spark):
    edges = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.9), (3, 4, 0.8), (1, 5, 0.6)], "a long, b long, similarity double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    got = {r["id"]: (r["kept"], r["sim_max"]) for r in dedup.greedy(edges, nodes).collect()}
    assert got == {1: (True, 0.0), 2: (False, 0.7), 3: (True, 0.0), 4: (False, 0.8), 5: (False, 0.6), 6: (True, 0.0)}
    # a row that failed before neither stays nor blocks
    got = {r["id"]: r["kept"] for r in dedup.greedy(edges, nodes.where("id <> 1")).collect()}
    assert got == {2: True, 3: False, 4: True, 5: True, 6: True}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x"}\n\nnot json\n{"id": "ż"}\n')
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("id", StringType())])
    df = jsonl.read_tolerant(spark, str(p), schema).cache()
    assert {r[0] for r in jsonl.good(df).collect()} == {"x", "ż"} and jsonl.bad_count(df).first()["n_bad"] == 1
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        jsonl.read_strict(spark, str(p), schema).collect()
    lines = {r["src_line"]: r["row"] for r in jsonl.read_numbered(spark, str(p), "id string").collect()}
    assert lines[1]["id"] == "x" and lines[4]["id"] == "ż" and set(lines) == {1, 3, 4}
    jsonl.write(jsonl.good(df), f"{tmp_path}/out")
    assert jsonl.read_strict(spark, f"{tmp_path}/out", schema).count() == 2
    (tmp_path / "b.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert jsonl.read_array(spark, f"{tmp_path}/b.json", schema).count() == 2
    both = jsonl.union_in_order([jsonl.good(df), jsonl.good(df).withColumn("n", F.lit(1))])
    assert {(r["source_ord"], r["n"]) for r in both.collect()} == {(0, None), (1, 1)}
    assert "| n_lines |" in jsonl.markdown({"Lines": jsonl.bad_count(df)})


def test_seeds(spark):
    rows = [("plain text",), ('{""origin"": ""A"", ""destination"": {""lat"": 1.5, ""lng"": 2.5}}',), ('{"arguments": {"origin": {"name": "A"}, "destination": {"address": "B"}}}',), ("{broken",), ('{"origin": "A"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(seeds.seed_text(F.col("t"))).collect()]
    assert got == ["plain text", "route from A to 1.5,2.5", "route from A to B", None, None]


def test_small_functions(spark):
    row = spark.range(1).select(V.cache_key_of(F.lit('{"provider": "here", "name": "f", "args": {"b": 1, "a": "ż"}}')).alias("k"), V.canonical_json(F.lit('{"b": 2.0, "a": 1}')).alias("c"), X.capped_payload(F.lit(False), F.lit("x"), F.lit("bad key=abcdefgh")).alias("p"), X.clamp_score(F.lit("11")).alias("s")).first()
    assert row["k"].startswith("v1:here:f:") and row["c"] == '{"a": 1, "b": 2.0}' and row["p"] == '{"error":"bad key=***"}' and row["s"] == 10.0
    log = spark.createDataFrame([("k", True)], "cache_key string, ok boolean").withColumn("error", F.lit(None).cast("string"))
    assert cache.replay(spark.createDataFrame([("z",)], "cache_key string"), log).first()["cached"] is False
    items = spark.createDataFrame([("g", ["a", "b", "c", "d"], [(1, "f", "x"), (1, "f", "x"), (4, "f", "y")])], "gold_id string, user_turns array<string>, calls array<struct<step:int,name:string,args:string>>")
    r = convert.reference_calls(items).first()
    assert r["accepted"] and r["trimmed_user_turns"] and len(r["calls"]) == 1 and len(r["user_turns"]) == 3


def test_split_bounds(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b" if i < 3 else "c") for i in range(30)], "id long, s string")
    got = {(r["s"], r["split"]): r["count"] for r in sampling.stratified_split(df, ["s"], 0.05).groupBy("s", "split").count().collect()}
    assert got == {("a", "val"): 1, ("a", "train"): 1, ("b", "train"): 1, ("c", "val"): 1, ("c", "train"): 26}


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, i), 1.0 if i else 0.0) for i in range(60)] + [("k", datetime(2024, 1, 1, 0, 5), 1.0)], "key string, at timestamp, v double")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: streams.files(spark, f"{tmp_path}/in", src.schema, "parquet")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(streams.first_seen(read(), ["key", "at"], "at", "1 hour"), "seen")) == 60
    alerts = run(streams.stalls(read(), "key", "at", "v", gap_s=25 * 60, throttle_s=30 * 60), "stalls")
    assert [a["at"].minute for a in sorted(alerts, key=lambda a: a["at"])] == [27, 57]
    rates = run(streams.rates(read(), "at", "30 minutes", "1 minute", "key", "v < 1"), "rates", "update")
    assert sum(r["n"] for r in rates) == 61 and sum(r["n_bad"] for r in rates) == 1


def test_near_texts_take_little_room(spark, tmp_path):
    """No step shuffles or stores a row for each gram of each text, and groups of copies and of near copies come out whole."""
    import random

    pick = random.Random(1)
    word = lambda: "".join(pick.choices("abcdefghij", k=6))
    base = [word() for _ in range(60)]
    texts = [" ".join(base[:i] + [word()] + base[i + 1:]) for i in range(0, 60, 2)] + [" ".join(base)] * 20 + ["a b c d"] * 3 + ["a b c d e", "A b c d e", "", None]
    texts += [" ".join(word() for _ in range(400)) for _ in range(300)]
    pick.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = {i: {tuple(w[at:at + 5]) for at in range(len(w) - 4)} for i, w in ((i, (t or "").lower().split()) for i, t in enumerate(texts))}
    want = {(a, b): len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.6}
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.jaccard_edges(df, "id", "text", 0.6).collect()}
    assert got == want and len(want) > 600
    kept, most = [], {}
    for i in range(len(texts)):
        most[i] = max((want[k, i] for k in kept if (k, i) in want), default=0.0)
        kept += [] if most[i] else [i]
    rows = {r["id"]: (r["kept"], r["sim_max"]) for r in dedup.kept_texts(df, "id", "text", 0.6).collect()}
    assert rows == {i: (i in kept, most[i]) for i in range(len(texts))}
    # what is stored of 300 texts of 400 words that are near to nothing
    spark.sparkContext._jvm.System.gc()
    lone = df.where(F.length("text") > 2000)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(p.stat().st_size for p in Path(at).rglob("part-*"))
    before = size()
    edges = dedup.jaccard_edges(lone, "id", "text", 0.6)
    assert edges.count() == 0 and size() - before < 100_000


def test_one_call_view_makes_messages_once(spark):
    """What the query makes of its tables is in the plan once. Results beyond the calls, and many turns, stay as they were."""
    for name in ("one_call_turns", "unanswered_calls"):
        assert registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("which parts?") == 1
    text = F.concat(F.lit("made once "), F.col("id").cast("string"))
    turn = lambda role, i, calls: F.struct(F.lit(role).alias("role"), text.alias("content"), i.cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"), calls.cast(f"array<{dialogs.CALL}>").alias("tool_calls"))
    call = lambda i: F.struct(i.cast("string").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")).alias("function"))
    none = F.lit(None)
    asked = lambda i: F.array(turn("assistant", i, F.array(call(2 * i), call(2 * i + 1))), turn("tool", 2 * i, none), turn("tool", 2 * i + 1, none), turn("tool", i, none), turn("user", i, none))
    df = spark.range(2).select("id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(199)), asked)).alias("messages"))
    for r in views.one_call_a_turn(df).collect():
        assert r["view_error"] is None and [m["role"] for m in r["messages"]] == ["assistant", "tool", "assistant", "tool", "tool", "user"] * 200
        assert [m["tool_calls"][0]["id"] for m in r["messages"] if m["tool_calls"]] == [str(i) for i in range(400)]


def test_fractions_of_equal_arguments_once():
    """A pair of texts that repeats is compared once; null and what is no text stay what they were."""
    import pandas as pd

    seen = []
    f = lambda a, b: seen.append((a, b)) or V.argument_fraction(a, b)
    a, b = ['{"a": 1}', None, '{"a": 1}', None] * 50, ['{"a": 1}', '{"a": 1}', None, None] * 50
    assert V.each_distinct(f, pd.Series(a), pd.Series(b)).tolist() == [V.argument_fraction(x, y) for x, y in zip(a, b)] and len(seen) == 4
    assert V.each_distinct(f, pd.Series([], dtype=object), pd.Series([], dtype=object)).tolist() == []


GOLD = "gold_id long, language string, mode string, ood boolean, tools array<string>, ref array<struct<step:long,name:string,args:string>>"
ROLL = "gold_id long, parse_ok boolean, hops_used int, fallback_parse int, answers array<string>, calls array<struct<step:long,name:string,args:string,ok:boolean,provider:string>>"
A, B = '{"a": 1}', '{"a": 2}'
#: ref, calls, and then strict, as a set, argument accuracy
SCORES = [
    ([(1, "f", A), (1, "f", B)], [(1, "f", A), (1, "f", B)], (True, True, 1.0)),
    ([(1, "f", A), (1, "f", B)], [(1, "f", B), (1, "f", A)], (True, True, 0.0)),  # in the order in which they come
    ([(1, "f", A), (1, "g", A)], [(1, "g", A), (1, "f", A)], (False, True, 1.0)),
    ([(2, "f", A), (1, "g", A)], [(1, "g", A), (2, "f", A)], (True, True, 1.0)),  # other steps
    ([(1, "f", A)], [(1, "f", A), (2, "f", A)], (False, False, 1.0)),
    ([(None, "f", A)], [(None, "f", A)], (False, False, 0.0)),  # null is no step
    ([(1, None, A)], [(1, None, A)], (True, True, 0.0)),
    ([(2**60, "f", A)], [(2**60 + 1, "f", A)], (False, False, 0.0)),
    ([], [(1, "f", A)], (False, False, None)),
    (None, None, (False, False, None)),
]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def scored_case(spark):
    gold = spark.createDataFrame([(i, "en", "tool_use", False, ["f"], r) for i, (r, _, _) in enumerate(SCORES)], GOLD)
    calls = lambda c: None if c is None else [(*x, True, "here") for x in c]
    return gold, spark.createDataFrame([(i, True, 1, 0, ["x"], calls(c)) for i, (_, c, _) in enumerate(SCORES)], ROLL)


def test_items_in_their_rows(spark):
    """Items are scored without a shuffle but that of the join."""
    got = scoring.items(*scored_case(spark))
    assert shuffles(got) <= 2
    assert {r["gold_id"]: (r["tool_selection_strict"], r["tool_selection_set"], r["arg_accuracy"]) for r in got.collect()} == {i: w for i, (_, _, w) in enumerate(SCORES)}


def test_providers_in_their_rows(spark):
    """Providers' ratios need no shuffle but that of the join and of the few sums."""
    got = scoring.providers(*scored_case(spark))
    assert shuffles(got) <= 3
    assert [tuple(r) for r in got.collect()] == [("other", 12, 14, 0.5, 1.0)]


def test_score_queries_shuffle_lines_once(spark):
    """Lines are gathered by order once; the rollup and the providers shuffle their sums besides."""
    assert [shuffles(registry.QUERIES[q](spark, SF)) for q in ("scored_items", "score_rollup", "provider_scores")] == [1, 2, 2]
