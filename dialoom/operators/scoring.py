"""Scoring candidate tool calls against references, and rolling the scores up."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import values as V
from .dialogs import bound


def paired(ref: DataFrame, cand: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """ref with the candidate's columns (c_ in front): the k-th reference of a key meets the k-th candidate of it."""
    w = Window.partitionBy(*keys).orderBy(order)
    c = cand.select(*keys, F.row_number().over(w).alias("ordinal"), *[F.col(x).alias(f"c_{x}") for x in cand.columns if x not in keys])
    return ref.withColumn("ordinal", F.row_number().over(w)).join(c, [*keys, "ordinal"], "left")


def selection(ref: DataFrame, cand: DataFrame, item: str, step: str, name: str, order: str) -> DataFrame:
    """item, strict (same names in the same order in every step) and as_set (same names). Items without references are false."""
    def by_step(df: DataFrame, to: str) -> DataFrame:
        return df.groupBy(item, step).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias(to))

    none = F.array().cast("array<string>")
    both = by_step(ref, "r").join(by_step(cand, "c"), [item, step], "full_outer").withColumns({"r0": F.coalesce("r", none), "c0": F.coalesce("c", none)})
    same_set = F.array_sort(F.array_distinct("r0")) == F.array_sort(F.array_distinct("c0"))
    return both.groupBy(item).agg((F.bool_and(F.col("r0") == F.col("c0")) & (F.count("r") > 0)).alias("strict"), (F.bool_and(same_set) & (F.count("r") > 0)).alias("as_set"))


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the values of both, equal for equal ones (null too), and how many there are."""
    both = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode")
    at = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return at[: len(a)], at[len(a):], len(both.dictionary)


def _ordinals(key: np.ndarray) -> np.ndarray:
    """The how-manieth of its key each element is, from 0."""
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(key) else np.zeros(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[by] = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return out


def judged(ref: pa.Array, calls: pa.Array) -> pa.Array:
    """Of lists of (step, name, args): what selection() says of names, and for each reference the argument fraction of the
    candidate that paired() gives it, as fracs and as their mean. Whole batches at once; items are not taken apart by a shuffle."""
    def parts(lists: pa.Array) -> tuple:
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        return size, np.repeat(np.arange(len(lists)), size), *lists.flatten().flatten()[:3]

    (nr, ir, step_r, name_r, args_r), (nc, ic, step_c, name_c, args_c) = parts(ref), parts(calls)
    sr, sc, many = _codes(step_r, step_c)
    xr, xc, names = _codes(name_r, name_c)
    lost_r, lost_c = (x.is_null().to_numpy(zero_copy_only=False) for x in (step_r, step_c))
    n = len(ref)
    kr, kc = (ir * many + sr) * names + xr, (ic * many + sc) * names + xc
    # no step of one side only, and the names of each alike
    ok = (nr > 0) & (np.bincount(ir[lost_r], minlength=n) == 0) & (np.bincount(ic[lost_c], minlength=n) == 0)
    strict, same = ok & (nr == nc), ok.copy()
    br, bc = (np.argsort(i * many + x, kind="stable") for i, x in ((ir, sr), (ic, sc)))
    br, bc = br[strict[ir[br]]], bc[strict[ic[bc]]]
    strict[ir[br][kr[br] != kc[bc]]] = False
    ur, uc = np.unique(kr), np.unique(kc)
    same[np.setxor1d(ur, uc, assume_unique=True) // (many * names)] = False
    # pairs of the same item, step, name and ordinal
    able_r, able_c = np.flatnonzero(~lost_r & name_r.is_valid().to_numpy(zero_copy_only=False)), np.flatnonzero(~lost_c & name_c.is_valid().to_numpy(zero_copy_only=False))
    key = np.unique(np.r_[kr[able_r], kc[able_c]], return_inverse=True)[1].reshape(-1)
    wide = 1 + max(len(able_r), len(able_c))
    qr, qc = key[: len(able_r)] * wide + _ordinals(kr[able_r]), key[len(able_r):] * wide + _ordinals(kc[able_c])
    _, found, given = np.intersect1d(qr, qc, assume_unique=True, return_indices=True)
    at = np.full(len(kr), -1)
    at[able_r[found]] = able_c[given]
    got = args_c.take(pa.array(at, pa.int64(), mask=at < 0))
    fracs = V.each_distinct(V.argument_fraction, args_r.to_pandas(), got.to_pandas()).astype(np.float64)
    mean = np.bincount(ir, weights=fracs, minlength=n) / np.maximum(nr, 1)
    each = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(nr)], pa.int32()), pa.array(fracs))
    return pa.StructArray.from_arrays([pa.array(strict), pa.array(same), pa.array(mean, mask=nr == 0), each], ["strict", "as_set", "mean", "fracs"])


def _with_judged(both: DataFrame) -> DataFrame:
    """both(ref, calls, ...) with _judged."""
    bare = lambda c: F.transform(c, lambda x: F.struct(x["step"].alias("step"), x["name"].alias("name"), x["args"].alias("args")))
    return both.withColumn("_judged", F.arrow_udf(judged, "struct<strict:boolean,as_set:boolean,mean:double,fracs:array<double>>")(bare("ref"), bare("calls")))


def items(gold: DataFrame, rollouts: DataFrame) -> DataFrame:
    """One row for each gold item with a rollout; gold_id is the key of both.

    gold(gold_id, language, mode, ood, tools array<string>, ref array<struct<step,name,args>>),
    rollouts(gold_id, parse_ok, hops_used, fallback_parse, answers array<string>, calls array<struct<step,name,args,ok,provider>>)."""
    return scored(gold.join(rollouts, "gold_id"))


def scored(both: DataFrame) -> DataFrame:
    """items() of the columns of both in one frame."""
    out = _with_judged(both).withColumns({"tool_selection_strict": F.col("_judged.strict"), "tool_selection_set": F.col("_judged.as_set"), "arg_accuracy": F.col("_judged.mean")})
    n = F.size("calls")
    special = (F.col("mode") == "no_tool") | F.coalesce(F.col("ood"), F.lit(False)) | (F.col("mode") == "ood")
    no_tool, ood = F.col("mode") == "no_tool", special & (F.col("mode") != "no_tool")
    n_bad = F.size(F.filter("calls", lambda c: ~F.array_contains(F.col("tools"), c["name"])))
    n_geo = F.size(F.filter("calls", lambda c: c["provider"].isin("tomtom", "here", "keyless")))
    return out.select(
        "gold_id", "language", "mode", "parse_ok", "hops_used", "fallback_parse", F.size("ref").alias("n_ref_calls"), n.alias("n_calls"),
        F.when(~no_tool, F.coalesce("tool_selection_strict", F.lit(False))).alias("tool_selection_strict"),
        F.when(~no_tool, F.coalesce("tool_selection_set", F.lit(False))).alias("tool_selection_set"),
        F.when(~no_tool, F.col("arg_accuracy")).alias("arg_accuracy"),
        F.when(~special, (n > 0) & F.forall("calls", lambda c: c["ok"])).alias("execution_success"),
        F.when(~ood, F.size(F.filter("calls", lambda c: c["ok"]))).alias("exec_ok_calls"),
        F.when(no_tool, (n == 0) & F.forall("answers", lambda a: F.trim(a) != "")).alias("refusal_ok"),
        F.when(ood & (n > 0), F.round(n_bad / n, 4)).alias("ood_hallucination_rate"),
        F.when(ood & (n > 0), F.round(n_geo / n, 4)).alias("geo_hallucination_rate"),
    )


RATES = ("tool_selection_strict", "tool_selection_set", "arg_accuracy", "execution_success", "refusal_ok", "ood_hallucination_rate", "geo_hallucination_rate")


def rollup(scored: DataFrame, by: str = "language") -> DataFrame:
    """Null-ignoring means of all items and of each language, in one pass."""
    means = [F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in (*RATES, "parse_ok", "hops_used")]
    return scored.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("n"), F.round(F.avg((F.col("fallback_parse") > 0).cast("double")), 4).alias("fallback_parse_rate"), *means)


def providers(gold: DataFrame, rollouts: DataFrame) -> DataFrame:
    """For each provider the mean over items of the item's ratios, not pooled calls."""
    return provider_means(gold.join(rollouts, "gold_id"))


def provider_means(both: DataFrame) -> DataFrame:
    """providers() of the columns of both in one frame. An item's ratios are made within its row."""
    one = lambda name, frac, ok: F.struct(geo.provider(name).alias("provider"), frac.cast("double").alias("frac"), ok.cast("int").alias("ok"))
    none = F.array().cast("array<struct<provider:string,frac:double,ok:int>>")
    refs = F.transform("ref", lambda r, i: one(r["name"], F.get("_judged.fracs", i), F.lit(None)))
    calls = F.transform("calls", lambda c: one(c["name"], F.lit(None), c["ok"]))

    def ratios(x: Column, p: Column) -> Column:
        def of(name: str) -> tuple[Column, Column]:
            has = F.filter(x, lambda y: (y["provider"] == p) & y[name].isNotNull())
            total = F.aggregate(has, F.lit(0.0), lambda acc, y: acc + y[name])
            return F.size(has).cast("long"), F.when(F.size(has) > 0, F.round(total / F.size(has), 4))

        (n, frac), (m, ok) = of("frac"), of("ok")
        return F.struct(p.alias("provider"), n.alias("ref_calls"), frac.alias("arg_accuracy"), m.alias("cand_calls"), ok.alias("exec_ok_rate"))

    own = bound(F.concat(F.coalesce(refs, none), F.coalesce(calls, none)), lambda x: F.transform(F.array_distinct(F.transform(x, lambda y: y["provider"])), lambda p: ratios(x, p)))
    # outer: else Spark filters by the ratios first, and makes them thrice
    per = _with_judged(both).select(F.explode_outer(own).alias("p")).where("p is not null").select("p.*")
    return mean_of_ratios(per, "provider", sums=("ref_calls", "cand_calls"), means=("arg_accuracy", "exec_ok_rate"))


def mean_of_ratios(per_item: DataFrame, by: str, sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    return per_item.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums], *[F.round(F.avg(c), 4).alias(c) for c in means])


def flags_by_mode(mode: Column, **given: Column) -> dict[str, Column]:
    """Metrics set to null where the mode gives them no meaning."""
    return {k: F.when(mode == "no_tool", v if k == "refusal_ok" else None).otherwise(None if k == "refusal_ok" else v) for k, v in given.items()}
