"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document: the ledger row holds the measurements and one bit for each rule
that the document fails. The ledger is stored once, and read by whatever comes after: a policy is a named, versioned
mask of the bits that reject; applying another policy, or asking what a policy would lose without one of its rules,
needs only bit operations on the ledger.

Defined results: a null text has no words; an empty table gives an empty ledger; repeated rows are judged each
on its own; a null id is passed through; extra columns of any name stay as they are, since the ledger's own columns
take a name that is free. Long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, ship, slices, stored, text_of, unused

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measures, integer arithmetic only, so that every engine gives the same bit."""

    bit: int
    name: str
    fails: str

    def test(self, m: dict[str, np.ndarray]) -> np.ndarray:
        return eval(compile(self.fails.replace(" OR ", " | "), self.name, "eval"), {}, m)  # noqa: S307  our own text


RULES = (
    Rule(0, "few_words", "(n_words < 10)"),
    Rule(1, "repeated_windows", "(100 * n_repeat_words > 20 * n_words)"),
    Rule(2, "word_length", "(word_chars < 2 * n_words) OR (word_chars > 20 * n_words)"),
    Rule(3, "symbols", "(100 * n_symbols > 25 * n_words)"),
    Rule(4, "repeated_lines", "(100 * n_dup_lines > 30 * n_lines)"),
    Rule(5, "same_words", "(100 * n_same_words > 30 * n_words)"),
    Rule(6, "many_words", "(n_words > 1000000)"),
)
#: The bits that reject, by policy version. The base policy is the first two rules.
POLICIES = {"base-1": 0b0000011, "production-1": 0b0101111, "strict-1": 0b1111111}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)  # the first byte of each code point in a word
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_DOC = np.uint64(0xA0761D6478BD642F)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n_lines = np.zeros(len(texts), np.int64)
    dup = np.zeros(len(texts), np.int64)
    n_words = np.zeros(len(texts), np.int64)
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for i, t in enumerate(texts):
        words = t.split()
        n_words[i] = len(words)
        ids += [number.setdefault(w, len(number)) for w in words]
        lines = [x for x in t.split(b"\n") if x.strip()]
        n_lines[i], dup[i] = len(lines), len(lines) - len(set(lines))
    every = np.array(ids, dtype=np.uint64)
    same = np.concatenate([[False], every[1:] == every[:-1]])[: len(every)]
    words_at = np.concatenate([[0], np.cumsum(n_words)])
    same[words_at[:-1][n_words > 0]] = False  # the first word of a text follows none
    return {
        "n_words": n_words,
        "word_chars": _sums(_LETTER[raw], at),
        "n_symbols": _sums(_SYMBOL[raw], at),
        "n_dup_lines": dup,
        "n_repeat_words": _repeats(every, n_words),
        "n_lines": n_lines,
        "n_same_words": _sums(same, words_at),
    }


def _repeats(ids: np.ndarray, n_words: np.ndarray, k: int = 5) -> np.ndarray:
    """Words that lie in a window of k words found twice or more in the same text. A window is a 64-bit hash of its words and its text."""
    at = np.concatenate([[0], np.cumsum(n_words)])
    full = np.maximum(n_words - k + 1, 0)  # windows of each text
    total = int(full.sum())
    if not total:
        return np.zeros(len(n_words), np.int64)
    text = np.repeat(np.arange(len(n_words)), full)
    start = np.arange(total) - np.repeat(np.cumsum(full) - full, full) + at[text]
    h = text.astype(np.uint64) * _DOC
    for j in range(k):
        h += (ids[start + j] + np.uint64(1)) * _MIX[j]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(total, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = start[twice]  # each window starts at another word
    edge[hit] += 1
    np.add.at(edge, hit + k, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, at)


def failure_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    bits = np.zeros(len(m["n_words"]), np.int64)
    for r in RULES:
        bits |= r.test(m).astype(np.int64) << r.bit
    return bits


def _small(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    size = np.array([len(x) if x else 0 for x in byte_values(batch.column(text))], dtype=np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures and fail_bits of each row: a stored table, texts are read once."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, 2048):
            for b in _small(whole, 1):
                m = measure(byte_values(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(failure_bits(m))], ["doc_id", *MEASURES, "fail_bits"])

    src = text_of(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    made = src.mapInArrow(rows, f"doc_id {kind}, {', '.join(f'{k} long' for k in MEASURES)}, fail_bits long")
    return stored(made, "quality-ledger")


def with_policy(entries: DataFrame, policy: str = "production-1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    bits = F.col("fail_bits")
    return entries.withColumns({"base_failed": bits.bitwiseAND(POLICIES["base-1"]) != 0, "kept": bits.bitwiseAND(POLICIES[policy] | POLICIES["base-1"]) == 0})


def ablations(entries: DataFrame, policy: str = "production-1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it. One aggregate, no second look at the texts."""
    mask = POLICIES[policy]
    held = F.col("fail_bits").bitwiseAND(mask)
    used = [r for r in RULES if mask >> r.bit & 1]
    sums = [x for r in used for x in (F.count_if(held.bitwiseAND(1 << r.bit) != 0).alias(f"f{r.bit}"), F.count_if(held == 1 << r.bit).alias(f"o{r.bit}"))]
    one = entries.agg(F.count("*").alias("n"), F.count_if(held == 0).alias("k"), *sums)
    rows = F.array(*(F.struct(F.lit(policy).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_failed_alone"), (F.col("k") + F.col(f"o{r.bit}")).alias("n_kept_without"), F.col("n").alias("n_docs")) for r in used))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def with_ledger(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """df, all columns, stored with its ledger beside it: one more column, a struct of the measures and fail_bits. And that column's name."""
    ship(df.sparkSession)
    at, name = df.columns.index(text_col), unused(df, "ledger")
    fields = [*MEASURES, "fail_bits"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, 2048):
            for b in _small(whole, at):
                m = measure(byte_values(b.column(at)))
                entry = pa.StructArray.from_arrays([*(pa.array(m[k]) for k in MEASURES), pa.array(failure_bits(m))], fields)
                yield pa.RecordBatch.from_arrays([*b.columns, entry], [*b.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([T.StructField(k, T.LongType()) for k in fields]))])
    return stored(df.mapInArrow(rows, schema), "quality-ledger"), name


def keep(df: DataFrame, policy: str = "production-1", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, that a policy keeps by the stored ledger."""
    entries, name = with_ledger(df, text_col)
    bits = F.col(f"`{name}`.fail_bits")
    return entries.where(bits.bitwiseAND(POLICIES[policy] | POLICIES["base-1"]) == 0).drop(name)
