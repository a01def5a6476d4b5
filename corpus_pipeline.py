"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one reads
it. All but the last return the columns of documents; the last returns the pieces of the packed sequences.

Defined results, for every stage: a null text counts as empty; nulls in other columns are passed on; extra columns of
any name stay as they are; an empty table gives an empty table; texts are read whole, of any length. What a stage does
with ties and repeated rows is said with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import curve, lines, mixing, overlap, quality, simhash
from dialoom.llm.common import MADE, discard, release, stored, table

#: A line goes from its second document on when it has so many characters and stands in so many documents.
LINE_CHARS, LINE_DOCS = 16, 10


#: Rows of an Arrow batch at most: they hold whole documents, of which an executor's and a worker's memory hold several batches.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Scratch folders of the stage before, whose result is written when the next one starts.
_LEFT: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage that first deletes what the stage before has left, if docs is read from files, but for what it reads."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {x.rsplit("/", 1)[0].split(":")[-1].lstrip("/") for x in docs.inputFiles()}
        if read:
            discard(spark, [x for x in _LEFT if x in MADE and x.split(":")[-1].lstrip("/") not in read])
            release(spark)
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        before = set(MADE)
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [x for x in MADE if x not in before]
        return out

    return wraps(f)(run)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go, by a stored ledger; null and empty texts are among them. Repeated rows are judged alike."""
    return quality.keep(docs, policy="production-1")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay where they occur first (smallest id, then position); a document that loses every visible line goes. Repeated rows of equal id and text are one document to the count and lose the same lines."""
    marks = lines.bitmaps(lines.dropped(docs, min_docs=LINE_DOCS, min_chars=LINE_CHARS, mode="first"))
    left = lines.apply(docs, marks)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return left.withColumn("n_chars", F.length("text").cast(kind)) if kind else left


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, null last, then the smallest hash of the text; repeated rows are one.

    SimHash of five-word shingles links what differs in four bits or less. Near copies are often further apart, so among the
    documents left the five-word shingle sets themselves are compared: whatever has a Jaccard similarity of 0.8 or more is linked."""
    left = stored(simhash.representatives(docs, radius=4, k=5), "near-simhash")
    release(spark)  # the shuffled texts
    return overlap.representatives(left, num=4, den=5, k=5)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights take them, up to twice; ties in the hash order are taken together, and so are rows equal in id and text. A null source is a source."""
    return mixing.apply(docs, weights=(5, 2, 1), budget=1.5, max_repeats=2)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the space-filling curve; ties by id, and every repeated row is packed."""
    return curve.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("packing", packing),
]

#: The last stage's ids come from a tokenizer, which SQL cannot express; tests/llm compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
