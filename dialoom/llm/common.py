"""What the corpus operators share: shared storage, code shipping, bytes of Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401  for the operators
from ..storage import MADE, cut, discard, new_path, release, scratch, shared_dir, stored  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters. bytes.split() and bytes.strip()
#: cut at exactly these, and bytes.lower() changes exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most; the memory of those before goes back to the system, which bounds what a worker keeps."""
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            yield whole.slice(k, rows)
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """Of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def id_key(doc: Column) -> Column:
    """An id of any type as text that is never null, by which ids can be joined; null is an id of its own."""
    return F.coalesce(F.concat(F.lit("i"), doc.cast("string")), F.lit("n"))


#: Rows of two or three short columns that are broadcast at most; more are joined by a shuffle.
FEW = 1 << 18


def among(df: DataFrame, keys: DataFrame, on: Column, how: str) -> DataFrame:
    """df semi- or anti-joined with stored keys, which are broadcast if they are FEW, so that df's texts stay where they are."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)


def one_row_each(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of df, all columns, one row for each (id, hash: a text's hash) of kept.

    If there are no repeated rows and few others to leave out, those are broadcast and texts stay where they are; else texts
    are shuffled once, since both steps deal by the same keys."""
    h, i = unused(df, "text_hash"), unused(df, "id_key")
    src = df.withColumns({h: text_hash(df[text_col]), i: id_key(df[id_col])})
    keys = kept.select(F.col("hash").alias("k_hash"), id_key(F.col("id")).alias("k_id"))
    same = (F.col("hash") == F.col("k_hash")) & (F.col("id") == F.col("k_id"))
    every = src.select(F.col(h).alias("hash"), F.col(i).alias("id")).groupBy("hash", "id").agg((F.count("*") > 1).alias("repeated"))
    gone = stored(every.join(keys, same, "left").where("repeated or k_id is null").select("hash", "id", "repeated"), "rows-gone")
    if gone.where("repeated").isEmpty() and gone.count() <= FEW:
        out = src.join(F.broadcast(gone), (src[h] == gone["hash"]) & (src[i] == gone["id"]), "left_anti")
    else:
        out = src.join(keys, (src[h] == keys["k_hash"]) & (src[i] == keys["k_id"]), "left_semi").dropDuplicates([h, i])
    return out.drop(h, i)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under names that no extra column can clash with."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
