"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token ids, projected to a few dimensions; the cell that it falls in
has a place on a Hilbert curve. Documents are sorted by that place over range partitions (ties by id, so a large
group of copies is spread), and each partition's tokens, end to end, are cut into sequences: neighbours on the
curve share sequences. What is left at a partition's end goes into sequences whose lengths are powers of two, so
nothing is padded at all.

Defined results: a null or empty text is its end id alone; repeated rows are packed once each; an empty table
gives no pieces; a null id is passed through; a document longer than a sequence lies in several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, ship, slices, text_of
from .tokens import encoder

DIMS, BITS, BUCKETS = 4, 8, 256
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (n, dims) with coordinates below 2**bits; after Skilling's transform of axes."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def projection(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket and sign of each 16-bit id, and the directions of the projection."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, BUCKETS, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16), rng.standard_normal((BUCKETS, DIMS))


def place(ids: list[np.ndarray], with_: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    bucket, sign, to = with_
    v = np.stack([np.bincount(bucket[x], weights=sign[x], minlength=BUCKETS) for x in ids]) if ids else np.zeros((0, BUCKETS))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    p = v @ to  # about standard normal in each dimension
    cell = np.floor((1 << BITS) / (1 + np.exp(-1.702 * p))).astype(np.int64)
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS)


def tokenised(df: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str, memo: int | None = None) -> DataFrame:
    """doc_id, key (the place on the curve), n_tokens and ids (16-bit, compressed)."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, with_, small = encoder(tokenizer, kind, memo), projection(), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype="<u2").tobytes()
        for b in slices(batches, 512):
            ids = enc.ids(byte_values(b.column(1)))
            key = place([np.frombuffer(x, dtype="<u2") for x in ids], with_)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([len(x) // 2 + 1 for x in ids], pa.int64()), pa.array([small.compress(x + end) for x in ids], pa.binary())], ["doc_id", "key", "n_tokens", "ids"])

    src = text_of(df, id_col, text_col)
    return src.mapInArrow(rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, n_tokens long, ids binary")


def lengths(total: int, most: int) -> list[int]:
    """Full sequences, then the rest as powers of two, largest first."""
    return [most] * (total // most) + [1 << b for b in range(most.bit_length(), -1, -1) if total % most >> b & 1]


class _Packer:
    """Cuts one partition's tokens. Only the ids of sequences that are not yet full are held."""

    def __init__(self, first: int, most: int):
        self.next, self.most = first, most
        self.open: list[tuple] = []  # (doc, start, ids, doc_tokens) not yet in a sequence
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.most - self.held)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.held += take
            at += take
            if self.held == self.most:
                self._emit([self.most])

    def _emit(self, sizes: list[int]) -> None:
        room, offset = iter(sizes), 0
        left = next(room, 0)
        for doc, start, ids, n in self.open:
            while len(ids):
                if not left:
                    self.next, offset, left = self.next + 1, 0, next(room)
                part, ids = ids[:left], ids[left:]
                self.rows.append((doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), n, self.next, offset))
                start, offset, left = start + len(part), offset + len(part), left - len(part)
        if self.open:
            self.next += 1
        self.open, self.held = [], 0

    def close(self) -> None:
        self._emit(lengths(self.held, self.most))


def pack(df: DataFrame, tokenizer: str, end_id: int, kind: str = "word", most: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence. memo: words that a worker remembers, if not the tokenizer's default."""
    spark = df.sparkSession
    done = cut(tokenised(df, tokenizer, kind, end_id, id_col, text_col, memo))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), done.rdd.getNumPartitions())
    # the cell decides; copies and cell mates are told apart by id
    along = done.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "n_tokens", "ids")
    id_type = done.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        p = _Packer(TaskContext.get().partitionId() << 40, most)

        def out(id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            got, p.rows = p.rows, []
            cols = list(zip(*got)) if got else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_kind), *(pa.array(c, pa.int64()) for c in cols[1:7])], names)

        id_kind = None
        for b in slices(batches, 2048):
            id_kind = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p.add(doc, np.frombuffer(big.decompress(ids), dtype="<u2"))
                if len(p.rows) > 20_000:
                    yield from out(id_kind)
        p.close()
        if p.rows:
            yield from out(id_kind)

    return along.select("doc_id", "ids").mapInArrow(rows, f"doc_id {id_type}, {PIECES}")
