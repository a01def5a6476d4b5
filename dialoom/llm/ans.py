"""Token ids in files: static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by every block. A block holds whole documents in ascending
id order and is coded on its own: its ids go round LANES interleaved coders whose 32-bit words share one stream.
Every STRIDE steps there is a checkpoint (the coders' states and the place in the stream) at which coding starts
anew, so the stretches between checkpoints are coded and decoded side by side; checksums cover the words and the decoded ids.

Texts are tokenised where they are read; only their compressed ids are dealt by range of document id and sorted.

A data set is a folder with three Parquet tables: ``table`` (one row: scale, ids, frequencies, crc32), ``blocks``
(one row a block: part, start in the part, documents, lengths, states, places, words, two crc32) and ``parts`` (each
part's start). The writers are Spark's, so the folder may lie in any store that Spark reaches, and a lost task is
simply run again.

Defined results: a null or empty text is its end id alone; null ids come first; rows with equal ids follow each
other, ordered by the text's hash; an empty table gives empty tables. A document is never split, so a block is as
large as its longest document at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_values, new_path, scratch, ship, slices, stored, text_of
from .tokens import GROUP, encoder, forget

LANES, STRIDE, SCALE, LOW = 256, 256, 20, 1 << 31
BLOCK_IDS = 1 << 20
_WORD, _MASK = np.uint64(32), np.uint64((1 << 32) - 1)


class Table:
    """Frequencies that sum to 2**SCALE, 1 at least for each id that occurs."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols, freqs
        ends = np.cumsum(freqs)
        size = int(symbols.max()) + 1 if len(symbols) else 0
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[symbols], self.c[symbols] = freqs, ends - freqs
        self.of_slot = np.repeat(symbols, freqs).astype(np.uint16)

    @classmethod
    def counted(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order]
        if not len(symbols):
            return cls(symbols.astype(np.int64), counts.astype(np.int64))
        f = np.maximum(1, np.floor(counts * ((1 << SCALE) / counts.sum())).astype(np.int64))
        over = int(f.sum()) - (1 << SCALE)
        for k in np.argsort(-f, kind="stable"):  # the most frequent ids give or take what rounding left
            step = min(over, int(f[k]) - 1) if over > 0 else over
            f[k] -= step
            over -= step
            if not over:
                break
        return cls(symbols, f)


def encode(ids: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stream's words, and of each checkpoint the coders' states and the place in the stream. The stretches between checkpoints are coded side by side."""
    n, s = len(ids), np.uint64(SCALE)
    rows = -(-n // (STRIDE * LANES))
    grid = np.full(rows * STRIDE * LANES, ids[0] if n else 0, ids.dtype)
    grid[:n] = ids
    grid = grid.reshape(rows, STRIDE, LANES)
    live_end = n - (rows - 1) * STRIDE * LANES  # ids in the last stretch
    x = np.full((rows, LANES), LOW, np.uint64)
    most = np.uint64(63 - SCALE)
    out, of = [], []
    for k in range(min(STRIDE, -(-n // LANES)) - 1, -1, -1):
        sym = grid[:, k]
        f = t.f[sym]
        full = x >= f << most
        last = max(0, min(LANES, live_end - k * LANES))
        full[-1, last:] = False
        out.append((x[full] & _MASK).astype("<u4"))
        of.append(full.sum(axis=1))
        y = np.where(full, x >> _WORD, x)
        q = y // f
        y = (q << s) + (y - q * f) + t.c[sym]
        if last < LANES:
            y[-1, last:] = x[-1, last:]
        x = y
    # each stretch's words in the order in which they are read
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    row = np.concatenate([np.repeat(np.arange(rows), c) for c in of[::-1]]) if out else np.zeros(0, int)
    places = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])[:rows]
    return words[np.argsort(row, kind="stable")], x.astype("<u8"), places.astype("<i8")


def decode(n: int, words: np.ndarray, states: np.ndarray, places: np.ndarray, t: Table) -> np.ndarray:
    """All stretches of a block at once: one row of coders for each checkpoint."""
    rows, s = len(places), np.uint64(SCALE)
    out = np.zeros((rows, STRIDE, LANES), np.uint32)
    x, at = states.astype(np.uint64), places.astype(np.int64).copy()
    words = np.concatenate([words, np.zeros(1, words.dtype)]).astype(np.uint64)
    slots, low = np.uint64((1 << SCALE) - 1), np.uint64(LOW)
    live_end = n - (rows - 1) * STRIDE * LANES  # ids in the last stretch
    for k in range(min(STRIDE, -(-n // LANES)) if rows else 0):
        # only the last stretch may be short
        last = max(0, min(LANES, live_end - k * LANES))
        slot = x & slots
        sym = t.of_slot[slot.astype(np.int64)]
        out[:, k] = sym
        y = t.f[sym] * (x >> s) + slot - t.c[sym]
        need = y < low
        if last < LANES:
            y[-1, last:] = x[-1, last:]
            need[-1, last:] = False
        before = np.cumsum(need, axis=1)
        pick = np.where(need, at[:, None] + before - 1, len(words) - 1)
        x = np.where(need, (y << _WORD) | words[pick], y)
        at += before[:, -1]
    return out.reshape(-1)[:n]


def _tokenised(df: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie (a hash of the text) and ids (16-bit, compressed) of each row, and one row more for each partition: how often it has each id (seen: 64-bit, compressed)."""
    src = text_of(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, small = encoder(tokenizer, kind), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype="<u2").tobytes()
        names, seen = ["doc_id", "tie", "ids", "seen"], np.zeros(1 << 16, "<i8")
        for whole in slices(batches, 10_000):
            id_kind = whole.column(0).type
            some = max(64, whole.num_rows * GROUP // max(1, whole.nbytes))
            for k in range(0, whole.num_rows, some):
                b = whole.slice(k, some)
                ids = enc.ids(byte_values(b.column(1)))
                seen += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16)
                seen[end_id] += len(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([small.compress(x + end) for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([small.compress(seen.tobytes())], pa.binary())], names)

    return src.mapInArrow(rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tie long, ids binary, seen binary")


def _ids(column: pa.Array) -> list[np.ndarray]:
    big = zstandard.ZstdDecompressor()
    return [np.frombuffer(big.decompress(x), dtype="<u2") for x in column.to_pylist()]


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the data set."""
    spark = df.sparkSession
    ship(spark)
    done = stored(_tokenised(df, tokenizer, kind, end_id, id_col, text_col), "ids-tokens", packed=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        big = zstandard.ZstdDecompressor()
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = np.frombuffer(big.decompress(raw), "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["symbol", "n"])

    # at most one row for each id of the vocabulary
    counts = done.where("seen is not null").select("seen").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    t = Table.counted(np.array([r[0] for r in counts], dtype=np.int64), np.array([r[1] for r in counts], dtype=np.int64))
    raw = [t.symbols.astype("<u4").tobytes(), t.freqs.astype("<u4").tobytes()]
    spark.createDataFrame([(1, SCALE, LANES, STRIDE, *map(bytearray, raw), zlib.crc32(b"".join(raw)))], "version int, scale int, lanes int, stride int, symbols binary, freqs binary, crc32 long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((t.symbols, t.freqs))
    id_type = done.schema["doc_id"].dataType.simpleString()
    names = ["part", "start", "n_ids", "doc_ids", "doc_lens", "states", "places", "words", "words_crc32", "ids_crc32"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        t, part = Table(*shared.value), TaskContext.get().partitionId()
        docs, held, size, at = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal docs, held, size, at
            ids = np.concatenate(held)
            words, states, places = encode(ids, t)
            raw = words.tobytes()
            row = [part, at, len(ids), docs, [len(x) for x in held], states.tobytes(), places.tobytes(), raw, zlib.crc32(raw), zlib.crc32(ids.astype("<u4").tobytes())]
            at, docs, held, size = at + len(ids), [], [], 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            id_kind = b.column(0).type
            for k in range(0, b.num_rows, 512):
                for doc, ids in zip(b.column(0).slice(k, 512).to_pylist(), _ids(b.column(1).slice(k, 512))):
                    docs.append(doc)
                    held.append(ids)
                    size += len(ids)
                    if size >= block_ids:
                        yield block()
        if held:
            yield block()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), done.rdd.getNumPartitions())
    along = done.where("seen is null").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    along.mapInArrow(blocks, f"part int, start long, n_ids long, doc_ids array<{id_type}>, doc_lens array<long>, states binary, places binary, words binary, words_crc32 long, ids_crc32 long").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    # one row for each part
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", before.alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded; with_ids adds its ids. A wrong checksum is an error."""
    ship(spark)
    one = spark.read.parquet(f"{path}/table").first()
    if zlib.crc32(bytes(one["symbols"]) + bytes(one["freqs"])) != one["crc32"] or (one["scale"], one["lanes"], one["stride"]) != (SCALE, LANES, STRIDE):
        raise ValueError(f"{path}: the frequency table is damaged or of another version")
    # as long as the vocabulary, and a number for each part
    shared = spark.sparkContext.broadcast((bytes(one["symbols"]), bytes(one["freqs"]), {r[0]: r[1] for r in spark.read.parquet(f"{path}/parts").collect()}))
    src = spark.read.parquet(f"{path}/blocks")
    id_type = src.schema["doc_ids"].dataType.elementType.simpleString()

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, freqs, first = shared.value
        t = Table(np.frombuffer(symbols, "<u4").astype(np.int64), np.frombuffer(freqs, "<u4").astype(np.int64))
        for b in batches:
            for k in range(b.num_rows):
                r = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}
                if zlib.crc32(r["words"]) != r["words_crc32"]:
                    raise ValueError(f"block at {r['start']}: its words are damaged")
                ids = decode(r["n_ids"], np.frombuffer(r["words"], "<u4"), np.frombuffer(r["states"], "<u8").reshape(-1, LANES), np.frombuffer(r["places"], "<i8"), t).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"block at {r['start']}: its ids are damaged")
                ends = np.cumsum(r["doc_lens"])
                each = np.split(ids, ends[:-1])
                cols = [pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(first[r["part"]] + r["start"] + ends - r["doc_lens"]), pa.array(r["doc_lens"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return src.mapInArrow(docs, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(df: DataFrame, tokenizer: str, end_id: int, **how: object) -> DataFrame:
    """Write a new data set to the shared folder and read it back."""
    write(df, path := new_path(df.sparkSession, "ids"), tokenizer, end_id, **how)
    scratch(df.sparkSession, path)
    return read(df.sparkSession, path)
