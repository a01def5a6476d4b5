"""Line dedup: which lines of each document stay, as compressed bitmaps.

Every line becomes a 128-bit hash of its key (white space stripped, A-Z lower-cased). The hashes are dealt by
range and sorted by document and position behind them, so each partition streams through whole runs of equal
lines; a run that a range boundary cuts is settled from one summary of each partition's two outer runs, which are put
together on the cluster: a line has one summary for each partition at most. Since document and position are part of the
range, a line found in every document is spread over many partitions.

Modes: ``first`` keeps a line's first occurrence (smallest document, then position), ``all`` keeps none; either
applies to lines found in at least min_docs documents whose keys have at least min_chars code points.

A document is known by its id and a hash of its text: repeated rows with equal id and text count as one document
and get the same bitmap; ids may be of any type (other than whole numbers, they are ordered as text); a null id is an id
of its own, smaller than any other. A null or empty text is one empty
line. Documents that lose nothing have no bitmap. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import FEW, byte_values, cut, ship, slices, stored, text_hash


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def _doc(df: DataFrame, id_col: str) -> Column:
    """An id as it is carried, never null: whole numbers as long, all else as text."""
    return F.coalesce(df[id_col].cast("long"), F.lit(0)) if isinstance(df.schema[id_col].dataType, IntegralType) else F.coalesce(df[id_col].cast("string"), F.lit(""))


def _kind(df: DataFrame, doc: str = "doc") -> str:
    return df.schema[doc].dataType.simpleString()


def _known(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """has_id and doc (never null), a hash of the text, and the text: what a document is known by."""
    return df.select(df[id_col].isNotNull().alias("has_id"), _doc(df, id_col).alias("doc"), text_hash(df[text_col]).alias("text_hash"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def _lines(known: DataFrame, min_chars: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches, 256):
            raw, of, pos, total = [], [], [], []
            for k, text in enumerate(byte_values(b.column(3))):
                keys = [x.strip().lower() for x in text.split(b"\n")]
                if min_chars == 1:
                    at = [p for p, x in enumerate(keys) if x]
                else:
                    at = [p for p, x in enumerate(keys) if len(x) >= min_chars and len(x.decode("utf-8", "replace")) >= min_chars]
                raw += [digest(keys[p]) for p in at]
                pos += at
                of += [k] * len(at)
                total += [len(keys)] * len(at)
            h = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(pos, pa.int32()), pa.array(total, pa.int32())], ["h1", "h2", "has_id", "doc", "text_hash", "pos", "n_lines"])

    return known.mapInArrow(rows, f"h1 long, h2 long, has_id boolean, doc {_kind(known)}, text_hash long, pos int, n_lines int")


def _runs(batches: Iterator[pa.RecordBatch], min_docs: int, first_stays: bool, whole_ids: bool) -> Iterator[pa.RecordBatch]:
    """Streams one partition. Inner runs are settled here; the first and the last run's rows go on undecided, with a summary each.

    Out: edge 0 (dropped), 1 or 2 (row of the first or last run), -1 or -2 (its summary: n_docs, and the documents at its ends).
    """
    names = ["edge", "part", "h1", "h2", "has_id", "doc", "text_hash", "pos", "n_lines", "n_docs", "rank"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64() if whole_ids else pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    part = TaskContext.get().partitionId()
    tail: list[np.ndarray] | None = None  # rows of the run that is open
    inner = False  # whether a run has ended before
    streamed = 0  # rows of the open run that have gone on already
    docs = 0
    first_row: tuple | None = None
    last_doc: tuple | None = None

    def table(cols: list[np.ndarray], edge: int, n_docs: int = 0, rank: int = 0) -> pa.RecordBatch:
        n = len(cols[0])
        full = [np.full(n, edge, np.int32), np.full(n, part, np.int32), *cols, np.full(n, n_docs, np.int64), np.full(n, rank, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(full, kinds)], names)

    def new_docs(cols: list[np.ndarray], before: tuple | None) -> np.ndarray:
        d = np.ones(len(cols[0]), bool)
        d[1:] = (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1]) | (cols[4][1:] != cols[4][:-1])
        if before is not None and len(d):
            d[0] = (cols[2][0], cols[3][0], cols[4][0]) != before
        return d

    def is_first(cols: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Rows that are their run's first occurrence; a repeated row has the same document and position."""
        return np.all([c == c[first] for c in cols[2:6]], axis=0)

    def summary(edge: int) -> Iterator[pa.RecordBatch]:
        # the run's first row and the document of its last one
        one = lambda row: [np.array([v], object if isinstance(v, str) else None) for v in row]
        yield table(one(first_row), edge, docs, 0)
        yield table(one((*first_row[:2], *last_doc, *first_row[5:])), edge, docs, 1)

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        n = len(cols[0])
        if not n:
            continue
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if first_row is not None and (cols[0][0], cols[1][0]) != first_row[:2]:
            change = np.concatenate([[0], change])
        cuts = np.unique(np.concatenate([[0], change, [n]]))
        starts_new = first_row is None or (len(change) > 0 and change[0] == 0)
        if not starts_new:  # the open run goes on
            run = [c[: cuts[1]] for c in cols]
            docs += int(new_docs(run, last_doc).sum())
            last_doc = tuple(c[-1] for c in run[2:5])
            tail = run if tail is None else [np.concatenate(x) for x in zip(tail, run)]
            if len(tail[0]) > 50_000:  # a run may be far longer than memory: once it is known to be frequent, it goes on as it comes
                yield table(tail, 2 if inner else 1)
                streamed, tail = streamed + len(tail[0]), None
            cuts = cuts[1:]
            if len(cuts) == 1:
                continue
        # the open run, if any, ends here
        if first_row is not None:
            if not inner:
                if tail is not None:
                    yield table(tail, 1)
                yield from summary(-1)
            elif streamed:
                # an inner run of which rows went on undecided: it is settled by its summary as well
                if tail is not None:
                    yield table(tail, 2)
                yield from summary(-2)
            elif docs >= min_docs:
                gone = [c[~is_first(tail, np.zeros(len(tail[0]), int))] for c in tail] if first_stays else tail
                if len(gone[0]):
                    yield table(gone, 0)
            inner = True
        # whole runs of this batch, but for the last, at once
        a, z = cuts[:-1], cuts[1:]
        if len(a) > 1:
            body = [c[a[0] : z[-2]] for c in cols]
            run_of = np.repeat(np.arange(len(a) - 1), z[:-1] - a[:-1])
            d = new_docs(body, None)
            d[a[:-1] - a[0]] = True
            count = np.bincount(run_of, weights=d, minlength=len(a) - 1)
            drop = count[run_of] >= min_docs
            if first_stays:
                drop[is_first(body, (a[:-1] - a[0])[run_of])] = False
            if not inner:  # the partition's first run
                own = run_of == 0
                first_row, docs = tuple(c[0] for c in body), int(count[0])
                last_doc = tuple(c[own][-1] for c in body[2:5])
                yield table([c[own] for c in body], 1)
                yield from summary(-1)
                drop[own] = False
                inner = True
            if drop.any():
                yield table([c[drop] for c in body], 0)
        tail, streamed = [c[a[-1] : z[-1]] for c in cols], 0
        first_row = tuple(c[0] for c in tail)
        docs = int(new_docs(tail, None).sum())
        last_doc = tuple(c[-1] for c in tail[2:5])
    if first_row is not None:
        if tail is not None:
            yield table(tail, 2 if inner else 1)
        yield from summary(-2 if inner else -1)


def dropped(df: DataFrame, min_docs: int = 10, min_chars: int = 1, mode: str = "all", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """has_id, doc, text_hash, pos, n_lines of every line that goes."""
    if mode not in ("all", "first"):
        raise ValueError(mode)
    spark = df.sparkSession
    ship(spark)
    src = _lines(_known(df, id_col, text_col), min_chars)
    kind, first_stays = _kind(src), mode == "first"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    order = ["h1", "h2", "has_id", "doc", "text_hash", "pos"]
    out = f"edge int, part int, h1 long, h2 long, has_id boolean, doc {kind}, text_hash long, pos int, n_lines int, n_docs long, rank int"
    done = cut(src.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _runs(b, min_docs, first_stays, kind == "bigint"), out))
    # rows of undecided runs that go, by the verdict on their run: which goes, and the row of it that stays
    gone = stored(_verdicts(done, min_docs, first_stays), "line-verdicts")
    cols = ["has_id", "doc", "text_hash", "pos", "n_lines"]
    run = (F.col("part") == F.col("v_part")) & (F.col("edge") == F.col("v_edge")) & (F.col("h1") == F.col("v_h1")) & (F.col("h2") == F.col("v_h2"))
    open_rows = done.where("edge > 0").join(F.broadcast(gone) if gone.count() <= FEW else gone, run)
    stays = F.expr("stay is not null and has_id = stay.has_id and doc = stay.doc and text_hash = stay.text_hash and pos = stay.pos")
    return done.where("edge = 0").select(*cols).unionByName(open_rows.where(~stays).select(*cols))


def _verdicts(done: DataFrame, min_docs: int, first_stays: bool) -> DataFrame:
    """v_part, v_edge, v_h1, v_h2 of each undecided run of a line that goes, and stay: the line's first row, if it stays and is in this run.

    Of a line there is one run a partition at most, so the windows are bounded by the number of partitions."""
    known = ["has_id", "doc", "text_hash"]
    of_rank = lambda rank, cols: F.max(F.when(F.col("rank") == rank, F.struct(*cols)))
    runs = done.where("edge < 0").groupBy("part", "edge", "h1", "h2").agg(F.max("n_docs").alias("n"), of_rank(0, known).alias("head"), of_rank(1, known).alias("tail"), of_rank(0, [*known, "pos"]).alias("row"))
    line = Window.partitionBy("h1", "h2")
    inside = line.orderBy("part", F.desc("edge"))
    # a document that a boundary cuts is in the count of both runs
    runs = runs.withColumns({"n": F.col("n") - F.coalesce((F.lag("tail").over(inside) == F.col("head")).cast("int"), F.lit(0)), "at": F.row_number().over(inside)})
    total = runs.withColumn("total", F.sum("n").over(line)).where(F.col("total") >= min_docs)
    stay = F.when((F.col("at") == 1) & F.lit(first_stays), F.col("row"))
    return total.select(F.col("part").alias("v_part"), (-F.col("edge")).alias("v_edge"), F.col("h1").alias("v_h1"), F.col("h2").alias("v_h2"), stay.alias("stay"))


def bitmaps(gone: DataFrame) -> DataFrame:
    """has_id, doc, text_hash, keep (a zlib-compressed bitmap, first line first) of each document that loses lines."""
    one = gone.groupBy("has_id", "doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, pos in zip(b.column(3).to_pylist(), b.column(4)):
                keep = np.ones(n, bool)
                keep[pos.values.to_numpy()] = False
                out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["m_id", "m_doc", "m_text", "keep"])

    return one.mapInArrow(rows, f"m_id boolean, m_doc {_kind(gone)}, m_text long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text left, its lines before, and the lines that went."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    left = [x for x, k in zip(lines, flags) if k]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def digests(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row under its bitmap."""
    id_type = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            got = [kept_lines(t, k) for t, k in zip(byte_values(b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    known = _known(df, id_col, text_col).withColumn("id", F.expr("if(has_id, doc, null)").cast(id_type))
    both = known.join(marks, (F.col("has_id") == F.col("m_id")) & (F.col("doc") == F.col("m_doc")) & (F.col("text_hash") == F.col("m_text")), "left")
    return both.select("id", "text", "keep").mapInArrow(rows, f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string")


def apply(df: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """df, all columns, with the lines that go taken out of the text; documents that lose every visible line go, if asked."""
    names = df.columns
    at, n = names.index(text_col), len(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            texts, keeps = byte_values(b.column(at)), b.column(n).to_pylist()
            new = [kept_lines(t, k)[0] if k is not None else t for t, k in zip(texts, keeps)]
            whole = pa.array([v is None for v in b.column(at).to_pylist()])
            text = pa.array(new, pa.binary()).cast(pa.string())
            text = pa.compute.if_else(whole, pa.scalar(None, pa.string()), text)
            stay = pa.array([not drop_emptied or k is None or bool(t.strip()) for t, k in zip(new, keeps)])
            cols = [text.cast(b.schema.field(at).type) if i == at else b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(cols, names).filter(stay)

    cond = (df[id_col].isNotNull() == marks["m_id"]) & (_doc(df, id_col) == marks["m_doc"]) & (text_hash(df[text_col]) == marks["m_text"])
    both = df.join(marks, cond, "left").select(*[df[c] for c in names], marks["keep"].alias("__keep"))
    return both.mapInArrow(rows, df.schema)
