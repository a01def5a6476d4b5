"""Subword lattice likelihood of documents.

A word's probability is the sum over all ways to cut it into pieces of an existing vocabulary, by a forward
recursion in log space; pieces are byte strings, every single byte among them, so any text has a path. Starting from
the vocabulary's own scores (or ranks), the pieces' weights are fitted to the distinct training words by expectation
maximisation. In the model each training word is also a path of its own, with absolute discounting:

    p(w) = (max(c - d, 0) + d * V * lattice(w)) / N,    p(end) = documents / N,    d = n1 / (n1 + 2 * n2)

over all tokens, N of them; c is the word's count, V the number of distinct training words, n1 and n2 those found
once and twice. A document's score is the sum over its words and its end.

Each distinct word is scored once. Blocks of documents (bounded by text bytes, cut where the scan cuts) keep their
word counts as compressed arrays and ask for their own words' scores only, so what is shuffled is one row for each
block and distinct word, not the vocabulary to every task and not each document's words.

Defined results: a null or empty text has its end only; a null id is text '' for the split; repeated rows are
documents each; without training documents the words come from the lattice alone and the end has probability one
half; an empty table gives an empty table. Texts and words are read whole, of any length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, release, ship, stored, text_of

#: Words of up to LONGEST bytes are scored many at a time, longer ones each on its own.
LONGEST, BLOCK_BYTES, ROUNDS, CHUNK = 64, 32 << 20, 3, 8192
_P = np.uint64(0x9E3779B97F4A7C15)
NONE = -1e30


def held_out(doc_id: object, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their starting weights from a sentencepiece model: word marks dropped, A-Z lower-cased, single bytes added.

    A unigram model's scores are log weights. Other kinds hold minus the rank, which becomes a weight by Zipf's rule.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    scores = {i: m.get_score(i) for i in ids}
    ranks = all(float(s).is_integer() for s in scores.values())
    weight: dict[bytes, float] = {}
    for i in ids:
        p = m.id_to_piece(i).replace("▁", "").encode().lower()
        if p:
            weight[p] = weight.get(p, 0.0) + (1 / (10 - scores[i]) if ranks else math.exp(scores[i]))
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, w / (w.sum() * 1.25)  # one token in five ends a word


class Lattice:
    """logp: of each piece, and last of the end of a word."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.index, self.logp, self.end = {p: i for i, p in enumerate(pieces)}, np.append(logp[:-1], NONE), float(logp[-1])
        self.longest = max(map(len, pieces))
        self.by_length = []
        for k in range(1, self.longest + 1):
            own = [(self._code(p), i) for p, i in self.index.items() if len(p) == k]
            own.sort()
            self.by_length.append((np.array([c for c, _ in own], dtype=np.uint64), np.array([i for _, i in own], dtype=np.int64)))

    @staticmethod
    def _code(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * int(_P) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _pieces(self, x: np.ndarray) -> list[np.ndarray]:
        """For each length k from 1, the piece (or the dummy behind the last) at each start of (words, length) bytes."""
        out, h, none = [], np.zeros(x.shape, np.uint64), len(self.logp) - 1
        v = x.astype(np.uint64) + np.uint64(1)
        for k in range(1, min(self.longest, x.shape[1]) + 1):
            h = h[:, : x.shape[1] - k + 1] * _P + v[:, k - 1 :]
            codes, ids = self.by_length[k - 1]
            if not len(codes):
                out.append(np.full(h.shape, none))
                continue
            at = np.minimum(np.searchsorted(codes, h.ravel()), len(codes) - 1)
            out.append(np.where(codes[at] == h.ravel(), ids[at], none).reshape(h.shape))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        t = np.stack(terms)
        most = t.max(axis=0)
        return most + np.log(np.exp(t - most).sum(axis=0))

    def _alike(self, x: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """Words of one length. With counts, adds the expected use of each piece to it."""
        n, length = x.shape
        ids = self._pieces(x)
        lp = [self.logp[i] for i in ids]
        fore = [np.zeros(n)]
        for j in range(1, length + 1):
            fore.append(self._sum([fore[j - k] + lp[k - 1][:, j - k] for k in range(1, min(self.longest, j) + 1)]))
        if counts is not None:
            back = [np.zeros(n)] * (length + 1)
            for j in range(length - 1, -1, -1):
                back[j] = self._sum([back[j + k] + lp[k - 1][:, j] for k in range(1, min(self.longest, length - j) + 1)])
            for k in range(1, min(self.longest, length) + 1):
                for i in range(length - k + 1):
                    use = np.exp(fore[i] + lp[k - 1][:, i] + back[i + k] - fore[length])
                    counts += np.bincount(ids[k - 1][:, i], weights=use, minlength=len(counts))
        return fore[length] + self.end

    def _one(self, w: bytes, counts: np.ndarray | None = None) -> float:
        """A long word: the same recursions, one position after the other."""
        get, lp, length = self.index.get, self.logp, len(w)

        def total(terms: list[float]) -> float:
            most = max(terms)
            return most + math.log(sum(math.exp(t - most) for t in terms))

        fore = [0.0]
        for j in range(1, length + 1):
            fore.append(total([fore[j - k] + lp[i] for k in range(1, min(self.longest, j) + 1) if (i := get(w[j - k : j])) is not None]))
        if counts is not None:
            back = [0.0] * (length + 1)
            for j in range(length - 1, -1, -1):
                own = [(k, i) for k in range(1, min(self.longest, length - j) + 1) if (i := get(w[j : j + k])) is not None]
                back[j] = total([back[j + k] + lp[i] for k, i in own])
                for k, i in own:
                    counts[i] += math.exp(fore[j] + lp[i] + back[j + k] - fore[length])
        return fore[-1] + self.end

    def score(self, words: list[bytes], counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability. With counts, adds the expected use of each piece to it."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for length in np.unique(sizes):
            own = np.flatnonzero(sizes == length)
            if length > LONGEST:
                out[own] = [self._one(words[i], counts) for i in own]
                continue
            for k in range(0, len(own), CHUNK):
                part = own[k : k + CHUNK]
                x = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length)
                out[part] = self._alike(x, counts)
        return out


def _blocks(src: DataFrame) -> DataFrame:
    """Rows of two kinds: (block, word, idx, c: training count) and (block, docs: packed counts, c: training documents)."""
    names = ["block", "word", "idx", "c", "docs"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, small = TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(level=1)
        local: dict[bytes, int] = {}
        ids, outs, cols, counts, size = [], [], [], [], 0
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, local, ids, outs, cols, counts, size
            c = np.zeros(len(local), np.int64)
            for u, n, out in zip(cols, counts, outs):
                if not out:
                    c[u] += n
            packed = pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(outs), pa.array([len(u) for u in cols], pa.int64())], ["doc_id", "held_out", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packed.schema) as w:
                w.write_batch(packed)
            head = sink.getvalue().to_pybytes()
            step = [np.diff(u, prepend=0) for u in cols]
            body = np.concatenate(step).astype("<i4").tobytes() if step else b""
            n = np.concatenate(counts).astype("<i4").tobytes() if counts else b""
            docs = b"".join(len(p).to_bytes(8, "little") + p for p in map(small.compress, (head, body, n)))
            words = list(local)
            for k in range(0, len(words), 50_000):
                m = len(part := words[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(part, pa.binary()), pa.array(np.arange(k, k + m, dtype=np.int32)), pa.array(c[k : k + m]), pa.nulls(m, pa.binary())], names)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, None, None, len(outs) - sum(outs), docs), kinds)], names)
            block, local = block + 1, {}
            ids, outs, cols, counts, size = [], [], [], [], 0

        for b in batches:
            id_kind = b.column(0).type
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc, text in zip(part.column(0).to_pylist(), byte_values(part.column(1))):
                    words = text.lower().split()
                    u, n = np.unique(np.array([local.setdefault(w, len(local)) for w in words], dtype=np.int64), return_counts=True)
                    ids.append(doc)
                    outs.append(held_out(doc))
                    cols.append(u.astype(np.int32))
                    counts.append(n.astype(np.int32))
                    size += len(text)
                    if size >= BLOCK_BYTES:
                        yield from flush()
        if ids:
            yield from flush()

    return src.mapInArrow(rows, "block long, word binary, idx int, c long, docs binary")


def _unpacked(docs: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    big, at, parts = zstandard.ZstdDecompressor(), 0, []
    for _ in range(3):
        n = int.from_bytes(docs[at : at + 8], "little")
        parts.append(big.decompress(docs[at + 8 : at + 8 + n]))
        at += 8 + n
    head = pa.ipc.open_stream(parts[0]).read_next_batch()
    return head, np.frombuffer(parts[1], "<i4"), np.frombuffer(parts[2], "<i4")


def fit(words: DataFrame, pieces: list[bytes], start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces and of a word's end, fitted to the distinct training words, all of them."""
    logp = np.log(np.append(start, 1 - start.sum()))
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)  # as long as the vocabulary

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, n = Lattice(pieces, shared.value), np.zeros(len(pieces) + 1)
            total = 0
            for b in batches:
                for k in range(0, b.num_rows, 1 << 17):
                    w = b.column(0).slice(k, 1 << 17).to_pylist()
                    model.score(w, n)
                    total += len(w)
            n[-1] = total
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["piece", "n"])

        got = words.select("word").mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        use = np.full(len(pieces) + 1, 1e-3)
        use[[i for i, p in enumerate(pieces) if len(p) == 1]] += 0.5
        for piece, n in got:
            use[piece] += n
        use[-1] += 1
        logp = np.log(use / use.sum())
    return logp


def scores(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = df.sparkSession
    ship(spark)
    pieces, start = vocabulary(model_file)
    src = text_of(df, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    blocks = stored(_blocks(src), "lattice-blocks")
    asks = blocks.where("docs is null").select("block", "word", "idx", "c")
    words = stored(asks.groupBy("word").agg(F.sum("c").alias("c")), "lattice-words")
    release(spark)
    sums = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n_docs = blocks.where("docs is not null").agg(F.sum("c")).first()[0] or 0
    n_words, v_words = sums[0] or 0, sums[1]
    n_all, v_all = n_words + n_docs, v_words + (n_docs > 0)
    d = min(max(sums[2] / (sums[2] + 2 * sums[3]), 0.1), 0.95) if sums[2] else 0.5
    logp = fit(words.where("c > 0"), pieces, start) if v_words else np.log(np.append(start, 1 - start.sum()))
    shared = spark.sparkContext.broadcast(logp)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(pieces, shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 1 << 17):
                part = b.slice(k, 1 << 17)
                ln = model.score(part.column(0).to_pylist())
                c = part.column(1).to_numpy(zero_copy_only=False)
                # log10 of (max(c - d, 0) + d * V * exp(ln)) / N, safe for words too long for a double
                if n_all:
                    own = np.log(np.maximum(c - d, 1e-300))
                    lp = np.where(c > 0, np.logaddexp(own, ln + math.log(d * max(v_words, 1))), ln + math.log(d * max(v_words, 1))) - math.log(n_all)
                else:
                    lp = ln + math.log(0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lp / math.log(10))], ["w", "n", "lp"])

    known = words.mapInArrow(score, "w binary, n long, lp double")
    answers = asks.select("block", "word", "idx").join(known, F.col("word") == F.col("w")).select("block", "idx", "n", "lp")
    end_lp = math.log10(n_docs / n_all) if n_docs else math.log10(0.5)
    base_all = n_all + v_all + 1

    def documents(left: pa.Table, right: pa.Table) -> pa.Table:
        idx = right.column("idx").to_numpy()
        n, lp = np.zeros(len(idx), np.int64), np.zeros(len(idx))
        n[idx], lp[idx] = right.column("n").to_numpy(), right.column("lp").to_numpy()
        base = np.log10((n + 1) / base_all)
        out = []
        for packed in left.column("docs").to_pylist():
            head, steps, counts = _unpacked(packed)
            size = head.column(2).to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            # the first step of a document counts from 0
            run = np.cumsum(steps, dtype=np.int64)
            before = np.concatenate([[0], run])[at[:-1]]
            word = run - np.repeat(before, size)

            def total(x: np.ndarray, at=at) -> np.ndarray:
                return np.array([x[a:z].sum() for a, z in zip(at, at[1:])], dtype=x.dtype)

            out.append(pa.table([head.column(0), head.column(1), pa.array(total(counts.astype(np.int64)) + 1), pa.array(total(counts * (n[word] > 0)).astype(np.int64) + (n_docs > 0)), pa.array(np.full(len(size), n_all)), pa.array(total(counts * base[word]) + math.log10((n_docs + 1) / base_all)), pa.array(total(counts * lp[word]) + end_lp)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in zip(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})

    docs = blocks.where("docs is not null").select(F.col("block").alias("of"), "docs")
    return docs.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(documents, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
