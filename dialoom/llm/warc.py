"""WARC archives: records written in segments, read back and put together again.

Writing: a payload is framed in chunked transfer coding behind an HTTP header; a block longer than SEGMENT bytes
is cut into a first record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, and on the last
one WARC-Segment-Total-Length). Of equal payloads of MIN_REVISIT bytes or more, the largest page is the response
and the others are revisit records that refer to its record. Every record is a gzip member of its own, so archives can be
read from any record on; the first of a task is a warcinfo. Files come from Spark's text writer, RECORDS_A_FILE each;
since no record's block is longer than SEGMENT, that bounds their bytes too. The writer ends each value with a separator:
it is the zero byte in which a member of less than 16 MB ends.

Reading: all members of a file are inflated, one record or many in each. They are parsed by Content-Length, never by looking
for a mark that a payload might hold. Segments are grouped by origin, ordered by number, checked against the total
length, and the chunks are decoded; payload digests are checked.

Defined results: a null html is an empty payload; a null page_id is written as such and never preferred as the
response; rows that share the largest page_id of their payload are all responses; pages of any length are written in
segments; an empty table gives an empty archive. Ids are numbers.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, byte_values, new_path, scratch, ship, slices, stored

SEGMENT, CHUNK, MIN_REVISIT, RECORDS_A_FILE = 1 << 16, 1 << 14, 1000, 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are dropped, a broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : at])
        at += 2


def _head(kind: str, record: str, length: int, more: list[tuple[str, object]]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", "2024-01-01T00:00:00Z"), *more, ("Content-Length", length)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def records(page: int | None, url: str | None, payload: bytes, refers_to: tuple[int, int] | None, unique: int) -> list[bytes]:
    """The records of one page, without the two line ends that close a record. refers_to: page and number of the response's row."""
    name = f"<urn:page:{'' if page is None else page}:{unique}>"
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else None
    more = [("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = _HTTP
        more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", "<urn:page:{}:{}>".format(*refers_to)), ("X-Payload-Length", len(payload))]
        return [_head("revisit", name, len(block), more) + block]
    block = _HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        return [_head("response", name, len(block), more) + block]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [_head("response", name, len(parts[0]), [*more, ("WARC-Segment-Number", 1)]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        extra = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)]
        out.append(_head("continuation", f"<urn:segment:{unique}:{k}>", len(part), extra) + part)
    return out


def member(record: bytes) -> bytes:
    """A record with its two line ends as a gzip member, without the zero byte that ends it."""
    raw = gzip.compress(record + b"\r\n\r\n", 6, mtime=0)
    if raw[-1]:
        raise ValueError("a record of 16 MB or more")
    return raw[:-1]


def inflated(raw: bytes) -> bytes:
    """All gzip members, one after the other."""
    out = []
    while raw:
        one = zlib.decompressobj(wbits=31)
        out += [one.decompress(raw), one.flush()]
        if not one.eof:
            raise ValueError("a gzip member is cut off")
        raw = one.unused_data
    return b"".join(out)


def originals(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, row (a number of its own) and refers_to: page and row of the page whose payload is the same, where it is another."""
    # stored, so that both sides of the join see the same numbers
    src = stored(pages.withColumn("row", F.monotonically_increasing_id()), "warc-pages").withColumn("same", F.when(F.octet_length("html") >= MIN_REVISIT, F.concat(F.lit("p"), F.sha2(F.col("html").cast("binary"), 256))))
    first = src.where("same is not null").groupBy("same").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # other key columns than those that the groups are dealt by, so that a join's large keys can be split at run time
    first = first.select(F.concat(F.lit("k"), "same").alias("key"), "first")
    first = stored(first, "warc-first")
    first = F.broadcast(first) if first.count() <= FEW // 8 else first  # else pages are shuffled
    return src.withColumn("key", F.concat(F.lit("k"), "same")).join(first, "key", "left").withColumn("refers_to", F.expr("if(page_id <=> first.page_id, null, first)")).select("page_id", "url", "html", "row", "refers_to.page_id", F.col("refers_to.row").alias("to_row")).toDF("page_id", "url", "html", "row", "to_page", "to_row")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    ship(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: dialoom\r\nformat: WARC File Format 1.1\r\n"
        head = _head("warcinfo", f"<urn:info:{TaskContext.get().partitionId()}>", len(about), [("Content-Type", "application/warc-fields")]) + about
        for b in slices(batches, 256):
            out, head = [head] if head else [], b""
            for page, url, html, row, to_page, to_row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_values(b.column(2)), *(b.column(i).to_pylist() for i in (3, 4, 5))):
                out += records(page, url, html, None if to_page is None else (to_page, to_row), row)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(member, out)), pa.binary())], ["record"])

    done = originals(src, "page_id", "html").mapInArrow(rows, "record binary")
    # each member's bytes as they are; the separator is its last byte
    done.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = raw[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        at += 4
        yield head, block


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").rstrip(">").split(":")[0]
    return int(digits) if digits else None


def _payload(block: bytes, digest: str) -> bytes:
    header, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in header.lower() else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return payload


_COLS = "origin string, number int, total long, page_id long, kind string, refers_to long, digest string, n_bytes long, block binary"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page in the archives, its payload if asked for."""
    ship(spark)
    names = [x.split()[0] for x in _COLS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                got: list[tuple] = []
                for h, block in parse(inflated(raw.as_py())):
                    name, kind = h["warc-record-id"], h["warc-type"]
                    if kind == "continuation":
                        got.append((h["warc-segment-origin-id"], int(h["warc-segment-number"]), int(h.get("warc-segment-total-length", -1)), None, None, None, None, None, block))
                    elif kind in ("response", "revisit"):
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        parts, n = "warc-segment-number" in h, None
                        refers = _page(h["warc-refers-to"]) if kind == "revisit" else None
                        if not parts:
                            payload = _payload(block, digest) if kind == "response" else b""
                            n, block = (len(payload), payload if with_payload else None) if kind == "response" else (int(h["x-payload-length"]), None)
                        got.append((name, 1 if parts else 0, -1, _page(name), kind, refers, digest, n, block))
                    if len(got) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)
                        got = []
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = b.column(4).to_pylist(), b.column(6).to_pylist()
            if any(n is None for n in sizes):
                for i, n in enumerate(sizes):
                    if n is None:
                        parts = b.column(5)[i].as_py()
                        if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                            raise ValueError(f"{b.column(0)[i]}: a segment is missing or there twice")
                        block = b"".join(p["block"] for p in parts)
                        if max(p["total"] for p in parts) != len(block):
                            raise ValueError(f"{b.column(0)[i]}: the segments have not the total length")
                        payload = _payload(block, b.column(3)[i].as_py())
                        sizes[i], out[i] = len(payload), payload if with_payload else None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(3), b.column(1), b.column(2), *[pa.array(out, pa.binary())] * with_payload], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    part = F.when(F.col("number") > 0, F.struct("number", "total", "block"))
    one = (
        files.mapInArrow(rows, _COLS)
        .groupBy("origin")
        .agg(F.max("page_id").alias("page_id"), F.max("kind").alias("kind"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.when(F.col("number") == 0, F.col("block"))).alias("block"))
        .select("page_id", "kind", "refers_to", "digest", "n_bytes", "parts", "block")
    )
    return one.mapInArrow(whole, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    write(pages, path := new_path(pages.sparkSession, "warc"))
    scratch(pages.sparkSession, path)
    return read(pages.sparkSession, path)
