"""The corpus operators against brute force, over rows with every odd case."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoom.llm import ans, components, curve, lattice, licenses, lines, mixing, quality, queries, simhash, tokens, vectors, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, ids string, key string, fp string, keep string, taken string, size string, word string, row string, block string"
EXTRA = [None] * 10


def make_texts():
    rng = random.Random(5)
    syllables = "ka lo mi re tu san der the éa ność q ".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: "".join(word() + rng.choice([" ", " ", " ", "\n", ", ", ".\n"]) for _ in range(n))
    base = [text(rng.randint(12, 90)) for _ in range(30)]
    near = [b.replace("ka", "lo", 1) for b in base[:6]]
    common = ["Subscribe to our Newsletter today\n" + b for b in base[10:26]]
    return [None, "", " \n\t\n", "one", "a b c", "　x y　", *base, *near, base[0], base[0], *common, text(20000), "x y " * 60, "%% ## $$ " * 30, "Ωσ ΑΣ <|endoftext|> Å  \n\n\n tail  ", "a<|ENDOFTEXT|>b <|startoftext|> c <|x", "a\x1cb \x1f c\u2003d\u00a0 e", "Released under the MIT License. " + base[3]]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(make_texts())]
    return [*out, out[9], out[9], (None, "null id text with ten words or more in it now here", "en", "s1"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, *EXTRA) for i, t, g, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


# ---- 8


def brute_measure(t):
    words, seen, dup = WORD.findall(raw(t)), set(), 0
    for x in raw(t).split(b"\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    at = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), dup, len(at)


def test_quality(docs, rows, empty):
    got = Counter((r["doc_id"], *(r[k] for k in quality.MEASURES[:5])) for r in quality.ledger(docs).collect())
    assert got == Counter((i, *brute_measure(t)) for i, t, *_ in rows)
    entries = quality.with_policy(quality.ledger(docs)).cache()
    kept = entries.where("kept").count()
    assert quality.keep(docs).count() == kept and quality.keep(docs).columns == docs.columns and 0 < kept < len(rows)
    for r in quality.ablations(entries).collect():
        mask = quality.POLICIES["production-1"] & ~(1 << next(x.bit for x in quality.RULES if x.name == r["rule"]))
        assert r["n_kept_without"] == entries.where(F.col("fail_bits").bitwiseAND(mask) == 0).count()
    assert quality.keep(empty).count() == quality.ledger(empty).count() == 0


# ---- 7


def byte_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_ans(spark, docs, rows, empty, tmp_path):
    ids, path = byte_ids(), f"{tmp_path}/ids"
    ans.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0, block_ids=3000)
    got = sorted(ans.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(ids(t))) for i, t, *_ in rows)
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 3
    damaged = f"{tmp_path}/damaged"
    spark.read.parquet(f"{path}/table").write.parquet(f"{damaged}/table")
    blocks.withColumn("words", F.overlay("words", F.lit(b"\x00\x01\x02\x03\x04"), F.lit(9))).write.parquet(f"{damaged}/blocks")
    with pytest.raises(Exception, match="damaged"):
        ans.read(spark, damaged).collect()
    assert ans.round_trip(empty, public_tokenizers.path("byte_bpe_50k.json"), 0).count() == 0


def test_ans_coder():
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 65536, 65537, 150000):
        x = np.minimum(rng.zipf(1.3, n), 60000).astype("<u2")
        s, c = np.unique(x, return_counts=True)
        t = ans.Table.counted(s.astype(np.int64), c.astype(np.int64))
        assert t.freqs.sum() == 1 << ans.SCALE and t.freqs.min() > 0
        assert (ans.decode(n, *ans.encode(x, t), t) == x).all()


def test_byte_encoder():
    """The library's ids, whatever meets at a cut; a word is learned once, whatever stands around it."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    signs = [*" \n\t\r\x0b'-.<|_19aBs", " ", "'", "ll", "re", "é", "ß", "×", "\u0301", "\u00a0", "\u2003", "\u3000", "\x1c", "\x00", "漢", "“", "²", "<|endoftext|>"]
    texts = ["".join(rng.choices(rng.sample(signs, 9), k=rng.randint(0, 20))).encode() for _ in range(5000)]
    texts += [bytes(rng.choices(t, k=len(t))) for t in texts if t]
    model, few = Tokenizer.from_file(path), tokens.Encoder(path, "byte", 7)
    want = [np.array(e.ids, "<u2").tobytes() for e in model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
    assert tokens.Encoder(path, "byte").ids(texts) == want
    assert [x for i in range(0, len(texts), 37) for x in few.ids(texts[i : i + 37])] == want
    assert few.ids([]) == [] and few.ids([b"", b""]) == [b"", b""]
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    many = tokens.Encoder(path, "byte")
    many.ids([f"{w}, {w}. {w}! {w}\n{w}: ({w}) {w}-{w}".encode() for w in words])
    assert len(many.memo) == 2 * len(words) + 8  # with a blank in front and without; , . ! : ) - line end, bracket with a blank


# ---- 1


def test_packing(docs, rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, *_ in rows)
    got = curve.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    crc = lambda ids, a, n: zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())
    for (doc, ids), n in want.items():
        own = [r for r in got if r["doc_id"] == doc and r["doc_tokens"] == len(ids) and r["start"] + r["length"] <= len(ids) and r["ids_crc32"] == crc(ids, r["start"], r["length"])]
        assert sum(r["length"] for r in own) >= len(ids) * n
    assert curve.pack(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_encoder_memo():
    """A larger memo gives the same ids and learns no word twice that a smaller one has dropped."""
    path, texts = public_tokenizers.path("word_bpe_49k.json"), [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} und, mehr".encode() for i in range(500)]
    few, many = tokens.Encoder(path, "word", 4), tokens.Encoder(path, "word", 10**6)
    assert few.ids(texts * 3) == many.ids(texts * 3) and len(few.memo) < len(many.memo) == 503


def test_hilbert():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curve.hilbert(grid, 2)
    assert sorted(key) == list(range(64))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours


# ---- 10


def test_warc(spark, tmp_path):
    big, tricky = "é" * 90000, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 40
    pages = [(1, "u", big), (2, "u", big), (3, None, "x" * 999), (4, "u v", "x" * 999), (5, "u", tricky), (9, "u", tricky), (7, "u", None), (8, "u", ""), (None, "u", big), (6, "u", "y" * 1000), (6, "u", "y" * 1000)]
    df = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, digest string, same string").repartition(2)
    warc.write(df, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w", with_payload=True).collect()
    best = {}
    for i, _, h in pages:
        if len(raw(h)) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    n = Counter(h for *_, h in pages)
    want = []
    for i, _, h in pages:
        refers = best[h] if h in best and n[h] > 1 and i != best[h] else None
        want.append((i, len(raw(h)), hashlib.sha1(raw(h)).hexdigest(), "response" if refers is None else "revisit", refers))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    assert all(bytes(r["payload"]) == raw(next(h for i, _, h in pages if i == r["page_id"])) for r in got if r["record_type"] == "response")
    assert warc.round_trip(df.limit(0)).count() == 0
    # what is referred to is there, in files that any reader of gzip takes, and so are the records of archives of other writers
    heads = [h for f in (tmp_path / "w").glob("part-*") for h, _ in warc.parse(gzip.decompress(f.read_bytes()))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= set(ids) and any(h["warc-type"] == "warcinfo" for h in heads)
    (tmp_path / "o").mkdir()
    one = [b"\r\n\r\n".join([*warc.records(i, None, b"x" * i, None, 0), b""]) for i in (1, 2, 3)]
    (tmp_path / "o" / "a.warc.gz").write_bytes(gzip.compress(one[0]) + gzip.compress(one[1] + one[2]))
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read(spark, f"{tmp_path}/o").collect()) == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


# ---- 6


def brute_lines(rows, min_docs, mode, min_chars=1):
    known = {(i, t or "") for i, t, *_ in rows}
    order = sorted(known, key=lambda d: (d[0] is not None, d[0] or 0))
    where = defaultdict(list)
    for i, t in order:
        for p, x in enumerate(raw(t).split(b"\n")):
            k = x.strip(b" \t\n\x0b\x0c\r").lower()
            if len(k.decode()) >= min_chars:
                where[k].append((i, t, p))
    gone = set()
    for at in where.values():
        if len({(i, t) for i, t, _ in at}) >= min_docs:
            gone |= set(at[1:] if mode == "first" else at)
    out = {}
    for i, t in known:
        parts = raw(t).split(b"\n")
        out[i, t] = (len(parts), [x for p, x in enumerate(parts) if (i, t, p) not in gone])
    return out


@pytest.mark.parametrize("mode, min_docs, min_chars", [("all", 10, 1), ("all", 2, 1), ("first", 2, 1), ("first", 10, 16)])
def test_lines(docs, rows, empty, mode, min_docs, min_chars):
    marks = lines.bitmaps(lines.dropped(docs, min_docs, min_chars, mode)).cache()
    want = brute_lines(rows, min_docs, mode, min_chars)
    got = Counter(tuple(r) for r in lines.digests(docs, marks).collect())
    assert got == Counter((i, want[i, t or ""][0], want[i, t or ""][0] - len(want[i, t or ""][1]), hashlib.sha256(b"\n".join(want[i, t or ""][1])).hexdigest()) for i, t, *_ in rows)
    left = lines.apply(docs, marks)
    assert left.columns == docs.columns
    keep = [(i, t if t is None else b"\n".join(want[i, t][1]).decode()) for i, t, *_ in rows if len(want[i, t or ""][1]) == want[i, t or ""][0] or b"".join(want[i, t or ""][1]).strip()]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(keep)
    assert lines.dropped(empty, min_docs, min_chars, mode).count() == 0


def test_lines_runs(spark):
    """One line in most documents, dealt over many partitions, and runs that end at partition ends."""
    rows = [(i, "\n".join(["every"] * (i % 3) + [f"own {i}", f"pair {i // 2}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    for mode in ("all", "first"):
        want = brute_lines(rows, 2, mode)
        got = {r["doc_id"]: r["n_dropped"] for r in lines.digests(df, lines.bitmaps(lines.dropped(df, 2, 1, mode))).collect()}
        assert got == {i: want[i, t][0] - len(want[i, t][1]) for i, t in rows}


@pytest.mark.parametrize("mode", ["all", "first"])
def test_lines_long_runs(spark, mode):
    """A run that is longer than a task holds at once, in one partition and in several."""
    rows = [(i, "\n".join(["every"] * 11_000 + [f"own {i}"])) for i in range(12)]
    want = {i: 11_000 - (mode == "first" and i == 0) for i, _ in rows}
    for parts in (1, 5):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r["n_dropped"] for r in lines.digests(df, lines.bitmaps(lines.dropped(df, 10, 1, mode))).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want


@pytest.mark.parametrize("mode", ["all", "first"])
def test_lines_ids_as_text(spark, mode):
    """Ids that are no numbers, one of them null; runs that partition ends cut."""
    rows = [(None if i == 5 else f"d{i:03d}", "\n".join(["every"] * (i % 3) + [f"own {i}", f"pair {i // 2}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    want = brute_lines([(None if i is None else int(i[1:]), t) for i, t in rows], 2, mode)
    marks = lines.bitmaps(lines.dropped(df, 2, 1, mode)).cache()
    got = {r["doc_id"]: r["n_dropped"] for r in lines.digests(df, marks).collect()}
    assert got == {i: (lambda w: w[0] - len(w[1]))(want[None if i is None else int(i[1:]), t]) for i, t in rows}
    left = {r["doc_id"]: r["text"] for r in lines.apply(df, marks, drop_emptied=False).collect()}
    assert left == {i: b"\n".join(want[None if i is None else int(i[1:]), t][1]).decode() for i, t in rows}


# ---- 5


def test_mixing(docs, rows, empty):
    size = lambda t: len(WORD.findall(raw(t)))
    n = defaultdict(int)
    for _, t, _, s in rows:
        n[s] += size(t)
    names = sorted(n, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left = 1.5 * sum(n.values()) - sum(2 * n[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / free > 2 * n[s]}
        if not over:
            break
        capped |= over
    goal = {s: 2.0 * n[s] if s in capped else left * w[s] / free for s in names}
    got = mixing.taken(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, size(t), n[s]) for i, t, _, s in rows)
    of = {(i, size(t)): s for i, t, _, s in rows}
    total, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert math.isclose(r["target"], goal[s], rel_tol=1e-12) and (r["size"] == 0 or r["taken"] % r["size"] == 0) and r["taken"] <= 2 * r["size"]
        total[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(total[s] - goal[s]) <= largest[s] * 1.5 for s in names)
    again = mixing.taken(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mix = mixing.apply(docs)
    assert mix.columns == docs.columns and sum(size(r["text"]) for r in mix.collect()) == sum(total.values())
    assert mixing.taken(empty).count() == mixing.apply(empty).count() == 0


# ---- 3


def brute_components(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_print(t, k=4):
    import xxhash

    words = WORD.findall(raw(t).lower())
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_simhash(docs, rows, empty):
    fps = [brute_print(t) for _, t, *_ in rows]
    root = brute_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    name = {r: smallest([rows[i][0] for i in range(len(rows)) if root[i] == r]) for r in set(root)}
    got = simhash.cluster(docs).select("doc_id", simhash.hexed("fp"), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((rows[i][0], f"{fps[i]:016x}", name[root[i]]) for i in range(len(rows)))
    left = simhash.representatives(docs)
    assert left.columns == docs.columns and left.count() == len(set(root))
    assert simhash.cluster(empty).count() == simhash.representatives(empty).count() == 0


def test_simhash_tiles(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)})
    root = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for tile in (8, 4096):
        e = [(r["a"], r["b"]) for r in simhash.links(df, 4, tile).collect()]
        at = {simhash._signed(x): i for i, x in enumerate(fps)}
        got = components.forest(len(fps), np.array([at[a] for a, _ in e]), np.array([at[b] for _, b in e]))
        assert got.tolist() == root
    assert all(len(simhash.masks(n, 4)) == k for n, k in ((100, 5), (1 << 27, 15)))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = {}
    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    e = [(at[a], at[b]) for a, b in links if a != b]
    label = components.forest(len(nodes), np.array([a for a, _ in e]), np.array([b for _, b in e]))
    want = {x: nodes[label[i]] for i, x in enumerate(nodes)}
    assert got == want


# ---- 9


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    vecs = [(centres[i % 6] + 0.05 * rng.standard_normal(16)).tolist() for i in range(60)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(60, vecs[0], 0), (60, vecs[0], 0), (61, None, 0), (62, [0.0] * 16, 0), (63, [float("nan")] * 16, 0), (64, [None] * 16, 0), (65, vecs[1], None), (66, [], 0), (67, vecs[0][:3], 0), (68, [2 * x for x in vecs[3]], 1)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, node string, n string").repartition(3)
    f = [None if v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) or g is None else np.array(v, np.float32).astype(float) for _, v, g in rows]

    def near(i, j):
        return f[i] is not None and f[j] is not None and rows[i][2] == rows[j][2] and len(f[i]) == len(f[j]) and f[i] @ f[j] / math.sqrt(f[i] @ f[i]) / math.sqrt(f[j] @ f[j]) >= 0.98

    root = brute_components(len(rows), near)
    name = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = Counter((rows[i][0], sum(near(i, j) for j in range(len(rows)) if j != i), name[root[i]], rows[i][0] == name[root[i]]) for i in range(len(rows)))
    for tile in (4, 2048):
        assert Counter(map(tuple, vectors.cluster(df, tile=tile).collect())) == want
    assert vectors.cluster(df.limit(0)).count() == 0


# ---- 2


def test_lattice(docs, rows, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.scores(docs, model).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, n_docs = Counter(), 0
    words = [WORD.findall(raw(t).lower()) for _, t, *_ in rows]
    for (i, *_), ws in zip(rows, words):
        if not held(i):
            c.update(ws)
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    want = Counter()
    for (i, *_), ws in zip(rows, words):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((n_docs + 1) / (n + v + 1))
        want[i, held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice.scores(empty, model).count() == 0
    # held-out texts are likelier under the model than under one that knows bytes only
    out = [r for r in got if r["held_out"]]
    assert out and sum(r["score"] for r in out) > -sum(len(raw(next(t for i, t, *_ in rows if i == r["doc_id"]))) for r in out) * math.log10(256)


def test_lattice_recursion():
    pieces, start = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    m = lattice.Lattice(pieces, np.log(np.append(start, 1 - start.sum())))

    def brute(w):
        return 1.0 if not w else sum(math.exp(m.logp[m.index[w[:k]]]) * brute(w[k:]) for k in range(1, min(lattice.LONGEST, len(w)) + 1) if w[:k] in m.index)

    words = [b"the", b"hhhtion", "ééaé".encode(), b"x", b"\xff\xfe"]
    assert np.allclose(m.score(words), [math.log(brute(w)) + m.end for w in words])
    long = b"ab" * 40
    assert np.isclose(m.score([long])[0], m._one(long)) and np.isclose(m._alike(np.frombuffer(long[:60], np.uint8)[None], None)[0], m._one(long[:60]))
    use = np.zeros(len(pieces) + 1)
    m.score([b"the"], use)
    assert np.isclose(sum(use[i] * len(p) for i, p in enumerate(pieces)), 3)  # expected pieces cover the word


# ---- 4


def test_licenses(docs, rows, spark, empty):
    long = licenses.NOTICES["apache-2.0"]
    changed = long.replace("agreed", "settled")
    more = spark.createDataFrame([(100, "w " * 300 + changed.upper() + " w" * 300), (101, long[: len(long) // 2]), (100, "x"), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(more).collect()}
    assert got == {(100, "apache-2.0"), (100, "apache-2.0-line"), (101, "apache-2.0-line"), (None, "cc-by-nc-4.0-line")}
    assert [(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(docs).collect()] == [(next(i for i, t, *_ in rows if t and t.startswith("Released")), "mit-line", 0)]
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"x": "too short"})


# ---- the pipeline


def test_pipeline(spark, docs, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    keep = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES[:-1], range(4)):
        before = keep.collect()
        keep = stage(spark, keep, "").cache()
        after = keep.collect()
        assert keep.columns == docs.columns
        if check == 0:
            fine = lambda r: (lambda m: m[0] >= 10 and 5 * m[4] <= m[0])(brute_measure(r["text"]))
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if fine(r)} and len(after) > 40
        if check == 1:
            want = brute_lines([tuple(r[:4]) for r in before], 10, "first", 16)
            assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after) == Counter((r["doc_id"], x, len(x)) for r in before if (x := b"\n".join(want[r["doc_id"], r["text"]][1]).decode()).strip())
        if check == 2:
            before.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            fps = [brute_print(r["text"], 5) for r in before]
            root = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
            left = [before[i] for i in sorted(set(root))]
            sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(WORD.findall(raw(r["text"]).lower())) for r in left]
            root = brute_components(len(left), lambda i, j: 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])))
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((left[i]["doc_id"], left[i]["text"]) for i in set(root))
        if check == 3:
            assert {r["text"] for r in after} <= {r["text"] for r in before} and max(Counter(r["doc_id"] for r in after).values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, keep, "").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in keep.collect()}


def test_pipeline_of_nothing(empty, spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_run(spark):
    """Every piece is of a document of the table, and copies and rejected documents are gone."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got and {r["doc_id"] for r in got} <= {i for i, t in docs.items() if (lambda m: m[0] >= 10 and 5 * m[4] <= m[0])(brute_measure(t))}
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in by.values())


def test_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(queries.ORACLES) <= set(queries.QUERIES)
