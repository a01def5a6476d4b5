"""Token ids of texts with the tokenizers library, a memo of text pieces saving repeated work.

Both vocabularies cut a text into parts that never reach across certain places, so that the ids of a text are
those of its pieces, one after the other, when it is cut there:

* ``word``: white space is dropped, so a text may be cut at every run of ASCII white space.
* ``byte``: a match never goes on from a visible character to white space, nor between ASCII letters, digits and
  punctuation (but from an apostrophe to a letter); of white space before a visible character the last one stands
  alone, or if it is a blank, with what follows. Other white space could join such a run; texts that have any are
  encoded whole. Texts are cut many at a time, and each distinct piece of them is looked up once.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Pieces in each of a memo's two generations.
MEMO = {"byte": 500_000, "word": 250_000}
#: White space beyond ASCII, in UTF-8.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
#: Bytes of which one or more are in each of them; most texts have none, and need no search for the whole.
_HINTS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
#: What special tokens begin with; the library cuts them out of a text first, so such texts are encoded whole.
_SPECIAL = b"<|"


def _classes() -> bytes:
    """Of each byte: 0 blank, 1 other ASCII white space, 2 letter, 3 digit, 4 punctuation, 5 apostrophe, 6 what may begin other white space, 7 the rest."""
    kind = bytearray([7]) * 256
    for c in range(33, 127):
        kind[c] = 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 4
    for some, k in ((b" ", 0), (b"\t\n\x0b\x0c\r", 1), (b"'", 5), (bytes(x[0] for x in _HINTS), 6)):
        for c in some:
            kind[c] = k
    return bytes(kind)


_CLASS = _classes()
#: At 8 * the class before + the class: whether a piece begins there, whatever follows.
_BEGINS = np.zeros(64, bool)
for _before, _now in ((_a, _b) for _a in range(8) for _b in range(8)):
    if _now < 2:
        _BEGINS[8 * _before + _now] = _before > 1
    elif _before < 2:
        _BEGINS[8 * _before + _now] = _before == 1
    elif _before < 6 and _now < 6:
        _BEGINS[8 * _before + _now] = _before != _now and (_before, _now) not in ((5, 2), (4, 5), (5, 4))
#: Bytes of texts that are cut at a time, but for longer texts.
GROUP = 8 << 20

#: A word of letters for which each vocabulary makes a part of its own (ASCII and Latin-1), a blank in front perhaps,
#: and ASCII punctuation behind it, which is one more part.
_WORD = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
_BEHIND = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Encoder:
    """ids(texts) gives little-endian unsigned 16-bit ids as bytes for each text, those of the library without special tokens added.

    Words are encoded many at a time, as one text in which the ids that end (or begin) a word are known; punctuation
    behind a word is known by itself.
    """

    def __init__(self, path: str, kind: str, memo: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if not all(t.content.startswith(_SPECIAL.decode()) for t in self.model.get_added_tokens_decoder().values()):
            raise ValueError("special tokens of another form")
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.word, self.most = kind == "word", memo or MEMO[kind]
        self.mark = np.zeros(1 << 16, bool)  # ids that end a word, or begin one with a space
        self.line = np.zeros(1 << 16, bool)  # ids of a line end
        for token, i in self.model.get_vocab().items():
            self.mark[i] = token.endswith("</w>") if self.word else token.startswith("\u0120")
            self.line[i] = token == "\u010a"
        self.behind: dict[bytes, bytes] = {b"": b""}
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _words(self, text: bytes) -> list[bytes] | None:
        """The pieces of a text; none: it is encoded whole."""
        if _SPECIAL in text:
            return None
        # the vocabulary is lower-case; before a combining mark a letter's case can matter
        return (text if b"\xcc" in text else text.lower()).split()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 256):  # the library's results are much larger than the ids
            some = self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[i : i + 256]], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u2").tobytes() for e in some]
        return out

    def _together(self, pieces: list[bytes], between: bytes, mark: np.ndarray, ends: bool) -> list[bytes]:
        """The ids of each piece. Many pieces, with `between` in front of each, are encoded as one text; in its ids those of `mark` end a piece, or begin one."""
        out: list[bytes] = []
        groups = [pieces[i : i + 64] for i in range(0, len(pieces), 64)]
        for part, raw in zip(groups, self._encode([between + between.join(g) for g in groups])):
            ids = np.frombuffer(raw, dtype="<u2")
            at = np.flatnonzero(mark[ids])
            if len(at) != len(part):
                out += self._encode(part)
                continue
            a = 0
            for z in (2 * (at + 1 if ends else np.append(at[1:], len(ids)))).tolist():
                out.append(raw[a:z])
                a = z
        return out

    def _learn(self, new: set[bytes]) -> None:
        """Pieces that are not in the memo, into it."""
        memo, old = self.memo, self.old
        known = new & old.keys()
        memo.update(zip(known, map(old.__getitem__, known)))
        words, joined, rest = [], [], []
        for p in new - known:
            if p.isalpha() or p[0] == 32 and p[1:].isalpha():
                words.append(p)
            elif (stem := p.rstrip(_BEHIND)).isalpha():
                joined.append((p, stem, p[len(stem) :]))
            elif m := _WORD.fullmatch(p):
                joined.append((p, *m.groups()))
            else:
                rest.append(p)
        stems = {stem for _, stem, _ in joined}.difference(words).difference(memo)
        known = stems & old.keys()
        memo.update(zip(known, map(old.__getitem__, known)))
        words += stems - known
        if self.word:
            memo.update(zip(words, self._together(words, b" ", self.mark, True)))
        else:
            blank, bare = [p for p in words if p[0] == 32], [p for p in words if p[0] != 32]
            memo.update(zip(blank, self._together(blank, b"", self.mark, False)))
            # a line end before a visible character is an id of its own
            memo.update((p, x[2:]) for p, x in zip(bare, self._together([b"\n" + p for p in bare], b"", self.line, False)))
        tails = list({tail for _, _, tail in joined}.difference(self.behind))
        self.behind.update(zip(tails, self._encode(tails)))
        for p, stem, tail in joined:
            memo[p] = memo[stem] + self.behind[tail]
        if len(self.behind) > self.most:
            self.behind = {b"": b""}
        memo.update(zip(rest, self._encode(rest)))

    def _turn(self) -> None:
        """A full memo becomes the old one."""
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return self._word_ids(texts) if self.word else self._byte_ids(texts)

    def _word_ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 64):
            some = texts[i : i + 64]
            keys = [self._words(t) for t in some]
            self._turn()
            if new := set().union(*filter(None, keys)).difference(self.memo):
                self._learn(new)
            of = self.memo.__getitem__
            out += [self._encode([t])[0] if k is None else b"".join(map(of, k)) for t, k in zip(some, keys)]
        return out

    def _byte_ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > GROUP:
                out += self._group_ids(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self._group_ids(some)

    def _group_ids(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        kind = np.frombuffer(data.translate(_CLASS), np.uint8)
        doubtful = np.unique(np.searchsorted(ends, np.flatnonzero(kind == 6), "right")).tolist()
        whole = {i for i in doubtful if any(x in texts[i] for x in _HINTS) and _OTHER_SPACE.search(texts[i])}
        if _SPECIAL in data:
            whole.update(i for i, t in enumerate(texts) if _SPECIAL in t)
        if whole:
            rest = iter(self._group_ids([t for i, t in enumerate(texts) if i not in whole]))
            return [self._encode([t])[0] if i in whole else next(rest) for i, t in enumerate(texts)]
        begins = np.ones(len(data), bool)
        begins[1:] = _BEGINS[8 * kind[:-1] + kind[1:]]
        # the last white space before a visible character
        last = (kind[:-1] < 2) & (kind[1:] > 1)
        last[ends[(ends > 0) & (ends < len(data))] - 1] = False
        begins[:-1] |= last
        begins[ends[ends < len(data)]] = True
        at = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        _, places, raw = pieces.dictionary.buffers()
        places, raw = np.frombuffer(places, np.int64)[: len(pieces.dictionary) + 1].tolist(), raw.to_pybytes()
        keys = [raw[a:z] for a, z in zip(places, places[1:])]
        self._turn()
        known = list(map(self.memo.get, keys))
        if new := {k for k, x in zip(keys, known) if x is None}:
            self._learn(new)
            known = [self.memo[k] if x is None else x for k, x in zip(keys, known)]
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        _, places, raw = ids.buffers()
        cut = np.frombuffer(places, np.int64)[: len(at) + 1][np.searchsorted(at, np.append(0, ends))].tolist()
        raw = raw.to_pybytes()
        return [raw[a:z] for a, z in zip(cut, cut[1:])]


_ENCODERS: dict[tuple[str, str, int | None], Encoder] = {}


def encoder(path: str, kind: str, memo: int | None = None) -> Encoder:
    """One for each Python worker. memo: pieces in each of its memo's generations."""
    if (path, kind, memo) not in _ENCODERS:
        _ENCODERS[path, kind, memo] = Encoder(path, kind, memo)
    return _ENCODERS[path, kind, memo]


def forget() -> None:
    """Drop this worker's encoders and their memos, where what it runs next needs none."""
    _ENCODERS.clear()
