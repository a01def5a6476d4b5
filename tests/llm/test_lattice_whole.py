"""The lattice has every piece of the vocabulary, and words of any length are part of the fit."""

import numpy as np
import public_tokenizers

from dialoom.llm import lattice


def test_longest_pieces():
    pieces, start = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert b"international" in pieces and max(map(len, pieces)) > 12
    m = lattice.Lattice(pieces, np.log(np.append(start, 1 - start.sum())))
    assert m.score([b"international"])[0] >= m.logp[m.index[b"international"]] + m.end


def test_long_words_are_counted():
    pieces, start = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    m = lattice.Lattice(pieces, np.log(np.append(start, 1 - start.sum())))
    word, use, alike = b"international" * 6, np.zeros(len(pieces) + 1), np.zeros(len(pieces) + 1)
    assert len(word) > 64
    ln = m.score([word], use)[0]
    same = m._alike(np.frombuffer(word, np.uint8)[None], alike)[0]
    assert np.isclose(sum(use[i] * len(p) for i, p in enumerate(pieces)), len(word)) and np.allclose(use, alike) and np.isclose(ln, same)


def test_fit_has_long_words(spark):
    pieces, start = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    logp = lattice.fit(spark.createDataFrame([(b"international" * 6,)], "word binary"), pieces, start, 1)
    assert logp[pieces.index(b"international")] > logp[pieces.index(b"the")] + 1
