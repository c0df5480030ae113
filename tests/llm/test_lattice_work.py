import math

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from skerry.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lattice.load_pieces(PATH)


def test_counting_a_slice_takes_no_pass_over_all_its_words_for_each_text(monkeypatch):
    made = []
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    frame = pd.DataFrame({"id": [str(k) for k in range(200)] + [None], "text": [f"a a w{k}" for k in range(200)] + [""]})
    words = pd.concat([f for f in lattice._sliced(iter([frame])) if f["kind"].iloc[0] == 1])
    learnt = [k for k in range(200) if lattice.zlib.crc32(str(k).encode()) % 10]
    assert dict(zip(words["word"], words["n"])) == {"a": 2 * len(learnt)} | {f"w{k}": int(k in learnt) for k in range(200)}
    assert sum(map(len, made)) <= 2 * len(words)


def test_a_search_ends_where_no_piece_goes_on(pieces, monkeypatch):
    looked = []
    real = lattice.Pieces.find
    monkeypatch.setattr(lattice.Pieces, "find", lambda self, h: looked.append(len(h)) or real(self, h))
    words = ["".join(chr(97 + (k * j * 7 + j) % 26) for j in range(1, 41)) for k in range(50)]
    found = {(a, b, words[r]) for a, b, rows, k, _ in pieces.arcs(words) if k is not None for r in rows}
    marked = {w: lattice.MARK + w for w in words}
    assert found == {(a, b, w) for w, m in marked.items() for a in range(41) for b in range(a + 1, min(41, a + lattice.LONGEST_PIECE) + 1) if m[a:b] in pieces.by_name}
    assert sum(looked) < 50 * 41 * 8  # of up to 16 ends for each start


@pytest.mark.parametrize("faint", [1e-200, math.inf, 0.0])
def test_probabilities_and_their_logarithms_agree(pieces, monkeypatch, faint):
    """From FAINT on words are summed as probabilities, below it as logarithms; infinity takes all words the second way."""
    words = ["tion", "international", "x", "▁a▁", "été", "日本語の文章です", "qzxj" * 10, "the", "THE"]
    times, logp = np.arange(1.0, len(words) + 1), np.log(pieces.prior)
    want = [lattice._long(w, pieces, logp) for w in words]
    counts = np.zeros(len(logp))
    for w, n in zip(words, times):
        lattice._long_counts(w, n, pieces, logp, counts)
    monkeypatch.setattr(lattice, "FAINT", faint)
    assert np.allclose(lattice.marginals(words, pieces, logp), want, rtol=1e-12)
    assert np.allclose(lattice.expected_counts(words, times, pieces, logp), counts, rtol=1e-9, atol=1e-12)


def test_words_too_improbable_for_a_double_keep_their_logarithms(pieces):
    words, logp = ["\U0001f600\U0001f9ff" * 22, "ກ" * 48], np.log(pieces.prior)
    got, counts = lattice.marginals(words, pieces, logp), np.zeros(len(logp))
    for w in words:
        lattice._long_counts(w, 2.0, pieces, logp, counts)
    assert min(got) < math.log(5e-324) and np.allclose(got, [lattice._long(w, pieces, logp) for w in words], rtol=1e-12)
    assert np.allclose(lattice.expected_counts(words, np.full(2, 2.0), pieces, logp), counts, rtol=1e-9, atol=1e-12)


def test_batches_are_joined_before_they_are_sorted_by_length(pieces, monkeypatch):
    sizes = []
    real = lattice.marginals
    monkeypatch.setattr(lattice, "marginals", lambda words, *a: sizes.append(len(words)) or real(words, *a))
    frames = [pd.DataFrame({"word": [f"w{k}", f"v{k}"], "c": [1, 2]}) for k in range(10)]
    made = pd.concat(lattice._word_scores(iter(frames), PATH, np.log(pieces.prior)))
    assert made["word"].tolist() == [w for f in frames for w in f["word"]] and made["c"].tolist() == [1, 2] * 10
    assert sizes == [20]
    monkeypatch.setattr(lattice, "GATHERED", 5)
    assert pd.concat(lattice._word_scores(iter(frames), PATH, np.log(pieces.prior)))["log10p"].tolist() == pytest.approx(made["log10p"].tolist())
    assert sizes[1:] == [6, 6, 6, 2] and not list(lattice._word_scores(iter([]), PATH, np.log(pieces.prior)))
