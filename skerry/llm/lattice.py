"""Document likelihood over all segmentations into vocabulary pieces.

The vocabulary exists already (a public SentencePiece model); a piece's score
there gives its prior weight, and expected counts over the corpus' training
words, by expectation-maximisation, its probability.  A text's probability is
the sum over all ways to write it as pieces, by forward recursion in log
space, times the probability of its end.

Pieces hold the word mark only in front, so a text's lattice falls apart at
its words and its log probability is the sum over its words.  The recursion
therefore runs once for each distinct word of the corpus, in matrices of words
of equal length, on probabilities, and on their logarithms for words too
improbable for that; texts are joined to their words' results: each slice of
an input partition sends its distinct words with counts, not its tokens, and
gets their results back beside its texts, as numbers.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import id_and_text, slices, stored, with_id

MARK, LONGEST_PIECE, LONGEST_ROW = "▁", 16, 48
#: Stands for a mark inside a word, as no text holds a lone surrogate.
INNER = "\ud800"
#: Words of one matrix, words sorted into matrices at once, characters of one slice of texts, rounds of expectation-maximisation.
ROWS, GATHERED, SLICE, ROUNDS = 8_000, 100_000, 16_000_000, 2
#: Words under this probability are summed in log space, as their terms could vanish.
FAINT = 1e-200
#: Expected counts that the prior adds, in all.
PRIOR_COUNT = 10_000.0
BASE, LOG10 = np.uint64(0x9E3779B97F4A7C15), np.log(10.0)


class Pieces:
    """Vocabulary pieces by the hash of their characters; bytes spell characters that are no piece."""

    def __init__(self, names: list[str], scores: list[float]):
        kept = [(n, s) for n, s in zip(names, scores) if n.rfind(MARK) < 1 and len(n) <= LONGEST_PIECE and not (n[0] == "<" and n[-1] == ">" and len(n) > 2)]
        self.names = [n for n, _ in kept]
        # scores that are not log probabilities but ranks (merges in order) become weights by Zipf's law
        rank = np.argsort(np.argsort([-s for _, s in kept], kind="stable"), kind="stable")
        weights = np.r_[1.0 / (rank + 3.0), np.full(257, 1e-4)]  # then the bytes and the end
        self.prior = weights / weights.sum()
        self.first_byte, self.end = len(self.names), len(self.names) + 256
        self.single = {n: k for k, n in enumerate(self.names) if len(n) == 1}
        self.by_name = {n: k for k, n in enumerate(self.names)}
        # beginnings that are no piece themselves have numbers from ``open`` on, so that a search knows where to stop
        self.open = len(self.names)
        begun = sorted({n[:j] for n in self.names for j in range(1, len(n))} - self.by_name.keys())
        keys = np.array([self._hash(n) for n in self.names + begun], np.uint64)
        self.bits = 18
        slots = np.full(1 << self.bits, -1, np.int32)
        self.steps = 1
        for k, h in enumerate(keys.tolist()):
            at, step = h >> (64 - self.bits), 1
            while slots[at] >= 0:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            slots[at] = k
            self.steps = max(self.steps, step)
        self.slots, self.keys = slots, keys

    @staticmethod
    def _hash(name: str) -> int:
        h = 0
        for c in name:
            h = ((h + ord(c) + 1) * int(BASE)) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, from ``open`` on where pieces only begin so, -1 where none does."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        for _ in range(self.steps):
            k = self.slots[at[open_]]
            hit = (k >= 0) & (self.keys[k] == h[open_])
            out[open_[hit]] = k[hit]
            open_ = open_[(k >= 0) & ~hit]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of words of one length: start, end, the rows that have an arc there, its piece, and (for
        characters that are no piece) 1 where bytes spell it."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        inner = codes[:, 1:] == ord(MARK)
        codes[:, 1:][inner] = 0x110000  # a mark inside a word is not the word mark
        with np.errstate(over="ignore"):
            for a in range(n):
                h, rows = np.zeros(len(words), np.uint64), np.arange(len(words))
                for b in range(a, min(n, a + LONGEST_PIECE)):
                    h = (h + codes[rows, b] + np.uint64(1)) * BASE
                    k = self.find(h)
                    whole = (k >= 0) & (k < self.open)
                    if whole.any():
                        yield a, b + 1, rows[whole], k[whole], None
                    if b == a and not whole.all():
                        yield a, b + 1, rows[~whole], None, codes[~whole, a]
                    h, rows = h[k >= 0], rows[k >= 0]
                    if not len(rows):
                        break

    def byte_numbers(self, code: int) -> list[int]:
        return [self.first_byte + b for b in (MARK if code == 0x110000 else chr(code)).encode("utf-8", "replace")]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for a in range(0, len(part), ROWS):
            yield part[a : a + ROWS]


def _spelled(pieces: Pieces, logp: np.ndarray, codes: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(codes, return_inverse=True)
    return np.array([logp[pieces.byte_numbers(int(c))].sum() for c in distinct])[at]


def _weighted(batch: list[str], pieces: Pieces, logp: np.ndarray) -> Iterator[tuple]:
    """Arcs with their log probabilities."""
    for a, b, r, k, codes in pieces.arcs(batch):
        yield a, b, r, k, codes, logp[k] if k is not None else _spelled(pieces, logp, codes)


def marginals(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word, over all its segmentations."""
    out, p = np.zeros(len(words)), np.exp(logp)
    for rows in _by_length(words) if words else ():
        batch = [words[k] for k in rows]
        if len(batch[0]) > LONGEST_ROW:
            out[rows] = [_long(w, pieces, logp) for w in batch]
            continue
        fwd = np.zeros((len(batch[0]) + 2, len(batch)))
        fwd[0] = 1.0
        for a, b, r, k, codes in pieces.arcs(batch):
            fwd[b, r] += fwd[a, r] * (p[k] if k is not None else np.exp(_spelled(pieces, logp, codes)))
        faint = fwd[-1] < FAINT
        out[rows[~faint]] = np.log(fwd[-1, ~faint])
        if faint.any():
            out[rows[faint]] = _faint_marginals([words[k] for k in rows[faint]], pieces, logp)
    return out


def _faint_marginals(batch: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """The same for words of one length, in log space."""
    fwd = np.full((len(batch), len(batch[0]) + 2), -np.inf)
    fwd[:, 0] = 0.0
    for a, b, r, _, _, lp in _weighted(batch, pieces, logp):
        fwd[r, b] = np.logaddexp(fwd[r, b], fwd[r, a] + lp)
    return fwd[:, -1]


def _long_arcs(text: str, b: int, pieces: Pieces, logp: np.ndarray) -> list[tuple[int, list[int], float]]:
    """Of one long word with its mark: start, pieces and log probability of each arc that ends at ``b``."""
    found = [(a, [k], float(logp[k])) for a in range(max(0, b - LONGEST_PIECE), b) if (k := pieces.by_name.get(text[a:b])) is not None]
    c = text[b - 1]
    if c not in pieces.single:
        spelled = pieces.byte_numbers(0x110000 if c == INNER else ord(c))
        found.append((b - 1, spelled, float(logp[spelled].sum())))
    return found


def _long_forward(text: str, pieces: Pieces, logp: np.ndarray) -> list[float]:
    fwd = [0.0]
    for b in range(1, len(text) + 1):
        terms = [fwd[a] + lp for a, _, lp in _long_arcs(text, b, pieces, logp)]
        top = max(terms)
        fwd.append(top + float(np.log(np.exp(np.array(terms) - top).sum())))
    return fwd


def _long(word: str, pieces: Pieces, logp: np.ndarray) -> float:
    """The same forward recursion for one long word, character by character."""
    return _long_forward(MARK + word.replace(MARK, INNER), pieces, logp)[-1]


def _long_counts(word: str, times: float, pieces: Pieces, logp: np.ndarray, total: np.ndarray) -> None:
    """Adds one long word's expected uses to ``total``; arcs are found again for the way back, not kept."""
    text = MARK + word.replace(MARK, INNER)
    fwd = _long_forward(text, pieces, logp)
    bwd = [-np.inf] * len(text) + [0.0]
    for b in range(len(text), 0, -1):
        for a, used, lp in _long_arcs(text, b, pieces, logp):
            after = lp + bwd[b]
            low, high = min(bwd[a], after), max(bwd[a], after)
            bwd[a] = high + math.log1p(math.exp(low - high))
            share = times * math.exp(fwd[a] + after - fwd[-1])
            for k in used:
                total[k] += share


def expected_counts(words: list[str], times: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the words' segmentations, by forward-backward."""
    total = np.zeros(len(logp))
    for rows in _by_length(words) if words else ():
        batch, n = [words[k] for k in rows], len(words[rows[0]]) + 1
        if n - 1 > LONGEST_ROW:
            for k in rows:
                _long_counts(words[k], float(times[k]), pieces, logp, total)
            continue
        arcs = [(a, b, r, k, codes, np.exp(lp)) for a, b, r, k, codes, lp in _weighted(batch, pieces, logp)]
        fwd, bwd = np.zeros((n + 1, len(batch))), np.zeros((n + 1, len(batch)))
        fwd[0] = 1.0
        for a, b, r, _, _, p in arcs:
            fwd[b, r] += fwd[a, r] * p
        faint = fwd[n] < FAINT
        bwd[n, ~faint] = times[rows[~faint]] / fwd[n, ~faint]  # each way's share of its word, times the word's count
        used, shares = [], []
        for a, b, r, k, codes, p in reversed(arcs):
            after = p * bwd[b, r]
            bwd[a, r] += after
            if k is not None:
                used.append(k)
                shares.append(fwd[a, r] * after)
            else:
                _add_spelled(total, pieces, codes, fwd[a, r] * after)
        if used:
            total += np.bincount(np.concatenate(used), np.concatenate(shares), len(total))
        if faint.any():
            _faint_counts([words[k] for k in rows[faint]], times[rows[faint]], pieces, logp, total)
    return total


def _add_spelled(total: np.ndarray, pieces: Pieces, codes: np.ndarray, share: np.ndarray) -> None:
    distinct, at = np.unique(codes, return_inverse=True)
    for c, s in zip(distinct, np.bincount(at, share)):
        np.add.at(total, pieces.byte_numbers(int(c)), s)


def _faint_counts(batch: list[str], times: np.ndarray, pieces: Pieces, logp: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses over words of one length to ``total``, in log space."""
    n, arcs = len(batch[0]) + 1, list(_weighted(batch, pieces, logp))
    fwd, bwd = np.full((len(batch), n + 1), -np.inf), np.full((len(batch), n + 1), -np.inf)
    fwd[:, 0] = bwd[:, n] = 0.0
    for a, b, r, _, _, lp in arcs:
        fwd[r, b] = np.logaddexp(fwd[r, b], fwd[r, a] + lp)
    for a, b, r, k, codes, lp in reversed(arcs):
        share = times[r] * np.exp(fwd[r, a] + lp + bwd[r, b] - fwd[r, n])
        bwd[r, a] = np.logaddexp(bwd[r, a], bwd[r, b] + lp)
        if k is not None:
            total += np.bincount(k, share, len(total))
        else:
            _add_spelled(total, pieces, codes, share)


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return Pieces([model.id_to_piece(k) for k in numbers], [model.get_score(k) for k in numbers])


def _lowered(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()  # bytes: lower-cases A-Z only


def _sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as numbers of their slice's distinct words, and these words, in one table."""
    for frame in slices(frames, limit=SLICE):
        part = uuid.uuid4().hex[:16]
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids, counts, raw, train, held = [], [], [], [], []
        for doc, text in zip(frame["id"], frame["text"]):
            learn = zlib.crc32(str("" if doc is None else doc).encode()) % 10 != 0
            found = np.fromiter(map(number.__getitem__, _lowered(text)), np.int32)
            ids.append(doc)
            counts.append(len(found))
            raw.append(found)
            held.append(not learn)
            train.append(learn)
        n = len(number)
        learnt = np.bincount(np.concatenate([np.zeros(0, np.int32), *itertools.compress(raw, train)]), minlength=n)
        yield pd.DataFrame({"kind": 0, "part": part, "id": ids, "held_out": held, "n": counts, "word": None, "codes": [zlib.compress(x.tobytes(), 1) for x in raw]})
        if n:
            yield pd.DataFrame({"kind": 1, "part": part, "id": None, "held_out": False, "n": learnt, "word": [w.decode("utf-8") for w in number], "codes": [k.to_bytes(4, "little") for k in range(n)]})


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins Spark's batches up to GATHERED words or SLICE characters, as words of one length are few in each."""
    held, rows, size = [], 0, 0
    for f in frames:
        held.append(f)
        rows, size = rows + len(f), size + int(f["word"].str.len().sum())
        if rows >= GATHERED or size >= SLICE:
            yield pd.concat(held, ignore_index=True)
            held, rows, size = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _expected(frames: Iterator[pd.DataFrame], path: str, logp: np.ndarray) -> Iterator[pd.DataFrame]:
    pieces, total = load_pieces(path), np.zeros(len(logp))
    for f in _gathered(frames):
        total += expected_counts(f["word"].tolist(), f["c"].to_numpy(float), pieces, logp)
    used = np.flatnonzero(total)
    yield pd.DataFrame({"piece": used, "expected": total[used]})


def _word_scores(frames: Iterator[pd.DataFrame], path: str, logp: np.ndarray) -> Iterator[pd.DataFrame]:
    pieces = load_pieces(path)
    for f in _gathered(frames):
        f["log10p"] = marginals(f["word"].tolist(), pieces, logp) / LOG10
        yield f


def piece_probabilities(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of all pieces after expectation-maximisation over ``counts(word, c)``; a vector
    as long as the vocabulary is all that the driver sees."""
    pieces = load_pieces(path)
    p = pieces.prior
    for _ in range(rounds):
        found = counts.mapInPandas(functools.partial(_expected, path=path, logp=np.log(p)), "piece int, expected double").groupBy("piece").agg(F.sum("expected")).collect()
        new = PRIOR_COUNT * pieces.prior
        for k, n in sorted(found):
            new[k] += n
        new[pieces.end] += ends
        p = new / new.sum()
    return np.log(p)


def lattice_scores(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Words of a whole text (A-Z lower-cased) and one end are its tokens; rows whose crc32(id) mod 10 is not
    0 are learnt from.  A null text counts as empty and has only its end.  A null id counts as the empty
    string.  Repeated rows are separate texts with equal scores; other columns are ignored; an empty table
    gives an empty result.  Words of over LONGEST_ROW characters go through the recursion one by one, with
    equal results; a frequent word makes one row for each slice of SLICE characters.
    """
    sliced = stored(
        id_and_text(df, id_col, text_col).mapInPandas(_sliced, "kind int, part string, id string, held_out boolean, n long, word string, codes binary"), "lm-slices"
    )
    texts = sliced.where("kind = 0").select("part", "id", "held_out", "n", "codes")
    words = sliced.where("kind = 1").select("part", "codes", "word", "n")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    tokens, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.where("NOT held_out").count()
    total, kinds = tokens + ends, distinct + (ends > 0)
    logp = piece_probabilities(counts.where("c > 0"), ends, vocabulary, rounds)
    scored = counts.mapInPandas(functools.partial(_word_scores, path=vocabulary, logp=logp), "word string, c long, log10p double")
    found = words.select("part", "codes", "word").join(scored, "word").select(F.col("part").alias("slice"), F.col("codes").alias("code"), "c", "log10p")
    end_weight = np.log10((ends + 0.1) / (total + 0.1 * (kinds + 1)))
    work = functools.partial(_summed, total=total, kinds=kinds, end_base=float(end_weight), end_known=ends > 0, end_score=float(logp[-1] / LOG10))
    made = texts.groupBy("part").cogroup(found.groupBy("slice")).applyInPandas(
        work, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return with_id(made, df, id_col)


def _summed(texts: pd.DataFrame, words: pd.DataFrame, total: int, kinds: int, end_base: float, end_known: bool, end_score: float) -> pd.DataFrame:
    """One slice: its texts, of SLICE characters or one text, and its distinct words."""
    at = np.frombuffer(b"".join(words["code"]), "<u4").astype(np.int64) if len(words) else np.zeros(0, np.int64)
    base, score, known = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), np.int64)
    c = words["c"].to_numpy(float)
    base[at], score[at], known[at] = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))), words["log10p"].to_numpy(float), c > 0
    rows = []
    for doc, held, n, codes in zip(texts["id"], texts["held_out"], texts["n"], texts["codes"]):
        k = np.frombuffer(zlib.decompress(codes), np.int32)
        rows.append((doc, held, n + 1, int(known[k].sum()) + end_known, total, float(base[k].sum()) + end_base, float(score[k].sum()) + end_score))
    return pd.DataFrame(rows, columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
