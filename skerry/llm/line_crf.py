"""Content share of a text by a linear-chain conditional random field over its lines.

Each line with a word has a row of binned shape features.  A two-state chain
(boilerplate, content) is trained here by maximum likelihood and decoded by
Viterbi; the share of words in content lines decides whether a text stays.

No table marks lines, so training lines get their marks from text labels: all
lines of a good text are content; a line of a bad text is boilerplate where a
linear model of lines of bad against good texts holds it for one.  At most
``sample_rows`` labelled texts are used, a parameter, each of them whole: the
chain is fitted on consecutive chunks of ``CHUNK_LINES`` lines of it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import id_and_text, slices, with_id
from skerry.llm.linear import fit_logistic, labelled_sample, sigmoid

SAMPLE_ROWS, CHUNK_LINES, LEAST_CONTENT = 4_000, 60, 0.6
SYMBOLS = "#*$%&|<>"
MARKS, UPPER, DIGITS, LOWER = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", bytes(range(97, 123))
#: Upper edges of the bins of each line feature.
EDGES = {
    "marks": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4),
    "upper": (0.02, 0.06, 0.12, 0.3, 0.6),
    "digits": (0.0, 0.05, 0.15, 0.4),
    "lower": (0.1, 0.3, 0.5, 0.65, 0.8),
    "distinct": (0.1, 0.2, 0.3, 0.5, 0.7, 0.85),
    "twins": (0.0, 0.05, 0.2, 0.5),
    "shouts": (0.0, 0.1, 0.5),
    "words": (1, 3, 8, 20, 60, 150),
    "word_length": (3, 4.5, 6, 8, 12),
    "repeated": (0, 1),
    "ending": (0,),
}
OFFSETS = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
WIDTH = int(OFFSETS[-1])


def line_measures(text: str) -> tuple[list[list[float]], list[int]]:
    """The measures of ``EDGES`` and the words of each line that has a word."""
    made, counts, seen = [], [], set()
    for x in text.encode("utf-8", "replace").split(b"\n"):
        words = x.split()
        n = len(words)
        if not n:
            continue
        size = len(x)
        held = lambda of: (size - len(x.translate(None, of))) / size  # noqa: E731, B023
        made.append([
            held(MARKS), held(UPPER), held(DIGITS), held(LOWER),
            sum(len(set(words[a : a + 60])) for a in range(0, n, 60)) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, x.count(b"!") / n, n, size / n, x in seen, x.rstrip()[-1:] in b".?",
        ])
        counts.append(n)
        seen.add(x)
    return made, counts


def bins(measures: list[list[float]]) -> np.ndarray:
    """Feature numbers (one for each measure) of every line."""
    x = np.array(measures, float).reshape(-1, len(EDGES))
    return np.stack([np.searchsorted(e, x[:, k], "left") + OFFSETS[k] for k, e in enumerate(EDGES.values())], 1)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "replace").split()
    n = len(raw)
    joined = b"".join(raw)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))
    word_chars = len(joined) - chars  # continuation bytes begin no code point
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in raw), np.int64, n)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(triples, kind="stable")
        same = triples[order][1:] == triples[order][:-1]
        twice = np.zeros(len(triples), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        held = np.zeros(n, bool)
        held[:-2] |= twice
        held[1:-1] |= twice
        held[2:] |= twice
        repeated = int(held.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated


class LineCrf:
    """Two-state chain: 0 boilerplate, 1 content."""

    def __init__(self) -> None:
        self.emit = np.zeros((WIDTH, 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, lines: np.ndarray) -> np.ndarray:
        return self.emit[lines].sum(1)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best states of one text's lines; content where both are equally good."""
        if not len(scores):
            return []
        (bb, bc), (cb, cc) = self.step.tolist()
        rows = scores.tolist()
        b, c = self.first[0] + rows[0][0], self.first[1] + rows[0][1]
        back = []
        for eb, ec in rows[1:]:
            from_b, from_c = c + cb < b + bb, c + cc < b + bc  # whether the step to b, to c, comes from b
            back.append((0 if from_b else 1, 0 if from_c else 1))
            b, c = (b + bb if from_b else c + cb) + eb, (b + bc if from_c else c + cc) + ec
        state = 1 if c >= b else 0
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1]

    def fit(self, texts: list[np.ndarray], marks: list[np.ndarray], begins: np.ndarray, rounds: int = 120, l2: float = 1e-3, rate: float = 0.1) -> None:
        """Maximum likelihood by Adam; texts are padded to one matrix and summed over by forward-backward.

        ``begins`` is 1 for a text or its first chunk; a later chunk's first line is none of the text."""
        begin = np.asarray(begins, float)[:, None]
        longest = max(map(len, texts))
        lines = np.zeros((len(texts), longest, len(EDGES)), np.int64)
        gold = np.zeros((len(texts), longest), np.int64)
        there = np.zeros((len(texts), longest))
        for k, (x, y) in enumerate(zip(texts, marks)):
            lines[k, : len(x)], gold[k, : len(y)], there[k, : len(x)] = x, y, 1
        real = np.flatnonzero(there.ravel())
        flat = lines.reshape(-1, len(EDGES))[real]
        both = there[:, 1:]
        hot = np.eye(2)[gold]
        size = len(real)
        gold_step = np.einsum("ktb,ktc,kt->bc", hot[:, :-1], hot[:, 1:], both)
        state = [np.zeros_like(p) for p in (self.emit, self.step, self.first) for _ in (0, 1)]
        for turn in range(1, rounds + 1):
            e = self.emit[lines].sum(2) * there[:, :, None]
            fwd = np.zeros_like(e)
            fwd[:, 0] = begin * self.first + e[:, 0]
            for t in range(1, longest):
                new = np.logaddexp(fwd[:, t - 1, :1] + self.step[0], fwd[:, t - 1, 1:] + self.step[1]) + e[:, t]
                fwd[:, t] = np.where(there[:, t, None] > 0, new, fwd[:, t - 1])
            bwd = np.zeros_like(e)
            for t in range(longest - 2, -1, -1):
                after = e[:, t + 1] + bwd[:, t + 1]
                new = np.logaddexp(self.step[:, 0] + after[:, :1], self.step[:, 1] + after[:, 1:])
                bwd[:, t] = np.where(there[:, t + 1, None] > 0, new, 0)
            total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + bwd - total[:, None, None]) * there[:, :, None]
            pair = np.exp(fwd[:, :-1, :, None] + self.step + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
            miss = (p - hot * there[:, :, None]).reshape(-1, 2)[real]
            g_emit = np.stack([np.bincount(flat.ravel(), np.repeat(miss[:, s], len(EDGES)), WIDTH) for s in (0, 1)], 1)
            grads = (g_emit / size + l2 * self.emit, (pair.sum((0, 1)) - gold_step) / size + l2 * self.step, (begin * (p[:, 0] - hot[:, 0])).sum(0) / size + l2 * self.first)
            for k, (par, g) in enumerate(zip((self.emit, self.step, self.first), grads)):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                par -= rate * (1 - turn / (rounds + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)


def train(texts: list[np.ndarray], good: np.ndarray) -> LineCrf:
    """Chain from the line features of labelled texts and their labels."""
    model = LineCrf()
    good = np.asarray(good)
    used = [k for k, t in enumerate(texts) if len(t)]
    texts, good = [texts[k] for k in used], good[used]
    if not len(texts) or good.min() == good.max():
        model.first[1] = 1.0  # nothing to tell apart: all is content
        return model
    lines = np.concatenate(texts)
    owner = np.repeat(good, [len(t) for t in texts])
    x = np.zeros((len(lines), WIDTH), np.float32)
    x[np.arange(len(lines))[:, None], lines] = 1
    # lines of bad texts count as much as those of good ones, by repeating the fewer
    rare = 0 if (owner == 0).sum() < (owner == 1).sum() else 1
    times = max(1, int((owner != rare).sum() // max(1, (owner == rare).sum())))
    rows = np.r_[np.flatnonzero(owner != rare), np.tile(np.flatnonzero(owner == rare), min(times, 8))]
    w = fit_logistic(x[rows], owner[rows].astype(float), rounds=150)
    clean = sigmoid(x @ w[:-1] + w[-1]) >= 0.5
    marks = np.where(owner == 1, 1, clean)
    chunked = lambda xs: [x[a : a + CHUNK_LINES] for x in xs for a in range(0, len(x), CHUNK_LINES)]
    begins = np.array([a == 0 for t in texts for a in range(0, len(t), CHUNK_LINES)])
    model.fit(chunked(texts), chunked(np.split(marks, np.cumsum([len(t) for t in texts])[:-1])), begins)
    return model


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        found = [bins(line_measures(t)[0]).ravel().tolist() for t in frame["text"]]
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "good": frame["y_quality"].to_numpy(), "lines": found})


def _decoded(frames: Iterator[pd.DataFrame], model: LineCrf, least: float) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        rows = []
        for text in frame["text"]:
            base = base_counts(text)
            measures, words = line_measures(text)
            path = model.viterbi(model.scores(bins(measures)))
            content = sum(w for w, s in zip(words, path) if s)
            share = content / base[0] if base[0] else 0.0
            failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
            rows.append((*base, failed, not failed and share >= least, share, len(path), sum(path)))
        made = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_content_lines"])
        made.insert(0, "id", frame["id"].to_numpy())
        yield made


def _marked(frames: Iterator[pd.DataFrame], model: LineCrf) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        lines, contents = [], []
        for text in frame["text"]:
            path = iter(model.viterbi(model.scores(bins(line_measures(text)[0]))))
            whole = text.split("\n")
            stay = [x for x in whole if x.strip(" \t\x0b\x0c\r") and next(path)]
            lines.append("\n".join(stay))
            contents.append(len(stay))
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "content": lines, "n_content_lines": contents})


def fit_lines(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> LineCrf:
    """The chain, from at most ``sample_rows`` labelled texts (``labels.quality``: 1 good)."""
    sample = labelled_sample(df, labels, ["quality"], sample_rows, id_col, text_col)
    seen = sorted(sample.mapInPandas(_sampled, "id string, good int, lines array<int>").collect(), key=lambda r: (r["id"], r["lines"]))
    return train([np.array(r["lines"], np.int64).reshape(-1, len(EDGES)) for r in seen], np.array([r["good"] for r in seen]))


def content_text(df: DataFrame, model: LineCrf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, content, n_content_lines``: only the lines that the chain marks as content."""
    return with_id(id_and_text(df, id_col, text_col).mapInPandas(functools.partial(_marked, model=model), "id string, content string, n_content_lines int"), df, id_col)


def content_rules(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_content: float = LEAST_CONTENT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, the chain's content share and the verdict for every row.

    A text is kept if the base rules pass and at least ``least_content`` of its words stand in content
    lines.  A null or empty text has no words, a share of 0 and fails.  Without labels of both kinds every
    line is content.  Repeated rows get equal results; other columns are ignored; an empty table gives an
    empty result."""
    model = fit_lines(df, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    made = id_and_text(df, id_col, text_col).mapInPandas(
        functools.partial(_decoded, model=model, least=least_content),
        "id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long",
    )
    return with_id(made, df, id_col)
