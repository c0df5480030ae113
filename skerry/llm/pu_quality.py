"""Text quality learnt from trusted positives and unlabelled web text.

Shape features of a whole text are cut into bins at quantiles, and a linear
model over the bins minimises the non-negative unbiased risk of
positive-unlabelled learning (Kiryo et al., "Positive-unlabeled learning with
non-negative risk estimator", 2017) under a class prior estimated from the
same rows: the smallest ratio, over thresholds of a classifier of positives
against unlabelled texts, of the shares that lie above (Blanchard, Lee and
Scott, "Semi-supervised novelty detection", 2010).

Negative labels are never used.  Trusted positives are bounded to
``sample_rows``, a parameter; all unlabelled texts take part: their measures
are stored once, cut at quantiles of all of them, and every risk, gradient and
share is a sum over all of them.  The driver holds a vector of one weight for
each bin and the positives.  Scoring is a narrow pass.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import discard, slices, stored
from skerry.llm.linear import labelled_sample, sigmoid

SAMPLE_ROWS = 12_000
#: Shares of the unlabelled texts at which the measures are cut.
CUTS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995)
#: Shrinkage of the weights, over the number of positives: of the risk and of the classifiers that the prior is read from; rounds at most.
L2, PRIOR_L2, ROUNDS = 1.0, 30.0, 25
#: Positives that a threshold must keep for its ratio to count in the prior.
LEAST_KEPT = 0.3
#: Neighbouring thresholds whose ratios are averaged, of 60.
SMOOTH = 15
NAMES = (
    "symbol_words", "upper_words", "shout_words", "digit_words", "alpha", "symbols", "digits", "word_length", "sentence_ends", "distinct",
    "twin_words", "window_distinct", "worst_window", "duplicate_lines", "line_words", "worst_line_symbols", "worst_line_upper", "worst_line_distinct", "log_words",
)
MARKS = b"#*$%&|<>!=+_~^@{}[]\\"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
WINDOW = 50


def _held(b: bytes, of: bytes) -> int:
    return len(b) - len(b.translate(None, of))


def features(text: str) -> list[float]:
    """The measures ``NAMES`` of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in raw.split(b"\n") if x.split()]
    starts = [*range(0, n - WINDOW, WINDOW), max(0, n - WINDOW)]  # the last window ends with the text
    shares = [len(set(words[a : a + WINDOW])) / len(words[a : a + WINDOW]) for a in starts]
    worst_symbols = worst_upper = 0.0
    worst_distinct = 1.0
    for x in lines:
        size = len(x)
        if size >= 20:
            worst_symbols = max(worst_symbols, _held(x, MARKS) / size)
            worst_upper = max(worst_upper, _held(x, UPPER) / size)
            if size >= 60:
                own = x.split()
                worst_distinct = min(worst_distinct, len(set(own)) / len(own) * min(1.0, 0.35 + len(own) / 400) if len(own) > 30 else len(set(own)) / len(own))
    size = len(raw)
    symbols, upper, digits, lower = _held(raw, MARKS), _held(raw, UPPER), _held(raw, DIGITS), _held(raw, LOWER)
    text_line = b" ".join(words) + b" "
    return [
        sum(map(text_line.count, (b"# ", b"* ", b"$ ", b"% ", b"& ", b"| ", b"> "))) / n,
        upper / n,
        text_line.count(b"! ") / n,
        digits / n,
        lower / size,
        symbols / size,
        digits / size,
        size / n,
        sum(map(text_line.count, (b". ", b"? "))) / n,
        len(set(words)) / n**0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(shares) / len(shares),
        min(shares),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        worst_symbols,
        worst_upper,
        worst_distinct,
        float(np.log(n)),
    ]


def _featured(frames: Iterator[pd.DataFrame], keep: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        yield pd.DataFrame({k: frame[k].to_numpy() for k in keep} | {"x": [features(t) for t in frame["text"]]})


class Binned:
    """Bins of each measure between ``edges``; a value on an edge lies below it."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = [np.unique(np.asarray(e, float)) for e in edges]
        self.offsets = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        self.width = int(self.offsets[-1])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, measures) bin numbers, each counted within its measure."""
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def hot(self, codes: np.ndarray) -> np.ndarray:
        """0/1 columns for the bins, and a last one of ones."""
        out = np.zeros((len(codes), self.width + 1), np.float32)
        out[np.arange(len(codes))[:, None], codes + self.offsets[:-1]] = 1.0
        out[:, -1] = 1.0
        return out

    def scores(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights[:-1][codes + self.offsets[:-1]].sum(1) + weights[-1]


def _rows_of(frames: Iterator[pd.DataFrame], size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for f in frames:
        codes = np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), len(NAMES))
        for a in range(0, len(f), size):
            yield codes[a : a + size], f["fold"].to_numpy()[a : a + size]


def _coded(frames: Iterator[pd.DataFrame], bins: Binned) -> Iterator[pd.DataFrame]:
    for f in frames:
        codes = bins.codes(np.array(f["x"].tolist(), float).reshape(-1, len(NAMES)))
        yield pd.DataFrame({"fold": f["fold"], "codes": [c.tobytes() for c in codes]})


def _met(frames: Iterator[pd.DataFrame], bins: Binned) -> Iterator[pd.DataFrame]:
    total = np.zeros((bins.width + 1,) * 2)
    for codes, _ in _rows_of(frames):
        x = bins.hot(codes)
        total += x.T @ x
    at = np.flatnonzero(total)
    yield pd.DataFrame({"problem": 0, "at": at, "value": total.ravel()[at]})


def _sums(frames: Iterator[pd.DataFrame], bins: Binned, points: np.ndarray, folds: tuple) -> Iterator[pd.DataFrame]:
    """For each problem, over the rows outside its fold: softplus at each of its points, and the gradient at the first."""
    loss, grad = np.zeros(points.shape[:2]), np.zeros((len(points), bins.width + 1))
    for codes, fold in _rows_of(frames):
        x = bins.hot(codes)
        for k, (own, out) in enumerate(zip(points, folds)):
            on = x if out is None else x[fold != out]
            z = on @ own.T
            loss[k] += np.logaddexp(0, z).sum(0)
            grad[k] += sigmoid(z[:, 0]) @ on
    values = np.hstack([grad, loss])
    k, at = np.nonzero(values)
    yield pd.DataFrame({"problem": k, "at": at, "value": values[k, at]})


def _above(frames: Iterator[pd.DataFrame], bins: Binned, weights: list[np.ndarray], thresholds: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of each fold that lie at or above each threshold of the classifier that has not seen the fold."""
    found = np.zeros((len(weights), thresholds.shape[1] + 1))
    for codes, fold in _rows_of(frames):
        for h, w in enumerate(weights):
            z = np.sort(bins.scores(codes[fold == h], w))
            found[h] += np.r_[len(z) - np.searchsorted(z, thresholds[h], "left"), len(z)]
    k, at = np.nonzero(found)
    yield pd.DataFrame({"problem": k, "at": at, "value": found[k, at]})


class Unlabelled:
    """Sums over all unlabelled rows ``fold, codes``; a vector of the bins' width is all that comes back."""

    def __init__(self, table: DataFrame, bins: Binned):
        self.table, self.bins = table, bins
        self.counts = {h: n for h, n in table.groupBy("fold").count().collect()}
        self.rows = sum(self.counts.values())

    def _summed(self, work, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        for k, at, value in self.table.mapInPandas(work, "problem int, at int, value double").groupBy("problem", "at").agg(F.sum("value")).collect():
            out[k, at] = value
        return out

    def curvature(self) -> np.ndarray:
        """Mean product of the 0/1 columns."""
        n = self.bins.width + 1
        return self._summed(functools.partial(_met, bins=self.bins), (1, n * n)).reshape(n, n) / max(1, self.rows)

    def means(self, points: np.ndarray, folds: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Mean softplus at each point, and its gradient at the first, of each problem."""
        n = self.bins.width + 1
        out = self._summed(functools.partial(_sums, bins=self.bins, points=points, folds=folds), (len(points), n + points.shape[1]))
        rows = np.array([max(1, self.rows - self.counts.get(f, 0)) for f in folds], float)[:, None]
        return out[:, n:] / rows, out[:, :n] / rows

    def shares_above(self, weights: list[np.ndarray], thresholds: np.ndarray) -> np.ndarray:
        out = self._summed(functools.partial(_above, bins=self.bins, weights=weights, thresholds=thresholds), (len(weights), thresholds.shape[1] + 1))
        return out[:, :-1] / np.maximum(1, out[:, -1:])


def class_prior(scores_p: np.ndarray, scores_u: np.ndarray, least: float = LEAST_KEPT) -> float:
    """Share of positives among the unlabelled scores: see ``prior_of_shares``."""
    if not len(scores_p) or not len(scores_u):
        return 0.5
    t = np.quantile(scores_p, np.linspace(0, 1 - least, 60))
    return prior_of_shares(np.array([(scores_p >= x).mean() for x in t]), np.array([(scores_u >= x).mean() for x in t]), len(scores_p))


def prior_of_shares(p: np.ndarray, u: np.ndarray, rows_p: int) -> float:
    """The least ratio of the shares of unlabelled texts and of positives above a threshold, each averaged with its
    neighbours' (as the least of single noisy ratios lies too low) and less its error, as too high a prior would
    force negatives among the positives."""
    ratio = np.convolve(u / np.maximum(p, 1e-9), np.full(SMOOTH, 1 / SMOOTH), "valid")
    slack = np.sqrt((1 / np.clip(np.convolve(p, np.full(SMOOTH, 1 / SMOOTH), "valid"), 1e-9, 1) - 1) / rows_p)
    return float(np.clip(np.min(ratio * (1 - slack / 2), initial=1.0), 0.05, 0.98))


#: Steps that one pass looks at.
STEPS = np.array([1.0, 0.5, 0.2, 0.05])


def minimise(web: Unlabelled, terms: list, folds: tuple, curvature: np.ndarray, l2: float, rounds: int = ROUNDS, floor: bool = False) -> list[np.ndarray]:
    """Weights at the least mean softplus over the unlabelled rows plus ``terms`` of the positives, by BFGS.

    A term gives, for weights, its loss, its gradient, and the negatives' risk of these weights without the
    unlabelled part.  With ``floor`` a step that would take the estimated risk of negatives below zero is
    not taken.  All problems are solved side by side, with one pass over the rows a round; the first
    steps are scaled by ``curvature``, a bound of the second derivative."""
    n = web.bins.width + 1
    shrink = np.r_[np.full(n - 1, l2), 1e-9]
    inverse = [np.linalg.inv(0.25 * curvature + np.diag(shrink + 1e-6)) for _ in terms]
    w = [np.zeros(n) for _ in terms]

    def whole(k, at, loss_u):
        loss, _, without = terms[k](at)
        return loss_u + loss + 0.5 * (shrink * at * at).sum(), loss_u + without

    loss_u, grad_u = web.means(np.stack([x[None] for x in w]), folds)
    value = [whole(k, w[k], loss_u[k, 0])[0] for k in range(len(terms))]
    grad = [grad_u[k] + terms[k](w[k])[1] + shrink * w[k] for k in range(len(terms))]
    ended = [False] * len(terms)
    for _ in range(rounds):
        way = [-inverse[k] @ grad[k] for k in range(len(terms))]
        tried = np.stack([w[k] + STEPS[:, None] * way[k] for k in range(len(terms))])
        loss_u, grad_u = web.means(tried, folds)
        again = {}
        for k in range(len(terms)):
            if ended[k]:
                continue
            seen = [whole(k, x, u) for x, u in zip(tried[k], loss_u[k])]
            good = [j for j, (v, negative) in enumerate(seen) if v < value[k] - 1e-7 and (negative >= 0 or not floor)]
            if not good:
                ended[k] = True
                continue
            best = 0 if good[0] == 0 else min(good, key=lambda j: seen[j][0])
            again[k] = (best, seen[best][0])
        if not again:
            break
        if any(best for best, _ in again.values()):  # a shorter step: its gradient takes another pass
            picked = np.stack([tried[k, again.get(k, (0,))[0]][None] for k in range(len(terms))])
            _, grad_u = web.means(picked, folds)
        for k, (best, v) in again.items():
            at = tried[k, best]
            new = grad_u[k] + terms[k](at)[1] + shrink * at
            s, y = at - w[k], new - grad[k]
            if (r := s @ y) > 1e-12:
                turn = np.eye(n) - np.outer(s, y) / r
                inverse[k] = turn @ inverse[k] @ turn.T + np.outer(s, s) / r
            ended[k] = value[k] - v < 1e-6
            w[k], grad[k], value[k] = at, new, v
        if all(ended):
            break
    return w


def _apart(x: np.ndarray):
    """Loss of positives against unlabelled rows."""
    def term(w: np.ndarray):
        z = x @ w
        return float(np.logaddexp(0, -z).mean()), -(sigmoid(-z) @ x) / len(x), 0.0

    return term


def nnpu_term(x: np.ndarray, prior: float):
    """The positives' part of the unbiased risk under the logistic loss, in which softplus(-z) - softplus(z) is -z."""
    mean = x.mean(0)

    def term(w: np.ndarray):
        return -prior * float(mean @ w), -prior * mean, -prior * float(np.logaddexp(0, x @ w).mean())

    return term


def fit_quality(positives: np.ndarray, folds: np.ndarray, web: Unlabelled) -> tuple[np.ndarray, float]:
    """Weights and the estimated prior from measures of trusted positives and all unlabelled rows."""
    bins = web.bins
    if not len(positives) or not web.rows:
        return np.zeros(bins.width + 1), 0.5
    codes = bins.codes(positives)
    x = bins.hot(codes).astype(float)
    curvature = web.curvature()
    prior, usable = 0.5, [h for h in (0, 1) if (folds == h).any() and (folds != h).any() and 0 < web.counts.get(h, 0) < web.rows]
    if usable:
        w = minimise(web, [_apart(x[folds != h]) for h in usable], tuple(usable), curvature + x.T @ x / len(x), PRIOR_L2 / len(x), 12)
        scores = [bins.scores(codes[folds == h], v) for h, v in zip(usable, w)]
        thresholds = np.stack([np.quantile(z, np.linspace(0, 1 - LEAST_KEPT, 60)) for z in scores])
        weights = [w[usable.index(h)] if h in usable else np.zeros(bins.width + 1) for h in (0, 1)]
        above = web.shares_above(weights, np.stack([thresholds[usable.index(h)] if h in usable else thresholds[0] for h in (0, 1)]))
        prior = float(np.mean([prior_of_shares(np.array([(z >= t).mean() for t in ts]), above[h], len(z)) for h, z, ts in zip(usable, scores, thresholds)]))
    return minimise(web, [nnpu_term(x, prior)], (None,), curvature, L2 / len(x), ROUNDS, floor=True)[0], prior


def quality_column(
    df: DataFrame, positives: DataFrame, unlabelled: Column, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> Column:
    """The probability of good quality over the text column, from a model trained on ``df``.

    ``positives`` holds ids of trusted texts, of which ``sample_rows`` at most are used; all rows of ``df``
    where ``unlabelled`` is true are the web text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")  # copies of a text share a fold
    work, kind = functools.partial(_featured, keep=("fold",)), "fold int, x array<double>"
    trusted = labelled_sample(df, positives.select(id_col, F.lit(1).alias("good")), ["good"], sample_rows, id_col, text_col)
    seen = trusted.select("text", fold).mapInPandas(work, kind).collect()
    seen.sort()
    measured = stored(df.where(unlabelled).select(text.alias("text")).select("text", fold).mapInPandas(work, kind), "pu-measures")
    cuts = measured.agg(*[F.percentile_approx(F.col("x")[k], list(CUTS), 2000) for k in range(len(NAMES))]).first()
    bins = Binned([c or [] for c in cuts])
    coded = stored(measured.mapInPandas(functools.partial(_coded, bins=bins), "fold int, codes binary"), "pu-codes")
    discard(measured)
    weights, _ = fit_quality(np.array([r["x"] for r in seen], float).reshape(-1, len(NAMES)), np.array([r["fold"] for r in seen], int), Unlabelled(coded, bins))
    discard(coded)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch], float).reshape(-1, len(NAMES))
            yield pd.Series(sigmoid(bins.scores(bins.codes(x), weights)))

    return scored(F.col(f"`{text_col}`").cast("string"))


def pu_quality(df: DataFrame, positives: DataFrame, unlabelled: Column, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col, score, predicted`` for every row: the probability that a text is of good quality.

    A null text counts as empty and is scored like any other.  Without positives, or without unlabelled
    rows, every score is 0.5.  Repeated rows get equal scores and count as often as they stand among the
    unlabelled; other columns are ignored; an empty table gives an empty result.  At most ``sample_rows``
    trusted ids are learnt from, and every unlabelled row."""
    score = quality_column(df, positives, unlabelled, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    return df.select(F.col(f"`{id_col}`"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
