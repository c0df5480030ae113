"""Toxicity by a classifier chain.

Each category has a linear model over the presence of words and word
beginnings in the whole text.  Categories come in a fixed order, and a later
model also sees the probabilities of the earlier ones; while training, these
are predicted out of fold, so that the later models learn from probabilities
as good as those that they will see.  Folds are dealt by a hash of the text,
so that copies of a text share one.

Where labels mark only ``toxic``, the earlier categories are learnt: the texts
marked so are split into kinds by two-means over the features that tell toxic
texts from others.

Trained on at most ``sample_rows`` labelled texts and ``features`` features,
both parameters; scoring is a narrow pass over all texts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import discard, slices, stored
from skerry.llm.linear import fit_logistic, labelled_sample, sigmoid

SAMPLE_ROWS, FEATURES, FOLDS, LEAST_TEXTS = 12_000, 256, 3, 3
#: Shrinkage and gradient steps of each linear model.
L2, ROUNDS = 1e-5, 400
BEGINNINGS, THRESHOLD = (3, 4, 5, 6), 0.5
#: What the chain over labels of ``toxic`` alone predicts, in order: the kinds, the larger first, and toxic.
CATEGORIES = ("kind_1", "kind_2", "toxic")
#: Entries of a task's word and count tables before they are emptied.
TABLE_LIMIT = 400_000
EDGES = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))


def word_features(word: str) -> list[str]:
    """The word without ASCII marks at its ends, and its beginnings."""
    word = word.strip(EDGES)
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)] if word else []


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def _counted(frames: Iterator[pd.DataFrame], categories: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Texts with each feature, in all and by category, summed as far as a task's table reaches."""
    tables = [Counter() for _ in range(len(categories) + 1)]

    def out() -> pd.DataFrame:
        keys = list(tables[0])
        made = pd.DataFrame({"feature": keys} | {f"n{i}": [t[k] for k in keys] for i, t in enumerate(tables)})
        for t in tables:
            t.clear()
        return made

    for frame in slices(frames):
        for text, *marks in zip(frame["text"], *[frame[f"y_{c}"] for c in categories]):
            found = {f for w in words_of(text) for f in word_features(w)}
            for table, on in zip(tables, (1, *marks)):
                if on:
                    table.update(found)
            if len(tables[0]) > TABLE_LIMIT:
                yield out()
    if tables[0]:  # an empty partition gives nothing, not an untyped frame
        yield out()


class Presence:
    """Numbers of the known features in a text, by a bounded table of words."""

    def __init__(self, features: list[str]):
        self.number = {f: k for k, f in enumerate(features)}
        self.table: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        if len(self.table) > TABLE_LIMIT:
            self.table.clear()
        found: set[int] = set()
        for w in words_of(text):
            known = self.table.get(w)
            if known is None:
                known = self.table[w] = tuple(self.number[f] for f in word_features(w) if f in self.number)
            found.update(known)
        return sorted(found)


def _presence(frames: Iterator[pd.DataFrame], features: list[str], categories: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    presence = Presence(features)
    for frame in slices(frames):
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "fold": frame["fold"].to_numpy(), "on": [presence(t) for t in frame["text"]]} | {c: frame[f"y_{c}"].to_numpy() for c in categories})


def matrix(on: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(on), width), np.float32)
    for r, k in enumerate(on):
        x[r, k] = 1.0
    return x


def learnt_kinds(x: np.ndarray, toxic: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two 0/1 columns that split the toxic rows by two-means, the larger kind first.

    The means begin at the halves of the rows along their widest direction; rows of equal distance go to
    the first.  Without two different rows all are of the first kind."""
    own = np.flatnonzero(toxic)
    z = x[own].astype(float)
    out = np.zeros((len(x), 2), np.float32)
    if not len(own):
        return out
    middle = z - z.mean(0)
    way = middle[np.argmax((middle**2).sum(1))]
    for _ in range(rounds):
        way = middle.T @ (middle @ way)
        way /= np.linalg.norm(way) or 1.0
    second = middle @ way > 0
    for _ in range(rounds):
        if second.all() or not second.any():
            break
        a, b = z[~second].mean(0), z[second].mean(0)
        new = ((z - b) ** 2).sum(1) < ((z - a) ** 2).sum(1)
        if (new == second).all():
            break
        second = new
    if 2 * second.sum() > len(own):
        second = ~second
    out[own, second.astype(int)] = 1.0
    return out


def train_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector for each column of ``y``; model k takes ``x`` and k earlier probabilities, those of a row
    from a model that has not seen the row's fold."""
    models, earlier = [], np.zeros((len(x), 0), np.float32)
    for k in range(y.shape[1]):
        seen = np.hstack([x, earlier]).astype(np.float32)
        models.append(fit_logistic(seen, y[:, k], L2, ROUNDS))
        outside = np.zeros(len(x), np.float32)
        for f in range(folds if k + 1 < y.shape[1] else 0):
            w = fit_logistic(seen[fold != f], y[fold != f, k], L2, ROUNDS)
            outside[fold == f] = sigmoid(seen[fold == f] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, outside[:, None]])
    return models


def chain_probabilities(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    p = np.zeros((len(x), 0))
    for w in models:
        p = np.hstack([p, sigmoid(np.hstack([x, p]) @ w[:-1] + w[-1])[:, None]])
    return p


def chain_column(text: Column, names: list[str], models: list[np.ndarray], categories: tuple[str, ...]) -> Column:
    """The chain's probabilities of a text column, as one struct."""

    @F.pandas_udf(", ".join(f"p_{c} double" for c in categories))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        presence = Presence(names)
        for batch in batches:
            p = chain_probabilities(matrix([presence(t or "") for t in batch], len(names)), models)
            yield pd.DataFrame(p, columns=[f"p_{c}" for c in categories])

    return scored(text.cast("string"))


def fit_chain(sample: DataFrame, categories: tuple[str, ...], features: int = FEATURES, kinds: bool = False) -> tuple[list[str], list[np.ndarray]]:
    """Feature names and models from the labelled texts ``id, text, y_<category>``, a bounded sample; with ``kinds``
    the chain begins with two learnt kinds of the first category."""
    counts = ", ".join(f"n{i} long" for i in range(len(categories) + 1))
    tally = sample.mapInPandas(functools.partial(_counted, categories=categories), f"feature string, {counts}").groupBy("feature").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(categories) + 1)])
    totals = sample.agg(F.count("*"), *[F.sum(f"y_{c}") for c in categories]).first()
    rows, of = totals[0], [int(t or 0) for t in totals[1:]]

    def association(i: int):
        """Squared correlation of feature and category, but for the category's own spread."""
        expected = F.col("n0") * F.lit(of[i] / rows)
        return (F.col(f"n{i + 1}") - expected) ** 2 / (F.col("n0") * (1 - F.col("n0") / F.lit(rows + 1.0)) * F.lit(of[i] * (rows - of[i]) / rows**2))

    useful = [association(i) for i in range(len(categories)) if 0 < of[i] < rows]
    names: list[str] = []
    if useful:
        best = tally.where(F.col("n0") >= LEAST_TEXTS).orderBy(F.greatest(*useful, F.lit(0.0)).desc(), "feature").limit(features)
        names = [r[0] for r in best.select("feature").collect()]
    held = sample.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    schema = f"id string, fold int, on array<int>, {', '.join(f'{c} int' for c in categories)}"
    seen = held.mapInPandas(functools.partial(_presence, features=names, categories=categories), schema).collect()
    seen.sort(key=lambda r: (r["id"], r["on"]))
    x, y = matrix([r["on"] for r in seen], len(names)), np.array([[r[c] for c in categories] for r in seen], np.float32).reshape(-1, len(categories))
    if kinds:
        y = np.hstack([learnt_kinds(x, y[:, 0]), y])
    return names, train_chain(x, y, np.array([r["fold"] for r in seen], int))


def classifier_chain(
    df: DataFrame, labels: DataFrame, categories: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES
) -> DataFrame:
    """``id_col`` and ``p_<category>`` for every row, in the order of ``categories``, columns of ``labels``.

    A null text counts as empty and gets the chain's probabilities of no features.  Without labelled texts
    every probability is 0.5.  Repeated rows get equal probabilities; other columns are ignored; an empty
    table gives an empty result.
    """
    sample = stored(labelled_sample(df, labels, list(categories), sample_rows, id_col, text_col), "chain-sample")
    names, models = fit_chain(sample, categories, features)
    discard(sample)
    return df.select(F.col(f"`{id_col}`"), chain_column(F.col(f"`{text_col}`"), names, models, categories).alias("p")).select(id_col, "p.*")


def toxicity_column(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Column:
    """A struct of ``p_kind_1, p_kind_2, p_toxic`` over the text column, from a chain trained on ``df``.

    ``labels`` marks only ``toxic``; the kinds are learnt from the texts marked so."""
    sample = stored(labelled_sample(df, labels, ["toxic"], sample_rows, id_col, text_col), "toxic-sample")
    names, models = fit_chain(sample, ("toxic",), kinds=True)
    discard(sample)
    return chain_column(F.col(f"`{text_col}`"), names, models, CATEGORIES)


def toxicity(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col, p_kind_1, p_kind_2, p_toxic, toxic`` for every row; toxic means p_toxic >= threshold.

    Nulls, repeated rows and empty tables are treated as in ``classifier_chain``."""
    p = toxicity_column(df, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    return df.select(F.col(f"`{id_col}`"), p.alias("p")).select(id_col, "p.*", (F.col("p.p_toxic") >= threshold).alias("toxic"))
