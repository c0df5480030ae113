"""Logistic regression over a bounded sample, for the classifiers trained here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights, the intercept last, by accelerated gradient steps; the intercept is not shrunk."""
    n, k = x.shape
    w, v = np.zeros(k + 1), np.zeros(k + 1)
    if not n:
        return w
    shrink = np.r_[np.full(k, l2), 0.0]
    u = np.ones(k)  # the largest curvature, by power iteration
    for _ in range(12):
        u = x.T @ (x @ u)
        norm = np.linalg.norm(u)
        if not norm:
            break
        u /= norm
    step = 1.0 / (0.25 * (np.linalg.norm(x @ u) ** 2 / n * 1.1 + 1.0) + l2)
    t = 1.0
    for _ in range(rounds):
        p = sigmoid(x @ v[:k] + v[k]) - y
        new = v - step * (np.r_[x.T @ p / n, p.mean()] + shrink * v)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def one_text_each(rows: DataFrame) -> DataFrame:
    """One row for each ``id``: of its several texts the one of the smallest hash.  Further columns depend on the id alone."""
    others = [c for c in rows.columns if c != "text"]
    return rows.groupBy(*others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled_sample(df: DataFrame, labels: DataFrame, columns: list[str], rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` (text), ``text`` and the label columns of at most ``rows`` labelled ids, chosen by a hash of the id,
    with one row each however many rows bear the id.

    Labels that are null or of null ids take no part; of an id's several labels the largest counts.  The
    label side is broadcast: it has ``rows`` rows at most."""
    known = labels.dropna(subset=[id_col, *columns])
    chosen = (
        known.groupBy(F.col(f"`{id_col}`").cast("string").alias("id"))
        .agg(*[F.max(F.col(c).cast("int")).alias(f"y_{c}") for c in columns])
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    text = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return one_text_each(text.join(F.broadcast(chosen), "id"))
