"""Positive-unlabelled risk, its gradient and its minimum against plain numpy, and the registered query."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import pu_quality as pu
from skerry.llm.queries import op9_pu_quality


@pytest.fixture(scope="module")
def web(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, len(pu.NAMES)))
    x[:400, 0] += 2.5
    bins = pu.Binned([np.quantile(x[:, k], (0.2, 0.5, 0.8)) for k in range(len(pu.NAMES))])
    codes, fold = bins.codes(x), rng.integers(0, 2, 700)
    table = spark.createDataFrame([(int(f), bytearray(c.tobytes())) for f, c in zip(fold, codes)], "fold int, codes binary").repartition(5).cache()
    positives = rng.normal(size=(200, len(pu.NAMES)))
    positives[:, 0] += 2.5
    return pu.Unlabelled(table, bins), codes, fold, positives


def test_sums_over_partitions_are_those_of_one_matrix(web):
    un, codes, fold, _ = web
    rng = np.random.default_rng(6)
    x = un.bins.hot(codes).astype(float)
    assert np.allclose(un.curvature(), x.T @ x / len(x))
    points = rng.normal(size=(2, 3, x.shape[1]))
    loss, grad = un.means(points, (None, 1))
    for k, on in enumerate((x, x[fold != 1])):
        z = on @ points[k].T
        assert np.allclose(loss[k], np.logaddexp(0, z).mean(0)) and np.allclose(grad[k], (1 / (1 + np.exp(-z[:, 0]))) @ on / len(on))
    w = rng.normal(size=x.shape[1])
    t = np.linspace(-1, 1, 4)
    for h in (0, 1):
        z = (x @ w)[fold == h]
        assert np.allclose(un.shares_above([w, w], np.stack([t, t]))[h], [(z >= a).mean() for a in t])


def test_the_minimum_of_the_unbiased_risk(web):
    """The risk's definition, pi E_p[l(z)] + E_u[l(-z)] - pi E_p[l(-z)], has no slope left where the search ends."""
    un, codes, _, positives = web
    xp, xu = un.bins.hot(un.bins.codes(positives)).astype(float), un.bins.hot(codes).astype(float)
    prior, l2 = 0.5, 0.01
    soft = lambda z: np.logaddexp(0, z)

    def risk(w):
        negatives = soft(xu @ w).mean() - prior * soft(xp @ w).mean()
        return prior * soft(-xp @ w).mean() + negatives + 0.5 * l2 * (w[:-1] ** 2).sum(), negatives

    w = pu.minimise(un, [pu.nnpu_term(xp, prior)], (None,), un.curvature(), l2, 60)[0]
    best, _ = risk(w)
    rng = np.random.default_rng(7)
    for scale in (0.3, 0.03):
        assert all(risk(w + scale * rng.normal(size=len(w)) / np.sqrt(len(w)))[0] > best - 1e-5 for _ in range(50))


def test_a_step_below_zero_risk_of_negatives_is_not_taken(web):
    un, codes, _, positives = web
    xp, xu = un.bins.hot(un.bins.codes(positives)).astype(float), un.bins.hot(codes).astype(float)
    w = pu.minimise(un, [pu.nnpu_term(xp, 0.95)], (None,), un.curvature(), 1e-5, 40, floor=True)[0]
    assert np.logaddexp(0, xu @ w).mean() - 0.95 * np.logaddexp(0, xp @ w).mean() >= -1e-9


def test_windows_reach_the_end_of_a_text():
    start = " ".join(f"w{k}" for k in range(70))
    clean, tail = pu.features(start), pu.features(start + " same" * 20)
    at = pu.NAMES.index("worst_window")
    assert clean[at] == 1.0 and tail[at] < 0.7


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in op9_pu_quality(spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(k, f"Line {k} is a full sentence about the town. It goes on for long." if k % 2 else "BUY NOW $$$ !!! *** " * 4) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = F.col("doc_id") % 3 != 1
    score = lambda ids: {r["doc_id"]: r["score"] for r in pu.pu_quality(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long").where(learnt), learnt).collect()}
    good = [k for k in range(120) if k % 2]
    assert score(good) == pytest.approx(score([k for k in good if k % 3 != 1]), abs=1e-6)
