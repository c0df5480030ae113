"""The chain's likelihood by enumeration, and values for odd texts."""

import itertools

import numpy as np

from skerry.llm import line_crf
from skerry.llm.queries import op2_line_crf


def likelihood(model, texts, marks, begins, l2):
    """Mean log probability of the marks by line, over all state paths, less the shrinkage."""
    total = 0.0
    for x, y, first in zip(texts, marks, begins):
        s = model.scores(x)
        value = lambda path: first * model.first[path[0]] + sum(s[t, p] for t, p in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        total += value(list(y)) - np.logaddexp.reduce([value(p) for p in itertools.product((0, 1), repeat=len(x))])
    shrunk = sum((p**2).sum() for p in (model.emit, model.step, model.first))
    return total / sum(map(len, texts)) - l2 / 2 * shrunk


def test_the_fit_ends_where_the_likelihood_has_no_slope():
    rng = np.random.default_rng(3)
    widths = [len(e) + 1 for e in line_crf.EDGES.values()]
    texts = [np.stack([rng.integers(0, w, n) + o for w, o in zip(widths, line_crf.OFFSETS)], 1) for n in rng.integers(2, 7, 14)]
    marks = [(x[:, 0] - line_crf.OFFSETS[0] > 2).astype(int) for x in texts]
    begins = np.array([1] * 10 + [0] * 4)
    model, l2 = line_crf.LineCrf(), 0.05
    model.fit(texts, marks, begins, rounds=1500, l2=l2, rate=0.05)
    best = likelihood(model, texts, marks, begins, l2)
    for part in (model.emit, model.step, model.first):
        for at in itertools.islice(np.ndindex(part.shape), 0, None, 3):
            old, slopes = part[at], []
            for h in (1e-3, -1e-3):
                part[at] = old + h
                slopes.append(likelihood(model, texts, marks, begins, l2))
            part[at] = old
            assert abs(slopes[0] - slopes[1]) / 2e-3 < 2e-3 and max(slopes) < best + 1e-5


def test_values_of_odd_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (3, " \n \t"), (4, "word " * 60), (5, "\n".join(" ".join(f"{w}{k}" for w in "abcdefgh") for k in range(12))), (6, "x" * 20_000), (6, "x" * 20_000)]
    got = {(r["doc_id"], r["n_words"]): r for r in line_crf.content_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    for k in ((1, 0), (2, 0), (3, 0)):
        assert got[k]["base_failed"] and not got[k]["kept"] and got[k]["content_share"] == 0
    assert got[4, 60]["base_failed"] and got[4, 60]["n_repeat_words"] == 60  # one window over and over
    assert not got[5, 96]["base_failed"] and got[5, 96]["kept"] and got[5, 96]["content_share"] == 1.0  # without labels all is content
    assert got[6, 1]["word_chars"] == 20_000 and got[6, 1]["base_failed"]


def test_registered_query_counts_and_keeps(spark):
    sf = "/root/testdata/sf0.001"
    got = op2_line_crf(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (failed == got.base_failed).all() and not got[got.base_failed].kept.any() and got.kept.any()
