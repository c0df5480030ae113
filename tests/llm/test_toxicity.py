"""The chain on small tables: learnt kinds, folds by text, and what the chain adds to independent models."""

import numpy as np
import public_tokenizers
import pytest

from skerry.llm import lattice, toxicity
from skerry.llm.linear import fit_logistic, sigmoid
from skerry.llm.queries import op1_toxicity


def test_a_later_model_gains_from_earlier_probabilities():
    """Toxic is rare words of one kind or the other but not both: no linear model of the words alone tells that."""
    rng = np.random.default_rng(1)
    x = (rng.random((4000, 2)) < 0.5).astype(np.float32)
    both = x[:, 0] * x[:, 1]
    seen = np.hstack([x, both[:, None]])
    y = np.stack([both, (x.sum(1) == 1).astype(float)], 1)
    fold = rng.integers(0, 3, 4000)
    chain = toxicity.chain_probabilities(seen, toxicity.train_chain(seen, y, fold))
    alone = fit_logistic(x, y[:, 1], toxicity.L2, toxicity.ROUNDS)
    assert ((chain[:, 1] >= 0.5) == y[:, 1]).mean() > 0.99 > 0.8 > ((sigmoid(x @ alone[:-1] + alone[-1]) >= 0.5) == y[:, 1]).mean()


def test_out_of_fold_probabilities_come_from_models_without_the_fold(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.random((90, 4)).astype(np.float32), (rng.random((90, 2)) < 0.5).astype(float)
    fold, fits = rng.integers(0, 3, 90), []
    monkeypatch.setattr(toxicity, "fit_logistic", lambda a, b, *r: fits.append((a.shape, len(b))) or np.zeros(a.shape[1] + 1))
    models = toxicity.train_chain(x, y, fold)
    assert [len(m) for m in models] == [5, 6]
    assert sorted(n for _, n in fits) == sorted([90, 90] + [int((fold != f).sum()) for f in range(3)])


def test_kinds_split_toxic_rows_by_their_features():
    x = np.zeros((50, 6), np.float32)
    x[:12, :3], x[12:20, 3:] = 1, 1
    toxic = np.arange(50) < 20
    kinds = toxicity.learnt_kinds(x, toxic)
    assert kinds[:12].tolist() == [[1, 0]] * 12 and kinds[12:20].tolist() == [[0, 1]] * 8 and not kinds[20:].any()
    assert toxicity.learnt_kinds(x, np.zeros(50, bool)).sum() == 0
    assert toxicity.learnt_kinds(np.ones((5, 2), np.float32), np.ones(5, bool)).sum(0).tolist() == [5, 0]


def test_registered_query_scores_every_row(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_toxicity(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.columns.tolist() == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "toxic"]
    assert ((got["p_toxic"] >= 0.5) == got["toxic"]).all() and got[["p_kind_1", "p_kind_2", "p_toxic"]].stack().between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id", suffixes=("_label", ""))
    assert labels[labels.toxic_label == 1].toxic.mean() > 0.8 and labels[labels.toxic_label == 0].toxic.mean() < 0.02


def test_copies_share_a_fold_and_rare_ids_do_not_fail(spark):
    rows = [(k, "you vile creature leave" if k % 4 == 0 else f"a calm text {k % 5}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert got == {k: k % 4 == 0 for k in range(80)}


def test_multi_label_chain(spark):
    rows = [(k, ("rude " if k % 2 else "") + ("threat " if k % 3 == 0 else "") + "words about something") for k in range(120)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(120)], "doc_id long, rude int, threat int")
    got = toxicity.classifier_chain(docs, labels, ("rude", "threat")).collect()
    assert len(got) == 121 and all((r["p_rude"] >= 0.5, r["p_threat"] >= 0.5) == (r["doc_id"] % 2 == 1, r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("word", ["a\U0010ffffb" * 20, "x▁y\U0010ffff" * 15])
def test_the_last_code_point_is_no_inner_mark(word, monkeypatch):
    pieces = lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    logp = np.log(pieces.prior)
    got = lattice.marginals([word], pieces, logp), lattice.expected_counts([word], np.ones(1), pieces, logp)
    monkeypatch.setattr(lattice, "LONGEST_ROW", 10**6)
    assert np.allclose(got[0], lattice.marginals([word], pieces, logp)) and np.allclose(got[1], lattice.expected_counts([word], np.ones(1), pieces, logp))
