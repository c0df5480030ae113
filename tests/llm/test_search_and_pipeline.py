import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import multiprobe, pu_quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def brute(rows, every=100, k=10):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    wanted, got = brute(rows), multiprobe.nearest_neighbours(df).toPandas()
    vectors = dict(rows)
    hits = sum(len({i for _, i in near} & set(got[got.query_id == q].vec_id)) for q, near in wanted.items())
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    for r in got.itertuples():
        assert abs(r.score - np.sqrt(((np.array(vectors[r.query_id], float) - np.array(vectors[r.vec_id], float)) ** 2).sum())) < 1e-12
    for _, own in got.groupby("query_id"):
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and own.sort_values("rank")["score"].is_monotonic_increasing


def test_ties_copies_and_unsound_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8).tolist()
    rows = [(k, base) for k in range(0, 300)] + [(1000 + k, rng.normal(size=8).tolist()) for k in range(40)] + [(2000, rng.normal(size=3).tolist())]
    bad = [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [None] + [1.0] * 7), (None, base)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumns({"vec": F.lit(1), "key": F.lit("x"), "gid": F.lit(2)})
    got = multiprobe.nearest_neighbours(df).toPandas()
    wanted = brute(rows)
    for q in (0, 100, 200):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for _, i in wanted[q]]
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist()[:1] == [wanted[1000][0][1]]
    assert 2000 not in set(got.query_id) and not set(got.vec_id) & {5000, 5100, 5200, 5300}
    assert multiprobe.nearest_neighbours(df.limit(0)).collect() == []


def test_probes_begin_with_the_own_bucket_and_differ():
    h = multiprobe.Hashes(16, 1.0, 3, 6, 40)
    x = np.random.default_rng(2).normal(size=(5, 16))
    probed, own = h.probed(x), h.own(x)
    assert (probed[:, :, 0] == own).all() and all(len(set(p)) == 40 for q in probed for p in q.tolist())


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_against_their_rules(spark, pipeline):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "quality", "near copies", "packing"]
    kept = docs
    for (_, stage), rule in zip(pipeline.STAGES[:-1], (
        lambda d: toxicity.toxicity(d, labels).where("NOT toxic").select("doc_id"),
        lambda d: pu_quality.pu_quality(d, labels.where("quality = 1"), F.lit(True)).where("predicted = 1").select("doc_id"),
        lambda d: simhash.near_duplicate_groups(d, width=5, similarity=0.8).where("doc_id = component_id").select("doc_id"),
    )):
        made = stage(spark, kept, SF).cache()
        assert made.columns == docs.columns
        assert sorted(r[0] for r in made.select("doc_id").collect()) == sorted(r[0] for r in rule(kept).collect())
        assert 0 < made.count() < kept.count()
        kept = made
    pieces = pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    toxic = {r[0] for r in labels.where("toxic = 1").select("doc_id").collect()}
    good = {r[0] for r in labels.where("toxic = 0 AND quality = 1").select("doc_id").collect()}
    left = {r[0] for r in simhash.near_duplicate_groups(docs, width=5, similarity=0.8).where("doc_id = component_id").select("doc_id").collect()}
    final = {r[0] for r in kept.select("doc_id").collect()}
    assert len(final & toxic) <= 0.1 * len(toxic) and len((good & left) - final) <= 0.1 * len(good)
