import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100):
    sound = {}
    for i, x, y in rows:
        if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            v = [math.floor(256 * c) for c in x]
            if sum(c * c for c in v) < 2**62:
                sound[(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(v))] = None
    out = []
    for a in sound:
        if a[0] % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in sound if len(b[2]) == len(a[2]))
            for ps, p, _ in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:5]:
                near = [s for s in scored if s[2] != a[1] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
                out += [(a[0], p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(near)]
    return sorted(out)


def made(df, **how):
    got = hard_negatives.hard_negatives(df, **how)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, got.collect()))


def test_query_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op13_hard_negatives(spark, SF)
    wanted = brute(rows)
    assert wanted and sorted(map(tuple, got.collect())) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    answer = con.execute(queries.ORACLE_SQL["op13_hard_negatives"])
    at = [[c[0] for c in answer.description].index(c) for c in got.columns]
    assert sorted(tuple(r[k] for k in at) for r in answer.fetchall()) == wanted


def test_skewed_spectrum_many_blocks_copies_and_negative_scores(spark):
    rng = np.random.default_rng(0)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0] * np.geomspace(2, 0.01, 12)
    rows = [(k, (rng.normal(size=12) @ axes).tolist(), int(rng.integers(0, 3))) for k in range(700)]
    rows += [(1000 + k, rows[5][1], k % 2) for k in range(400)]  # a group of copies with two labels
    rows += [(2000 + k, [-1.0] + [0.0] * 11 if k else [1.0] + [0.0] * 11, 77) for k in range(4)]  # only opposite rows of its label
    rows += [(2100, [0.0] * 12, 78), (2101, [0.0] * 12, 78), (2102, [0.0] * 12, 79)]
    df = spark.createDataFrame(rows, KIND)
    assert made(df) == brute(rows)
    assert made(df, block_rows=50, sample_rows=3, every=10) == brute(rows, 10)
    assert made(df.where("vec_id < 700"), sample_rows=0) == brute(rows[:700])


def test_odd_rows_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(200)]
    rows += [(0, rows[0][1], 0), (100, rng.normal(size=4).tolist(), 1), (500, None, 1), (600, [1.0, None, 2.0, 3.0], 1), (700, [math.nan] * 4, 1), (800, [math.inf] * 4, 0)]
    rows += [(900, [1.0] * 4, None), (None, [1.0] * 4, 1), (300, [], 1), (301, [], 1), (302, [], 2), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [1.0, 1.9], 4), (1100, [1e300] * 4, 1), (1200, [1e8] * 4, 1)]
    df = spark.createDataFrame(rows, KIND).withColumns({"q": F.lit("x"), "vid": F.lit(1), "ids": F.lit(2), "slot": F.lit(3)})
    assert made(df) == brute(rows)
    assert made(df.limit(0)) == []
    assert made(df.where("vec_id = 0")) == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_early_steps_discard(seed):
    rng = np.random.default_rng(seed)
    vectors = np.floor(256 * rng.normal(size=(600, 32)) * np.geomspace(4, 0.01, 32)).astype(np.int64)
    axes = np.linalg.eigh(vectors.T.astype(float) @ vectors)[1][:, ::-1]
    x = hard_negatives.Rotated(vectors, axes, float(np.linalg.norm(axes @ axes.T - np.eye(32))))
    scores, seen = vectors[:40] @ vectors.T, []

    def wanted(low, high, may):
        if low.shape == scores.shape:
            seen.append(bool(((low <= scores) & (scores <= high)).all()))
        return hard_negatives.best(low, high, may, 6)

    a, b, exact, spent = hard_negatives.survivors(x, slice(0, 40), x, np.ones((40, 600), bool), wanted)
    assert seen and all(seen) and (exact == scores[a, b]).all()
    kth = np.sort(scores, 1)[:, -6]
    assert {(i, j) for i, j in zip(*np.nonzero(scores >= kth[:, None]))} <= set(zip(a.tolist(), b.tolist()))
    assert spent < 0.8 * 40 * 600 * 32 and len(a) < 40 * 12
