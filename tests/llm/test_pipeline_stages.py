"""Every stage of the pipeline on rows that real tables hold: nulls, empties, repeats, clashing columns, no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (10, WORDS), (11, WORDS), (11, WORDS), (11, "Another text of the same id that is like no other in this table."), (12, WORDS + " end"), (None, WORDS), (None, "Only a row without an id says this."),
        (13, None), (14, ""), (15, "  \n"), (16, "word " * 30_000), (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "node", "fp", "n", "keys", "row", "u", "own", "root", "key", "a", "b")}).cache()


@pytest.mark.parametrize("k", [0, 1, 2])
def test_filtering_stages_keep_columns_and_only_input_rows(spark, pipeline, odd, k):
    stage = pipeline.STAGES[k][1]
    made = stage(spark, odd, SF)
    assert made.columns == odd.columns and stage(spark, odd.limit(0), SF).collect() == []
    left, before = (Counter((r["doc_id"], r["text"]) for r in d.collect()) for d in (made, odd))
    assert not left - before
    if k < 2:  # judged by the text alone: repeated rows stay or go together
        assert all(left[key] in (0, n) for key, n in before.items())
        stays = {}
        for (_, t), n in before.items():
            stays.setdefault(t or "", set()).add(left[_, t] == n)
        assert all(len(v) == 1 for v in stays.values())


def test_one_row_of_each_group_stays(spark, pipeline, odd):
    left = sorted(((r["doc_id"] or -1), r["text"] or "") for r in pipeline.drop_near_copies(spark, odd, SF).collect())
    assert left == sorted([(10, WORDS), (11, "Another text of the same id that is like no other in this table."), (-1, "Only a row without an id says this."), (13, ""), (16, "word " * 30_000)])


def test_packing_of_odd_rows(spark, pipeline, odd):
    pieces = pipeline.pack(spark, odd, SF).collect()
    ends = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert ends == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert pipeline.pack(spark, odd.limit(0), SF).collect() == []


def test_run_equals_its_stages_one_by_one(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    got = {r["doc_id"] for r in pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in docs.select("doc_id").collect()} != set()
