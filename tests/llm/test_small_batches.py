import pytest

from skerry.llm import simhash

ARROW, READER = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@pytest.mark.parametrize("given, held", [(None, "1000"), ("0", "1000"), ("300", "300")])
def test_fingerprints_take_small_batches_and_leave_the_settings(spark, monkeypatch, given, held):
    seen, real = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: seen.update({name: (spark.conf.get(ARROW), spark.conf.get(READER))}) or real(df, name))
    before = spark.conf.get(ARROW, None), spark.conf.get(READER, None)
    try:
        if given is not None:
            spark.conf.set(ARROW, given)
        rows = [(k, f"one two three four five {k % 1200}") for k in range(2400)]
        got = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert seen["fingerprints"] == (held, "1000") and len(got) == 2400
        assert all(r["fingerprint"] == f"{simhash.fingerprint(rows[r['doc_id']][1]):016x}" for r in got)
        assert spark.conf.get(ARROW, None) == (given if given is not None else before[0]) and spark.conf.get(READER, None) == before[1]
    finally:
        spark.conf.unset(ARROW) if before[0] is None else spark.conf.set(ARROW, before[0])
