import glob
import os

import pytest
from pyspark.sql import functions as F

from skerry.operators import refresh
from skerry.sources import chunks

N, SIZE = 47, 5


@pytest.fixture
def job(spark, tmp_path):
    """A run over 47 companies in chunks of 5, whose work can be told to misbehave; it notes the chunks of each call."""

    class Job:
        inputs = spark.range(N).select(F.col("id").alias("input_ordinal"), F.format_string("9%08d", "id").alias("organisation_number"))
        path, seen = str(tmp_path / "run"), []

        def __init__(self):
            self.previous = spark.createDataFrame([("900000001", "{}")], "organisation_number string, body string")
            self.missing, self.broken, self.down = {}, {}, {}

        def work(self, rows):
            here = sorted(r[0] for r in rows.select("chunk").distinct().collect())
            self.seen.append(here)
            made = rows.withColumn("value", F.col("input_ordinal") * 2).withColumn("down", F.lit(False))
            for c in here:
                if self.broken.get(c, 0):
                    made = made.withColumn("value", F.when(F.col("chunk") == c, F.raise_error(F.lit(f"chunk {c} breaks")).cast("long")).otherwise(F.col("value")))
                    self.broken[c] -= len(here) == 1
                if self.missing.get(c, 0):
                    made = made.where((F.col("chunk") != c) | (F.col("input_ordinal") % 5 != 1))
                    self.missing[c] -= 1
                if self.down.get(c, 0):
                    made = made.withColumn("down", (F.col("chunk") == c) | F.col("down"))
                    self.down[c] -= 1
            return made

        def run(self, run_id="r1", **more):
            self.seen.clear()
            prints = refresh.fingerprint(chunks.divided(self.inputs, SIZE), "chunk", self.previous, {"run_id": run_id, "hosts": "4"})
            fallback = lambda rows, why: rows.withColumns({"value": F.lit(-1).cast("long"), "down": F.lit(False)})
            outage = lambda made: made.groupBy("chunk").agg(F.avg(F.col("down").cast("int")).alias("share"))
            check = lambda made: made.where("value > 10000").select("chunk", F.lit("too large").alias("problem"))
            return chunks.run_chunks(self.inputs, self.work, self.path, run_id=run_id, size=SIZE, prints=prints, fallback=fallback, check=check, outage=outage, wait=lambda k: k < 3, **more)

    return Job()


def values(run):
    return [(r["input_ordinal"], r["value"]) for r in run.rows.collect()]


WHOLE = [(k, 2 * k) for k in range(N)]
ALL = list(range(10))


def test_one_job_then_nothing_to_do(job):
    first = job.run()
    assert values(first) == WHOLE and job.seen == [ALL] and first.stats["passed"] == 10
    second = job.run()
    assert values(second) == WHOLE and job.seen == [] and second.stats == {"total": 10, "resumed": 10, "passed": 0, "retried": 0, "fallback": 0, "outage_retries": 0}


def test_bad_chunks_alone_are_retried_and_fall_back(job):
    job.missing = {3: 1, 7: 99}
    run = job.run()
    assert job.seen == [ALL, [3, 7]]
    assert values(run) == [(k, -1 if 35 <= k < 40 else 2 * k) for k in range(N)]
    assert {r["chunk"]: (r["outcome"], r["attempts"], r["problem"]) for r in run.manifest.where("chunk IN (2, 3, 7)").collect()} == {
        2: ("passed", 1, None), 3: ("retried", 2, None), 7: ("fallback", 2, "1 missing, 0 repeated, 0 foreign results"),
    }
    report = chunks.run_report(run, job.inputs, SIZE).first()
    assert report["fallback_organisations"] == [f"9{k:08d}" for k in range(35, 40)] and (report["passed"], report["retried"], report["fallback"]) == (8, 1, 1)
    job.missing = {}
    run = job.run()
    assert job.seen == [[7]] and values(run) == WHOLE  # a fallback is tried again


def test_a_chunk_that_breaks_the_job_stands_alone(job):
    job.broken = {4: 99}
    run = job.run(retries=0)
    assert [r["chunk"] for r in run.manifest.where("outcome = 'fallback'").collect()] == [4] and run.stats["passed"] == 9
    assert "chunk 4 breaks" in run.manifest.where("chunk = 4").first()["problem"] and len(job.seen) < 10
    job.broken = {}
    assert values(job.run()) == WHOLE and job.seen == [[4]]


@pytest.mark.parametrize("harm", ["truncate", "swap", "delete"])
def test_broken_changed_or_lost_chunks_alone_are_made_again(job, harm, spark):
    job.run()
    (file,) = glob.glob(f"{job.path}/parts/*/chunk=6/*.parquet")
    if harm == "truncate":
        with open(file, "r+b") as f:
            f.truncate(os.path.getsize(file) // 2)
    elif harm == "delete":
        os.remove(file)
    else:  # rows of the right companies with other values
        changed = spark.read.parquet(file).withColumn("value", F.col("value") + 1).coalesce(1)
        changed.write.parquet(f"{job.path}-other")
        os.replace(glob.glob(f"{job.path}-other/*.parquet")[0], file)
    for side in glob.glob(os.path.join(os.path.dirname(file), ".*.crc")):
        os.remove(side)
    run = job.run()
    assert job.seen == [[6]] and values(run) == WHOLE and run.stats["resumed"] == 9


def test_other_run_settings_or_previous_profiles(job, spark):
    job.run()
    job.previous = spark.createDataFrame([("900000001", "{}"), ("900000012", "{}")], "organisation_number string, body string")
    job.run()
    assert job.seen == [[2]]  # only the chunk whose company has another profile
    job.run("r2")
    assert job.seen == [ALL]  # results of one run are not taken for another's


def test_outage_is_waited_for_but_not_for_ever(job):
    job.down = {1: 1, 8: 99}
    run = job.run()
    assert job.seen == [ALL, [1, 8], [8]] and values(run) == WHOLE
    assert {r["chunk"]: (r["outcome"], r["outage_waits"]) for r in run.manifest.where("chunk IN (0, 1, 8)").collect()} == {0: ("passed", 0), 1: ("passed", 1), 8: ("passed", 2)}
    assert run.stats["outage_retries"] == 3


def test_size_and_empty_inputs(job, spark):
    with pytest.raises(ValueError):
        chunks.divided(job.inputs, 0)
    job.inputs = job.inputs.limit(0)
    run = job.run()
    assert run.rows.collect() == [] and run.stats["total"] == 0


def test_merged_operations_equal_one_report(spark):
    rows = [(k % 7, f"c{k}", "ab"[p], (k * 7 + p) % 5) for k in range(50) for p in range(2)]
    log = spark.createDataFrame(rows, "chunk long, organisation_number string, purpose string, requests long")
    got = chunks.merged_operations(chunks.operations(log, "chunk")).first()
    each = sorted(sum(r[3] for r in rows if r[1] == f"c{k}") for k in range(50))
    assert got["requests"] == sum(each) and (got["per_company_p50"], got["per_company_max"]) == (each[25], each[-1])
    assert got["by_purpose"] == {p: sum(r[3] for r in rows if r[2] == p) for p in "ab"}
    none = chunks.merged_operations(chunks.operations(log.limit(0), "chunk")).first()
    assert (none["requests"], none["by_purpose"], none["per_company_p50"], none["per_company_max"]) == (0, {}, 0, 0)
