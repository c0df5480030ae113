"""Runs by chunks that may break off at any time: one job for all chunks, checked, retried and taken up again.

A run keeps two things under its path.  ``parts`` holds what jobs wrote, by part
(one job's output) and chunk.  ``manifest`` holds a row for each chunk that was
accepted, appended once its part is complete: the run, the chunk's
fingerprint, the part, how many rows it has, a hash of their contents, and how
it came about.  What has no row was never made; what has a row is only
believed if fingerprint, rows and contents still agree.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skerry.operators import refresh

#: To be raised when stored results change their meaning.
VERSION = 1
MANIFEST = (
    "run_id string, chunk long, version int, fingerprint string, part string, schema string, rows long, content decimal(38,0), "
    "outcome string, attempts int, problem string, outage_waits int, completed_at timestamp"
)


@dataclass
class Run:
    """Outcome of a run: its rows in input order, the manifest rows that count, and how many chunks went which way."""

    rows: DataFrame
    manifest: DataFrame
    stats: dict[str, int] = field(default_factory=dict)


def divided(inputs: DataFrame, size: int) -> DataFrame:
    """``inputs`` with the ``chunk`` of each ``size`` consecutive input numbers."""
    if size < 1:
        raise ValueError(f"a chunk needs a size of at least 1, not {size}")
    return inputs.withColumn("chunk", F.floor(F.col("input_ordinal") / size).cast("long"))


def contents(made: DataFrame, *keys: str) -> DataFrame:
    """``keys, rows, content``: number of rows and the sum of their hashes, whatever their order."""
    columns = [F.col(f"`{c}`") for c in sorted(made.columns) if c not in keys]
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return made.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(digest).alias("content"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The newest manifest row of each chunk of a run."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    newest = Window.partitionBy("chunk").orderBy(F.desc("completed_at"), F.desc("part"))
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("run_id") == run_id).withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def _parts(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame | None:
    """The stored rows of the chunks that ``listed`` rows name, with ``part`` and ``chunk``; files that are lost or broken give none."""
    found = listed.select("part", "schema").distinct().collect()  # one row for each job of the run
    there = [f"{path}/parts/part={r['part']}" for r in found if _exists(spark, f"{path}/parts/part={r['part']}")]
    if not there:
        return None
    schema = StructType.fromJson(json.loads(found[0]["schema"])).add("part", "string").add("chunk", "long")
    options = {"basePath": f"{path}/parts", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    return spark.read.schema(schema).options(**options).parquet(*there).join(F.broadcast(listed.select("part", "chunk")), ["part", "chunk"], "left_semi")  # a row a chunk


def resumable(spark: SparkSession, path: str, run_id: str, prints: DataFrame) -> DataFrame:
    """Manifest rows of the chunks that need not be made again: of this version and fingerprint, no fallback, and
    stored just as they were accepted."""
    listed = manifest(spark, path, run_id).where((F.col("version") == VERSION) & (F.col("outcome") != "fallback")).join(prints, ["chunk", "fingerprint"], "left_semi")
    stored = _parts(spark, path, listed)
    if stored is None:
        return listed.limit(0)
    return listed.join(contents(stored, "part", "chunk"), ["part", "chunk", "rows", "content"], "left_semi")


def problems(inputs: DataFrame, made: DataFrame, check: Callable[[DataFrame], DataFrame] | None) -> dict[int, str]:
    """The first problem of each chunk that has one: results that are missing, repeated or foreign, or what ``check``
    (``chunk, problem``) says."""
    counts = refresh.chunk_problems(inputs, made, "chunk").select("chunk", F.format_string("%d missing, %d repeated, %d foreign results", "missing", "repeated", "foreign").alias("problem"))
    found = counts.unionByName(check(made).select("chunk", "problem")) if check else counts
    return {r["chunk"]: r["problem"] for r in found.groupBy("chunk").agg(F.min("problem").alias("problem")).collect()}  # a row a chunk


def run_chunks(
    inputs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, *, run_id: str, size: int, prints: DataFrame, fallback: Callable[[DataFrame, dict[int, str]], DataFrame],
    check: Callable[[DataFrame], DataFrame] | None = None, outage: Callable[[DataFrame], DataFrame] | None = None, wait: Callable[[int], bool] | None = None, retries: int = 1, waits: int = 4, most_share: float = 0.5,
) -> Run:
    """``work`` over all chunks of ``size`` inputs that the run at ``path`` does not hold yet, and all its results.

    ``inputs`` have ``input_ordinal, organisation_number``; ``work`` gets them with their ``chunk`` and gives one row for each,
    with these three.  ``prints`` are the chunks' fingerprints; who changes inputs, settings or run gets new ones.
    Missing chunks are one job.  If it fails, its chunks are halved until those that fail stand alone.  Chunks
    with problems are made again up to ``retries`` times; then ``fallback(inputs, problems)`` gives their rows, and the
    next run tries them anew.  ``outage(made)`` gives ``chunk, share``; where the share of companies that the source failed is
    over ``most_share``, ``wait(number)`` is asked whether it answers again, and the chunk is made once more, up to ``waits``
    times, without counting as a retry."""
    spark = inputs.sparkSession
    numbered = divided(inputs, size)
    kept = resumable(spark, path, run_id, prints)
    resumed = [r[0] for r in kept.select("chunk").collect()]
    print_of = {r["chunk"]: r["fingerprint"] for r in prints.select("chunk", "fingerprint").collect()}  # a row a chunk
    pending = sorted(set(print_of) - set(resumed))
    stats = {"total": len(print_of), "resumed": len(resumed), "passed": 0, "retried": 0, "fallback": 0, "outage_retries": 0}

    def of(chunks: list[int]) -> DataFrame:
        return numbered.join(F.broadcast(spark.createDataFrame([(c,) for c in chunks], "chunk long")), "chunk", "left_semi")

    def written(made: DataFrame) -> tuple[str, StructType]:
        part = f"p-{uuid.uuid4().hex}"
        made.repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/parts/part={part}")
        return part, made.drop("chunk").schema

    def attempted(chunks: list[int]) -> tuple[list[tuple[str, StructType, list[int]]], dict[int, str]]:
        try:
            return [(*written(work(of(chunks))), chunks)], {}
        except PySparkException as e:
            if len(chunks) == 1:
                return [], {chunks[0]: f"{type(e).__name__}: {str(e)[:200]}"}
        half = len(chunks) // 2
        (made, bad), (more, worse) = attempted(chunks[:half]), attempted(chunks[half:])
        return made + more, bad | worse

    def accepted(part: str, schema: StructType, chunks: dict[int, tuple[str, int, str | None, int]]) -> None:
        """Appends the manifest rows of some chunks of a part."""
        if not chunks:
            return
        told = spark.createDataFrame([(c, print_of[c], *how) for c, how in chunks.items()], "chunk long, fingerprint string, outcome string, attempts int, problem string, outage_waits int")
        stored = spark.read.schema(StructType([*schema.fields]).add("chunk", "long")).parquet(f"{path}/parts/part={part}")
        rows = contents(stored.withColumn("part", F.lit(part)), "part", "chunk").join(F.broadcast(told), "chunk")
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        full = rows.withColumns({"run_id": F.lit(run_id), "version": F.lit(VERSION), "schema": F.lit(schema.json()), "completed_at": now})
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        full.select(*names).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    attempts, waited = dict.fromkeys(pending, 0), dict.fromkeys(pending, 0)
    last: dict[int, str] = {}
    while pending:
        parts, failed = attempted(pending)
        attempts |= {c: attempts[c] + 1 for c in pending}
        again: list[int] = []
        for part, schema, chunks in parts:
            made = spark.read.schema(StructType([*schema.fields]).add("chunk", "long")).parquet(f"{path}/parts/part={part}")
            bad = problems(of(chunks), made, check)
            shares = outage(made).where(F.col("share") > most_share).select("chunk").collect() if outage else []
            out = {r[0] for r in shares if r[0] not in bad and waited[r[0]] < waits}
            if out and wait and wait(1 + max(waited[c] for c in out)):
                waited |= {c: waited[c] + 1 for c in out}
                attempts |= {c: attempts[c] - 1 for c in out}
                stats["outage_retries"] += len(out)
                again += sorted(out)
            else:
                out = set()
            good = {c: ("passed" if attempts[c] == 1 else "retried", attempts[c], None, waited[c]) for c in chunks if c not in bad and c not in out}
            accepted(part, schema, good)
            for how, *_ in good.values():
                stats[how] += 1
            failed |= bad
        last |= failed
        again += [c for c in failed if attempts[c] <= retries]
        spent = {c: last[c] for c in failed if attempts[c] > retries}
        if spent:
            part, schema = written(fallback(of(sorted(spent)), spent))
            accepted(part, schema, {c: ("fallback", attempts[c], problem, waited[c]) for c, problem in spent.items()})
            stats["fallback"] += len(spent)
        pending = sorted(again)
    listed = manifest(spark, path, run_id).join(prints, ["chunk", "fingerprint"], "left_semi")
    rows = _parts(spark, path, listed)
    return Run(rows.drop("part").orderBy("input_ordinal") if rows is not None else work(numbered).limit(0), listed, stats)


def operations(log: DataFrame, *keys: str, company: str = "organisation_number") -> DataFrame:
    """A summary of requests for each of ``keys`` (chunks, runs) that can be merged exactly: ``requests``, ``by_purpose`` and
    ``companies``, how many companies took how many requests."""
    total = log.groupBy(*keys).agg(F.sum("requests").alias("requests"))
    purpose = log.groupBy(*keys, "purpose").agg(F.sum("requests").alias("r")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("purpose", "r")))).alias("by_purpose"))
    each = log.groupBy(*keys, company).agg(F.sum("requests").alias("r")).groupBy(*keys, "r").agg(F.count("*").alias("n"))
    return total.join(purpose, list(keys)).join(each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("companies")), list(keys))


def merged_operations(summaries: DataFrame) -> DataFrame:
    """One row over summaries: ``requests, by_purpose, per_company_p50`` (at half the companies, rounded down) ``,
    per_company_max``; of none zero, empty, zero and zero.  Companies belong to one summary each."""
    total = summaries.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))
    purpose = summaries.select(F.explode("by_purpose").alias("purpose", "r")).groupBy("purpose").agg(F.sum("r").alias("r"))
    purpose = purpose.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("purpose", "r")))).alias("by_purpose"))
    counts = summaries.select(F.explode("companies").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n"))
    counts = counts.agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("c"), F.max("r").alias("most"), F.sum("n").alias("all"))  # a value for each count that occurs
    seen = F.aggregate(
        "c", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("at")),
        lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.coalesce(s["at"], F.when(s["upto"] + x["n"] > F.floor(F.col("all") / 2), x["r"])).alias("at")),
    )
    counts = counts.select(F.coalesce(seen["at"], F.lit(0)).alias("per_company_p50"), F.coalesce("most", F.lit(0)).alias("per_company_max"))
    return total.join(F.broadcast(purpose)).join(F.broadcast(counts))  # one row each


def run_report(run: Run, inputs: DataFrame, size: int) -> DataFrame:
    """One row about a run: its ``size``, chunks by how they came about, and the companies that fell back, in input order."""
    named = divided(inputs, size).join(F.broadcast(run.manifest.where("outcome = 'fallback'").select("chunk")), "chunk", "left_semi")
    fallen = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("input_ordinal", "organisation_number"))), lambda x: x["organisation_number"]).alias("fallback_organisations"))
    return fallen.select(F.lit(size).alias("size"), *[F.lit(n).alias(k) for k, n in run.stats.items()], "fallback_organisations")
