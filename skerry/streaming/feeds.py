"""The job feed and the change log as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.sources.sinks import upserted


def latest_states(stream: DataFrame, key: str, sequence: str) -> DataFrame:
    """The latest row of each key as a running aggregate, for complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(F.struct("*"), sequence).alias("r")).select("r.*")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Events without those whose keys came before within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, time: str, kind: str, width: str, delay: str) -> DataFrame:
    """Events by window and kind; what comes later than the delay is left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def upsert_stream(stream: DataFrame, keys: list[str], sequence: str, path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Keeps the newest row of each key in ``parts`` parts under ``path``, by a hash of the key; read it with ``upserted_rows``.

    A batch rewrites only the parts that it touches, as a new version of each, and drops the versions before
    the last one.  Versions bear the batch's number, so a batch that runs again writes the same ones."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int")
        fresh = upserted(batch.limit(0), batch, keys, sequence).withColumn("_part", part)
        touched = [r[0] for r in fresh.select("_part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        before = [v for p, v in _newest(spark, path, below=number).items() if p in touched]
        old = spark.read.schema(batch.schema).parquet(*before) if before else batch.limit(0)
        made = upserted(old, batch, keys, sequence).withColumn("_part", part).withColumn("_version", F.lit(number))
        made.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", "_version").parquet(path)
        for p in touched:
            _drop_before(spark, path, p, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(part, version, folder) of all versions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_part=*/_version=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    folders = [str(f.getPath()) for f in found]
    return [(int(f.split("_part=")[1].split("/")[0]), int(f.rsplit("=", 1)[1]), f) for f in folders]


def _newest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, str]:
    """The folder of each part's newest version, of those before ``below``."""
    return {p: f for p, _, f in sorted(x for x in _listed(spark, path) if below is None or x[1] < below)}


def _drop_before(spark: SparkSession, path: str, part: int, version: int) -> None:
    """Drops a part's versions but for ``version`` and the one before it, which readers may still hold."""
    old = sorted(v for p, v, _ in _listed(spark, path) if p == part and v < version)[:-1]
    for v in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={part}/_version={v}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upserted_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``upsert_stream`` keeps."""
    return spark.read.parquet(*_newest(spark, path).values())
