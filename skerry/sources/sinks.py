"""Sinks: canonical JSON lines and keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.canonical import json_rows


def write_json_lines(df: DataFrame, path: str) -> None:
    """One canonical JSON object per row, nested values too, keys sorted and nulls kept."""
    df.select(json_rows(df).alias("value")).write.mode("overwrite").text(path)


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The newest row of each key of both tables; of several with one number, the one of the greatest content."""
    both = stored.unionByName(fresh)
    order = Window.partitionBy(*keys).orderBy(F.col(sequence).desc(), F.xxhash64(*both.columns).desc())
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def shared_only(counts: DataFrame, key: str) -> DataFrame:
    """Identifiers of more than one company, in order."""
    return counts.where("entities > 1").orderBy(key)
