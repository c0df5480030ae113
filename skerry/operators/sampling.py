"""Samples that depend on keys and a seed only, not on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: Column, *prefix: str) -> Column:
    """SHA-256 of the seed and the key, as fixed-width hex: sorts like the number."""
    return F.sha2(F.concat(F.lit(":".join(prefix) + ":"), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, count: int, seed: int, excluded: DataFrame | None = None) -> DataFrame:
    rest = df if excluded is None else df.join(excluded.select(key).distinct(), key, "left_anti")
    return rest.orderBy(hash_rank(F.col(key), str(seed)), key).limit(count)


def preserved_sample(df: DataFrame, key: str, preserved: DataFrame, count: int, seed: int) -> DataFrame:
    """Eligible preserved rows first, then the smallest hash ranks, in a second hash order, with
    ``sample_slice`` and the split (60/20/20) that the order gives."""
    kept = preserved.select(key).distinct().withColumn("_kept", F.lit(True))
    marked = df.join(kept, key, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    rank = F.when(F.col("_kept"), hash_rank(F.col(key), str(seed), "preserved")).otherwise(hash_rank(F.col(key), str(seed)))
    taken = marked.orderBy(F.col("_kept").desc(), rank, key).limit(count)
    slice_ = F.when(F.col("_kept"), "preserved_eligible").otherwise("financial_filer_population")
    return split(taken.withColumn("sample_slice", slice_).drop("_kept"), key, count, seed)


def split(sample: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``evaluation_split`` by hash order: 60 % development, 20 % validation, the rest held out.

    The window sorts a sample, at most ``count`` rows."""
    at = F.row_number().over(Window.orderBy(hash_rank(F.col(key), str(seed), "order"), key)) - 1
    development, validation = round(count * 0.6), round(count * 0.2)
    name = F.when(F.col("_at") < development, "development").when(F.col("_at") < development + validation, "validation").otherwise("held_out")
    return sample.withColumn("_at", at).withColumn("evaluation_split", name).drop("_at")


def unique_host_sample(df: DataFrame, key: str, host: Column, count: int, seed: int, excluded_hosts: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each host in hash order, and of these the first ``count``."""
    ranked = df.withColumns({"_host": host, "_rank": hash_rank(F.col(key), str(seed))}).where((F.col("_host") != "") & ~F.col("_host").isin(*excluded_hosts, ""))
    first = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("_host").orderBy("_rank", key))).where("_k = 1")
    return first.orderBy("_rank", key).limit(count).drop("_host", "_rank", "_k")


def stratified_sample(df: DataFrame, key: str, stratum: Column, per_stratum: int, seed: int) -> DataFrame:
    """The smallest hash ranks of each stratum."""
    k = F.row_number().over(Window.partitionBy("_s").orderBy(hash_rank(F.col(key), str(seed)), key))
    return df.withColumn("_s", stratum).withColumn("_k", k).where(F.col("_k") <= per_stratum).drop("_s", "_k")
