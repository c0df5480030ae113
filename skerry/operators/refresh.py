"""What changed between two snapshots, and what carries over an inconclusive one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import urls

CONCLUSIVE = ("available", "not_available", "ambiguous")


def long_form(profiles: DataFrame, fields: list[str], key: str = "organisation_number") -> DataFrame:
    """``key, field, value``; arrays and structs as JSON with their nulls."""
    kind = dict(profiles.dtypes)
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"}) if kind[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return profiles.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields])).alias("x")).select(key, "x.*")


def changes(previous: DataFrame, current: DataFrame, fields: list[str], key: str = "organisation_number") -> DataFrame:
    """``key, field, old_value, new_value`` of all tracked fields that differ, by company and field; null equals null only.

    Both snapshots must hold the same companies: one that only one of them has raises when the result is read."""
    old = long_form(previous, fields, key).select(key, "field", F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    new = long_form(current, fields, key).select(key, "field", F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    both = old.join(new, [key, "field"], "full_outer")
    lone = F.col("_old").isNull() | F.col("_new").isNull()
    drift = F.when(lone, F.raise_error(F.concat(F.lit("snapshots hold different companies: "), F.col(key).cast("string"))).cast("boolean"))
    return both.where(F.coalesce(drift, ~F.col("old_value").eqNullSafe(F.col("new_value")))).select(key, "field", "old_value", "new_value").orderBy(key, "field")


def site_changes(previous: DataFrame, current: DataFrame, key: str = "organisation_number") -> DataFrame:
    """Changed official sites ``site_url, site_status``; only two conclusive checks are compared, and http,
    www and a slash at the end make no change."""
    old = previous.select(key, F.when(F.col("site_status") == "available", F.col("site_url")).alias("old_value"), F.col("site_status").alias("_old"))
    new = current.select(key, F.when(F.col("site_status") == "available", F.col("site_url")).alias("new_value"), F.col("site_status").alias("_new"))
    both = old.join(new, key).where(F.col("_old").isin(*CONCLUSIVE) & F.col("_new").isin(*CONCLUSIVE))
    return both.where(~urls.site_key(F.col("old_value")).eqNullSafe(urls.site_key(F.col("new_value")))).select(key, F.lit("website.official_url").alias("field"), "old_value", "new_value")


def membership_drift(previous: DataFrame, current: DataFrame, key: str = "organisation_number") -> DataFrame:
    """Companies of only one snapshot; a comparison needs none."""
    return previous.select(key, F.lit("previous").alias("side")).join(current, key, "left_anti").unionByName(current.select(key, F.lit("current").alias("side")).join(previous, key, "left_anti"))


def carried(previous: DataFrame, current: DataFrame, key: str = "organisation_number") -> DataFrame:
    """``current`` with ``site_status, site_url`` of the last conclusive check, and whether they are carried."""
    old = previous.select(key, F.col("site_status").alias("_status"), F.col("site_url").alias("_url"))
    keep = F.col("site_status").isin(*CONCLUSIVE)
    use_old = ~F.coalesce(keep, F.lit(False)) & F.col("_status").isin(*CONCLUSIVE)
    joined = current.join(old, key, "left").withColumn("carried", F.coalesce(use_old, F.lit(False)))
    return joined.withColumns({"site_status": F.when(F.col("carried"), F.col("_status")).otherwise(F.col("site_status")), "site_url": F.when(F.col("carried"), F.col("_url")).otherwise(F.col("site_url"))}).drop("_status", "_url")


def precision_recall(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``detected, expected, hits, precision, recall`` over distinct keys."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(1)), expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(F.count("_f").alias("detected"), F.count("_e").alias("expected"), F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("hits"))
    share = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.col("hits") / F.nullif(F.col(of), F.lit(0)))
    return n.withColumns({"precision": share("detected"), "recall": share("expected")})


def fingerprint(inputs: DataFrame, chunk: str, previous: DataFrame, run: dict[str, str], key: str = "organisation_number") -> DataFrame:
    """``chunk, fingerprint``: what decides the result of each chunk: its companies in order, their previous profiles (``body``
    texts), and the run's own settings."""
    joined = inputs.join(previous.select(key, F.col("body").alias("_body")), key, "left")
    each = F.struct("input_ordinal", F.col(key), F.sha2(F.coalesce("_body", F.lit("null")), 256))
    listed = joined.groupBy(chunk).agg(F.to_json(F.array_sort(F.collect_list(each))).alias("_rows"))
    settings = ", ".join(f"{k}={run[k]}" for k in sorted(run))
    return listed.select(chunk, F.sha2(F.concat(F.lit(settings + "|"), "_rows"), 256).alias("fingerprint"))


def chunk_problems(inputs: DataFrame, made: DataFrame, chunk: str, key: str = "organisation_number") -> DataFrame:
    """``chunk, wanted, made, missing, repeated, foreign`` of chunks whose results are not one for each of their companies."""
    n = made.groupBy(chunk, key).agg(F.count("*").alias("n"))
    both = inputs.select(chunk, key, F.lit(1).alias("_in")).join(n, [chunk, key], "full_outer")
    count = lambda flag: F.count_if(F.coalesce(flag, F.lit(False)))
    summed = both.groupBy(chunk).agg(
        count(F.col("_in").isNotNull()).alias("wanted"), F.coalesce(F.sum("n"), F.lit(0)).alias("made"), count(F.col("n").isNull()).alias("missing"), count(F.col("n") > 1).alias("repeated"), count(F.col("_in").isNull()).alias("foreign")
    )
    return summed.where("missing > 0 OR repeated > 0 OR foreign > 0")


def fallback(inputs: DataFrame, made: DataFrame, modules: list[str], note: str, key: str = "organisation_number") -> DataFrame:
    """``key, module, status, note`` for companies without a result: every module has failed, and why."""
    left = inputs.join(made.select(key).distinct(), key, "left_anti")
    return left.select(key, F.explode(F.array(*map(F.lit, modules))).alias("module"), F.lit("failed").alias("status"), F.lit(note).alias("note"))
