"""Claims with citations: registry and financial claims, validation and run checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import canonical
from skerry.operators import registry

CONTRACT_STATES = ("available", "not_available", "blocked", "not_applicable", "ambiguous", "failed")
# Fixed values of the contract: its states and the measures of filings.
#: Shares of failed companies above which a module is warned of (fixed values).
FAIL_RATE_WARN = {"registry": 0.01, "financials": 0.02, "roles": 0.02, "locations": 0.02, "financial_history": 0.05, "website": 0.05, "jobs": 0.10, "news_mentions": 0.05}


def _unpivoted(rows: DataFrame, key: str, fields: dict[str, Column], *more: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])).alias("c")
    return rows.select(key, *more, each).select(key, *more, "c.field", "c.value")


def registry_claims(rows: DataFrame, fields: dict[str, Column], key: str = "organisation_number") -> DataFrame:
    """One claim per company and field, with the id of its citation; an empty value is not available, never zero.

    ``rows`` need ``source_url, source_class, retrieved_at, content_sha256``."""
    source = ("source_url", "source_class", "retrieved_at", "content_sha256")
    each = _unpivoted(rows, key, {n: F.nullif(F.trim(c.cast("string")), F.lit("")) for n, c in fields.items()}, *source)
    span = F.concat("field", F.lit(": "), F.coalesce("value", F.lit("(empty)")))
    cited = each.withColumn("evidence_id", canonical.evidence_id(*map(F.col, source), span))
    return cited.select(key, "field", "value", F.when(F.col("value").isNull(), "not_available").otherwise("available").alias("availability"), "evidence_id")


def claim_problems(claims: DataFrame, evidence: DataFrame, key: str = "organisation_number") -> DataFrame:
    """``key, problem`` of claims ``field, value, availability, evidence_id, period_end`` and their evidence
    ``evidence_id, source_url, retrieved_at``."""
    known = evidence.select(key, "evidence_id", F.lit(True).alias("_known")).distinct()
    checked = claims.join(known, [key, "evidence_id"], "left")
    available = F.col("availability") == "available"
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("availability"), F.lit("")).isin(*CONTRACT_STATES), "invalid state"),
            F.when(F.col("evidence_id").isNotNull() & F.col("_known").isNull(), "dangling evidence id"),
            F.when(available & F.col("value").isNull(), "available claim without a value"),
            F.when(available & F.col("evidence_id").isNull(), "available claim without evidence"),
            F.when(available & F.col("field").startswith("financials.") & (F.col("field") != "financials.filed_years") & F.col("period_end").isNull(), "financial claim without reporting period"),
            F.when(~available & F.col("value").isNotNull(), "unavailable claim carries a value"),
        )
    )
    of_claims = checked.select(key, F.explode(problems).alias("p"), "field").select(key, F.concat("field", F.lit(": "), "p").alias("problem"))
    bare = evidence.where(F.coalesce(F.col("source_url"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("retrieved_at"), F.lit("")).eqNullSafe(""))
    return of_claims.unionByName(bare.select(key, F.concat("evidence_id", F.lit(": evidence without source_url or retrieved_at")).alias("problem")))


def order_problems(inputs: DataFrame, made: DataFrame, key: str = "organisation_number") -> DataFrame:
    """Inputs without exactly one envelope, and envelopes of no input."""
    count = made.groupBy(key).agg(F.count("*").alias("n"))
    return inputs.select(key, F.lit(1).alias("asked")).join(count, key, "full_outer").where(F.col("asked").isNull() | F.coalesce("n", F.lit(0)).__ne__(1)).select(key, F.coalesce("n", F.lit(0)).alias("envelopes"))


def module_matrix(modules: DataFrame) -> DataFrame:
    """Companies by module and contract state."""
    state = registry.availability(F.col("status"))
    return modules.groupBy("module").agg(*[F.count_if(state == s).alias(s) for s in CONTRACT_STATES])


def failure_reasons(records: DataFrame, top: int = 3, key: str = "organisation_number") -> DataFrame:
    """The most frequent reasons of each module's failures, its failures over all companies and whether that is too high."""
    companies = records.agg(F.count_distinct(key).alias("_companies"))
    failed = records.where(F.col("status").isin("failed", "source_error"))
    by = failed.groupBy("module", F.substring(F.coalesce(F.nullif("note", F.lit("")), F.col("status")), 1, 70).alias("reason")).agg(F.count("*").alias("n"))
    rate = F.sum("n").over(Window.partitionBy("module")) / F.greatest(F.col("_companies"), F.lit(1))
    limit = F.coalesce(*[F.when(F.col("module") == m, F.lit(v)) for m, v in FAIL_RATE_WARN.items()], F.lit(1.0))
    ranked = by.crossJoin(F.broadcast(companies)).withColumns({"rate": F.round(rate, 4), "rank": F.row_number().over(Window.partitionBy("module").orderBy(F.col("n").desc(), "reason"))})
    return ranked.where(F.col("rank") <= top).withColumn("warn", F.col("rate") > limit).drop("_companies")  # one row was crossed


def terminal_status(status: Column, note: Column) -> Column:
    """State of a module in the older batch contract; without a record, or for a status that it does not know, the submission is at fault."""
    return (
        F.when(status == "available", "complete").when(status.isin("not_applicable", "not_found", "source_error"), status)
        .when(status == "blocked", F.when(F.lower(note).contains("robot"), "blocked_robots").otherwise("blocked_policy")).otherwise("submission_error")
    )
