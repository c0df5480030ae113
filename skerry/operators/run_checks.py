"""Checks of whole runs: terminal envelopes of the older contract, warnings about sources that degrade, and the history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import claims

# The terminal states of the older batch contract.
TERMINAL_STATES = ("complete", "not_applicable", "not_found", "blocked_policy", "blocked_robots", "source_error", "budget_exhausted", "submission_error")
KEY = "organisation_number"


def terminal_envelopes(profiles: DataFrame, records: DataFrame, modules: list[str], run_id: str, started_at: Column, completed_at: Column, key: str = KEY) -> DataFrame:
    """One row per profile: ``run_id, key, state, started_at, completed_at, modules``, a map of each of ``modules`` to its state,
    retries and last time; a module without a record is the submission's fault, and so is the whole then.

    ``records`` have ``key, module, status, note, retry_count, retrieved_at``, at most one for a module."""
    state = F.struct(claims.terminal_status(F.col("status"), F.coalesce("note", F.lit(""))).alias("state"), F.coalesce("retry_count", F.lit(0)).cast("int").alias("retry_count"), F.col("retrieved_at").alias("final_timestamp"))
    held = records.where(F.col("module").isin(*modules)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("module", state.alias("s")))).alias("_held"))
    none = F.struct(F.lit("submission_error").alias("state"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("final_timestamp"))
    each = [x for m in modules for x in (F.lit(m), F.coalesce(F.try_element_at("_held", F.lit(m)), none))]
    made = profiles.select(key).join(held, key, "left").withColumns({"run_id": F.lit(run_id), "started_at": started_at, "completed_at": completed_at, "modules": F.create_map(*each)})
    made = made.withColumn("modules", F.transform_values("modules", lambda _, s: F.struct(s["state"].alias("state"), s["retry_count"].alias("retry_count"), F.coalesce(s["final_timestamp"], F.col("completed_at")).alias("final_timestamp"))))
    wrong = F.exists(F.map_values("modules"), lambda s: s["state"] == "submission_error")
    return made.select("run_id", key, F.when(wrong, "submission_error").otherwise("complete").alias("state"), "started_at", "completed_at", "modules")


def batch_checks(envelopes: DataFrame, expected: int, key: str = KEY) -> DataFrame:
    """One row of what must hold of a batch of ``key, state, modules``, whether all of it does, and how many module states are none."""
    known = lambda s: s.isin(*TERMINAL_STATES)
    bad = F.size(F.filter(F.map_values("modules"), lambda s: ~F.coalesce(known(s["state"]), F.lit(False))))
    n = envelopes.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("none"), F.count_if(~F.coalesce(known(F.col("state")), F.lit(False))).alias("open"), F.coalesce(F.sum(bad), F.lit(0)).alias("invalid_states"))
    counted, unique = F.col("n") == expected, F.col("n") == F.col("ids") + F.least("none", F.lit(1))
    checks = {"exact_expected_count": counted, "unique_organisation_numbers": unique, "all_entity_states_terminal": F.col("open") == 0, "all_module_states_terminal": F.col("invalid_states") == 0, "zero_silent_drops": counted & unique}
    row = n.select(*[c.alias(k) for k, c in checks.items()], "invalid_states")
    return row.select(F.expr(" AND ".join(checks)).alias("passed"), *checks, "invalid_states")


def module_warnings(records: DataFrame, limits: DataFrame, key: str = KEY) -> DataFrame:
    """``module, rate, warning``: modules that failed for a larger share of companies than ``limits`` (``module, most``) allows, with the
    most frequent reason; ties by the reason."""
    top = claims.failure_reasons(records, 1, key).select("module", "rate", "reason")
    over = top.join(limits, "module").where(F.col("rate") > F.col("most"))
    percent = F.concat(F.format_number(F.col("rate") * 100, 1), F.lit("%"))
    return over.select("module", "rate", F.concat("module", F.lit(": "), percent, F.lit(" failed (top reason: "), "reason", F.lit(")")).alias("warning"))


def stream_warnings(streams: DataFrame) -> DataFrame:
    """``stream, warning`` of sources that degrade without failing a record.

    ``streams`` have ``stream, state, done, of, failed, note``; the sentences are fixed texts."""
    c, text = F.col, lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    done, of, note = F.coalesce("done", F.lit(0)), F.coalesce("of", F.lit(0)), F.when(F.coalesce("note", F.lit("")) != "", F.col("note"))
    told = F.when(note.isNotNull(), F.concat(F.lit(" ("), note, F.lit(")"))).otherwise("")
    searched = F.when(c("stream").isin("news_stream", "job_board_stream") & (done < of), F.concat("stream", F.lit(": searched "), text(c("done")), F.lit(" of "), text(c("of")), F.lit(" companies"), told))
    looked = F.when((c("stream") == "directory_stream") & (note.isNotNull() | (F.coalesce("failed", F.lit(0)) > 0) | (done < of)), F.concat(F.lit("directory_stream: looked up "), text(c("done")), F.lit(" of "), text(c("of")), F.lit(", "), text(c("failed")), F.lit(" failed"), told))
    fed = F.when(c("stream") == "jobs_feed", F.when(~F.coalesce(c("state") == "available", F.lit(False)), F.concat(F.lit("NAV job feed "), text(c("state")), F.lit(": "), text(note))).when(note.isNotNull(), F.concat(F.lit("NAV job feed incomplete: "), note)))
    history = c("stream") == "history_stream"
    fetched = F.when(history & (done < of), F.concat(F.lit("filing history fetched for "), text(c("done")), F.lit(" of "), text(c("of")), F.lit(" companies")))
    erred = F.when(history & (F.coalesce("failed", F.lit(0)) > 0), F.concat(F.lit("filing history stream: "), text(c("failed")), F.lit(" companies failed with an error")))
    return streams.select("stream", F.explode(F.array_compact(F.array(searched, looked, fed, fetched, erred))).alias("warning"))


def kept_history(runs: DataFrame, owner: str, at: str, most: int = 100) -> DataFrame:
    """The last ``most`` runs of each owner with their ``place`` from 1, the oldest kept first; of one time the greater content is later."""
    order = Window.partitionBy(owner).orderBy(F.col(at).desc(), F.xxhash64(*runs.columns).desc())
    kept = runs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    held = F.count("*").over(Window.partitionBy(owner))
    return kept.withColumn("place", (held - F.col("_k") + 1).cast("int")).drop("_k")
