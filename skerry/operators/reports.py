"""Reports over runs and requests."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import signals


#: Parts that a key's values are cut into when a rank is looked for, at approximate quantiles.
PARTS = 256


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``keys, n, max`` and for each name the value at an index from 0, a column over ``n``, of each key's sorted values.

    Exact, and no key's values meet in one task: counts by part tell the part that holds a rank, and only the
    counted values of these parts are put in order.  Parts are cut at approximate quantiles, so that outliers
    leave them as even as they are."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_v").alias("max"), F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], 4 * PARTS).alias("_cuts"))
    join = lambda a, b: a.alias("r").join(b.alias("o"), reduce(and_, same, F.lit(True)))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = join(counted, whole).select(*[f"r.{k}" for k in keys], "_v", "_c", part.alias("_part"))
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_held"))
    parts = parts.withColumn("_before", F.sum("_held").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_held"))
    asked = whole.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_at")) for name, rank in ranks.items()])).alias("_q")).select(*keys, "_q.*")
    hit = join(parts, asked).where("_at >= _before AND _at < _before + _held").select(*[f"r.{k}" for k in keys], "_part", "_before", "_name", "_at")
    inside = placed.alias("r").join(hit.alias("o"), reduce(and_, same, F.col("r._part") == F.col("o._part"))).select(*[f"r.{k}" for k in keys], "_v", "_c", "_before", "_name", "_at")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v"))
    found = inside.withColumn("_upto", upto).where("_at < _upto").groupBy(*keys).pivot("_name", list(ranks)).agg(F.min("_v"))
    return join(whole, found).select(*[f"r.{k}" for k in keys], "n", *ranks, "max")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, ``n`` and ``max`` of each key."""
    return at_ranks(df, keys, value, {name: F.greatest(F.ceil(F.col("n") * q) - 1, F.lit(0)) for name, q in shares.items()})


def indexed_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``p50`` at index n // 2 and ``p95`` at index min(n - 1, int(0.95 n)) of the sorted values."""
    return at_ranks(df, keys, value, {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100))}).drop("max")


def request_report(log: DataFrame, limit: int, key: str = "organisation_number") -> DataFrame:
    """One row over a log of ``key, purpose, requests``: all requests, their limit, by purpose, median and most of a company."""
    by = log.groupBy("purpose").agg(F.sum("requests").alias("r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("purpose", "r")))).alias("by_purpose"), F.sum("r").alias("requests"))
    each = log.groupBy(key).agg(F.sum("requests").alias("r")).withColumn("_all", F.lit(1))
    mid = at_ranks(each, ["_all"], "r", {"per_company_p50": F.floor(F.col("n") / 2)}).select("per_company_p50", F.col("max").alias("per_company_max"))
    return by.join(F.broadcast(mid), how="left").select("requests", F.lit(limit).alias("limit"), "by_purpose", F.coalesce("per_company_p50", F.lit(0)).alias("per_company_p50"), F.coalesce("per_company_max", F.lit(0)).alias("per_company_max"))  # one row each


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def footprint_evaluation(profiles: DataFrame, observations: DataFrame, labels: DataFrame, least_audit: int = 100, key: str = "organisation_number") -> DataFrame:
    """One row: precision of published observations by labels ``id, exact_entity, metric_correct, sentiment_correct``, and the shares
    of companies that publishable observations reach, by kind."""
    ok = F.size(signals.rejection_reasons()) == 0
    seen = observations.withColumn("_ok", ok)
    yes = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(False))
    both = seen.alias("o").join(labels.alias("l"), F.col("o.id") == F.col("l.id"))
    felt = F.col("_ok") & F.col("o.sentiment_label").isNotNull()
    audit = both.agg(
        F.count("*").alias("audited"), F.count_if("_ok").alias("published"), F.count_if(F.col("_ok") & ~yes("exact_entity")).alias("wrong_entity"),
        F.count_if(F.col("_ok") & ~yes("metric_correct")).alias("wrong_metric"), F.count_if(felt).alias("felt"), F.count_if(felt & yes("sentiment_correct")).alias("felt_right"),
    )
    kinds = lambda *names: F.max(F.col("signal_type").isin(*names))
    by = seen.where("_ok").groupBy(key).agg(
        F.count_distinct("platform").alias("platforms"), kinds("job_posting", "workforce_snapshot").alias("workforce_jobs"), kinds("review", "review_summary", "place_summary").alias("ratings_reviews"),
        kinds("public_post", "public_mention", "profile_metrics").alias("buzz_engagement"), F.max(F.col("sentiment_label").isNotNull()).alias("sentiment"),
    )
    reached = profiles.select(key).distinct().join(by, key, "left")
    share = lambda flag: _ratio(F.count_if(F.coalesce(flag, F.lit(False))), F.count("*"))
    cover = reached.agg(
        F.count("*").alias("profiles"), share(F.col("platforms") >= 1).alias("any_external"), share(F.col("platforms") >= 2).alias("two_platforms"), *[share(F.col(c)).alias(c) for c in ("workforce_jobs", "ratings_reviews", "buzz_engagement", "sentiment")]
    )
    size = labels.agg(F.count_distinct("id").alias("labelled"))
    row = cover.join(F.broadcast(audit)).join(F.broadcast(size))  # one row each
    entity, metric = (_ratio(F.col("published") - F.col(w), F.col("published")) for w in ("wrong_entity", "wrong_metric"))
    row = row.withColumns({"entity_precision": entity, "metric_precision": metric, "sentiment_accuracy": F.try_divide(F.col("felt_right"), F.col("felt")), "audit_size_gate": F.col("labelled") >= least_audit})
    passed = F.col("audit_size_gate") & (F.col("published") > 0) & (F.col("wrong_entity") == 0) & (F.col("entity_precision") >= 0.995) & (F.col("metric_precision") >= 0.98)
    return row.withColumn("qualification_passed", passed).drop("felt", "felt_right")


# Weights of completeness and the most that a controller gives for each part (fixed values).
FOUNDATION = {"official_identity": 5.0, "annual_accounts": 10.0, "roles": 5.0, "locations": 5.0, "website_terminal_state": 5.0}
ENRICHMENT = {
    "exact_external_identity": (8.0, 20.0), "verified_handles": (8.0, 15.0), "profile_metrics": (8.0, 10.0), "places_identity": (4.0, 5.0), "places_reviews": (8.0, 10.0), "workforce_jobs": (8.0, 10.0),
    "public_buzz": (8.0, 10.0), "independent_sentiment": (12.0, 15.0), "freshness_evidence": (6.0, 5.0),
}


def capped(weight: float, share: Column) -> Column:
    """Points for a share between 0 and 1."""
    return F.round(F.lit(weight) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share.cast("double"), F.lit(0.0)))), 3)


def completeness(results: DataFrame, profiles: DataFrame, key: str = "organisation_number") -> DataFrame:
    """``results`` scored: ``foundation_score`` by the profile's flags of FOUNDATION, and ``strict_score, experimental_score`` with the
    controller's points of ENRICHMENT, in columns of these names and with ``experimental_`` before them.  A result without a profile raises."""
    flags = profiles.select(key, *[F.col(n).alias(f"_{n}") for n in FOUNDATION], F.lit(True).alias("_there"))
    joined = results.join(flags, key, "left")
    base = F.round(reduce(add, [F.when(F.coalesce(f"_{n}", F.lit(False)), w).otherwise(0.0) for n, w in FOUNDATION.items()]), 3)
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing profile for "), F.col(key))).cast("double")).otherwise(base)
    made = joined.withColumn("foundation_score", checked)
    for side, prefix in (("strict", ""), ("experimental", "experimental_")):
        parts = [capped(w, F.col(f"{prefix}{n}") / most) for n, (w, most) in ENRICHMENT.items()]
        made = made.withColumn(f"{side}_score", F.round(F.col("foundation_score") + reduce(add, parts), 3))
    return made.select(key, "foundation_score", "strict_score", "experimental_score")


def completeness_summary(scored: DataFrame, base_size: int, ordinal: str = "ordinal") -> DataFrame:
    """Means and thresholds of the first ``base_size`` results, of the rest, and of all; ``part`` says which."""
    part = F.explode(F.array(F.lit("combined"), F.when(F.col(ordinal) < base_size, "base").otherwise("extension"))).alias("part")
    mean = lambda c: F.round(F.avg(c), 3).alias(f"{c}_mean")
    return scored.select("*", part).groupBy("part").agg(
        F.count("*").alias("companies"), mean("foundation_score"), mean("strict_score"), mean("experimental_score"), F.count_if(F.col("strict_score") >= 50).alias("strict_at_50"), F.count_if(F.col("experimental_score") >= 65).alias("experimental_at_65")
    )


def transfer(summary: DataFrame) -> DataFrame:
    """One row: how the means of the extension compare with those of the base."""
    of = lambda c, p: F.max(F.when(F.col("part") == p, F.col(f"{c}_score_mean")))
    return summary.agg(*[x for c in ("strict", "experimental") for x in (F.round(of(c, "extension") - of(c, "base"), 3).alias(f"{c}_mean_delta"), F.round(F.try_divide(of(c, "extension"), of(c, "base")), 4).alias(f"{c}_retention"))])


def competition_score(row: DataFrame) -> DataFrame:
    """Category points, gates and the score that may be awarded, over rows of report figures.

    Columns: ``two_platforms, workforce_jobs, ratings_reviews, buzz_engagement, sentiment, fresh, exact_registry, financials,
    roles_locations, website_terminal`` (shares), ``external_qualified, wrong_entity, unsupported, published, sentiment_qualified,
    audit_size_gate, connector_policy, batch_valid, resume_valid, refresh_valid, external_qa, ux_external`` and ``p95_ms,
    research, ux``."""
    c = F.col
    zero = (c("wrong_entity") == 0) & (c("published") > 0)
    supported = (c("unsupported") == 0) & (c("published") > 0)
    when = lambda flag, points: F.when(F.coalesce(flag, F.lit(False)), points).otherwise(0.0)
    external = [when(c("external_qualified") & zero, 10.0), *[when(c("external_qualified"), capped(w, c(n))) for n, w in (("two_platforms", 10), ("workforce_jobs", 7), ("ratings_reviews", 8), ("buzz_engagement", 7), ("fresh", 3))], when(c("sentiment_qualified"), capped(10, c("sentiment")))]
    official = [capped(w, c(n)) for n, w in (("exact_registry", 4), ("financials", 4), ("roles_locations", 4), ("website_terminal", 3))]
    research = F.round(F.least(F.lit(10.0), F.least(F.lit(12.0), c("research")) * 10 / 12), 3)
    daily = [when(c("batch_valid"), 4.0), when(c("resume_valid"), 2.0), when(c("refresh_valid"), 3.0), when(c("batch_valid") & (c("p95_ms") <= 10_000), 1.0), when(c("connector_policy"), 2.0)]
    ux = F.least(F.lit(8.0), c("ux"))
    categories = {
        "external_footprint": F.round(reduce(add, external), 3), "official_foundation": F.round(reduce(add, official), 3), "research_agent": F.when(c("external_qa"), research).otherwise(F.least(F.lit(5.0), research)),
        "daily_refresh": F.round(reduce(add, daily), 3), "product_design": F.when(c("ux_external"), ux).otherwise(F.least(F.lit(4.0), ux)),
    }
    gates = reduce(and_, [F.coalesce(g, F.lit(False)) for g in (c("audit_size_gate"), zero, supported, c("connector_policy"), c("exact_registry") == 1.0, c("batch_valid"), c("refresh_valid"))])
    made = row.withColumns(categories).withColumn("raw_score", F.round(reduce(add, [c(n) for n in categories]), 3)).withColumn("qualified", gates)
    return made.withColumn("awardable_score", F.when(c("qualified"), c("raw_score")).otherwise(0.0))


def discovery_outcomes(found: DataFrame) -> DataFrame:
    """``outcome, companies`` of sites ``status, domain`` against ``reference_domain``."""
    label = lambda d: F.substring_index(d, ".", 1)
    known = F.coalesce("reference_domain", F.lit("")) != ""
    outcome = (
        F.when((F.col("status") != "available") & known, F.concat("status", F.lit("_reference_exists"))).when(F.col("status") != "available", F.col("status")).when(~known, "published_no_reference")
        .when((F.col("domain") == F.col("reference_domain")) | (label(F.col("domain")) == label(F.col("reference_domain"))), "published_matches_reference").otherwise("published_differs_review")
    )
    return found.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("companies"))


def prediction_gates(gold: DataFrame, predictions: DataFrame, least: int = 300) -> DataFrame:
    """One row: coverage, accuracy, macro-F1 over the labels that occur, entity and evidence counts, and whether all gates hold.

    Ids that repeat raise."""
    twice = lambda df, what: df.groupBy("id").count().agg(F.assert_true(F.coalesce(F.max("count"), F.lit(1)) == 1, F.lit(f"{what} ids must be unique")).alias("_ok"))
    scores = signals.label_scores(gold, predictions)
    active = F.col("support") > 0
    by = scores.agg(
        F.coalesce(F.avg(F.when(active, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), F.array_sort(F.collect_list(F.when(active, F.col("label")))).alias("labels"),
        F.max(F.when(F.col("label") == "positive", F.col("precision"))).alias("_pos"), F.max(F.when(F.col("label") == "negative", F.col("precision"))).alias("_neg"),
    )
    said = F.col("p.label").isin(*signals.LABELS)
    have = lambda c: F.coalesce(F.col(f"p.{c}").cast("string"), F.lit("")) != ""
    exact, owned = F.coalesce("p.exact_entity", F.lit(False)), F.coalesce(F.col("p.source_class") == "company_owned", F.lit(False))
    supported = exact & F.coalesce(F.col("p.source_class").isin(*signals.INDEPENDENT_NEWS), F.lit(False)) & have("source_url") & have("retrieved_at") & have("evidence_span") & have("content_sha256")
    both = gold.alias("g").join(predictions.alias("p"), F.col("g.id") == F.col("p.id"), "left").agg(
        F.count("*").alias("gold_items"), F.count_if(said).alias("published"), F.avg(F.coalesce(F.col("g.label") == F.col("p.label"), F.lit(False)).cast("double")).alias("accuracy"),
        F.count_if(said & ~exact).alias("wrong_entity"), F.count_if(said & supported).alias("supported"), F.count_if(said & owned).alias("company_owned"),
    )
    row = both.join(F.broadcast(by)).join(F.broadcast(twice(gold, "gold"))).join(F.broadcast(twice(predictions, "prediction").withColumnRenamed("_ok", "_ok2")))  # one row each
    three = F.size(F.array_intersect("labels", F.array(*map(F.lit, ("positive", "neutral", "negative"))))) == 3
    coverage = F.try_divide(F.col("published"), F.col("gold_items"))
    gate = (
        (F.col("gold_items") >= least) & three & (F.col("wrong_entity") == 0) & (F.col("company_owned") == 0) & (F.col("macro_f1") >= 0.8) & (F.col("_pos") >= 0.9) & (F.col("_neg") >= 0.9)
        & (F.col("supported") == F.col("published")) & (coverage >= 0.5)
    )
    return row.withColumns({"coverage": coverage, "qualification_passed": F.coalesce(gate, F.lit(False)) & F.col("_ok").isNull() & F.col("_ok2").isNull()}).drop("_pos", "_neg", "_ok", "_ok2")


def coverage(claims: DataFrame, family: Column, key: str = "organisation_number") -> DataFrame:
    """Companies and claims of each family of available claims."""
    return claims.where("availability = 'available'").groupBy(family.alias("family")).agg(F.count_distinct(key).alias("companies"), F.count("*").alias("claims"))


def outage_share(modules: DataFrame, official: tuple[str, ...], key: str = "organisation_number") -> DataFrame:
    """One row: the share of companies whose official lookups all failed."""
    failed = F.col("status").isin("failed", "source_error")
    by = modules.where(F.col("module").isin(*official)).groupBy(key).agg(F.min(failed.cast("int")).alias("all_failed"))
    return by.agg(F.coalesce(F.avg("all_failed"), F.lit(0.0)).alias("outage_share"))


def merged_events(events: DataFrame, site: str) -> DataFrame:
    """Crawl events of each site: its latest homepage, distinct pages, social links and errors."""
    home = F.col("kind") == "homepage"
    return events.groupBy(site).agg(
        F.max_by(F.when(home, F.struct("url", "title", "retrieved_at")), F.when(home, F.col("retrieved_at"))).alias("homepage"),
        F.count_distinct("url").alias("pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("social")))).alias("social"),
        F.array_sort(F.collect_set("error")).alias("errors"),
    )


def batch_report(envelopes: DataFrame, modules: DataFrame, claims: DataFrame, problems: DataFrame, most: int = 20, key: str = "organisation_number") -> DataFrame:
    """One row about a batch: ``envelopes, unique_organisations, module_states`` (module to state to companies) ``, available_claims`` (field to
    claims) ``, runtime_ms_p50, runtime_ms_p95, passed, envelopes_with_problems, problems`` (of the first ``most`` envelopes that have any, in input order).

    ``envelopes`` have ``input_ordinal, key, runtime_ms``, ``modules`` ``module, state``, ``claims`` ``field, availability`` and ``problems`` ``key, problem``."""
    as_map = lambda a, b: F.map_from_entries(F.array_sort(F.collect_list(F.struct(a, b))))
    whole = envelopes.agg(F.count("*").alias("envelopes"), (F.count("*") == F.count_distinct(key)).alias("unique_organisations"))
    states = modules.groupBy("module", "state").agg(F.count("*").alias("n")).groupBy("module").agg(as_map("state", "n").alias("states")).agg(F.map_from_entries(F.collect_list(F.struct("module", "states"))).alias("module_states"))
    told = claims.where("availability = 'available'").groupBy("field").agg(F.count("*").alias("n")).agg(as_map("field", "n").alias("available_claims"))
    times = indexed_percentiles(envelopes.withColumn("_all", F.lit(1)), ["_all"], "runtime_ms").select(F.col("p50").alias("runtime_ms_p50"), F.col("p95").alias("runtime_ms_p95"))
    bad = problems.groupBy(key).agg(F.array_sort(F.collect_list("problem")).alias("p")).join(envelopes.select(key, "input_ordinal"), key)
    held = bad.agg(F.count("*").alias("envelopes_with_problems"))
    first = bad.orderBy("input_ordinal", key).limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("input_ordinal", key, "p"))), lambda x: F.struct(x[key].alias(key), x["p"].alias("problems"))).alias("problems"))
    row = whole
    for part in (states, told, times, held, first):  # one row each
        row = row.join(F.broadcast(part), how="left")
    return row.withColumn("passed", F.col("envelopes_with_problems") == 0)
