"""External signals: validation, company rollups, sentiment and coverage scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import urls

# Fixed values of the observation contract.
PLATFORMS = (
    "company_site", "google_places", "linkedin", "facebook", "instagram", "x", "youtube", "tiktok", "glassdoor", "indeed", "job_board", "news", "openstreetmap", "brreg", "apple_app_store", "google_play", "wikidata", "wikipedia", "company_directory",
)
SIGNALS = ("company_profile", "profile_handle", "profile_metrics", "place_summary", "review", "review_summary", "job_posting", "workforce_snapshot", "public_post", "public_mention", "buzz_metrics")
APPROVED_MODES = ("official_api", "licensed_api", "company_authorized_export", "permitted_public_page")
EXPERIMENTAL_MODES = ("jobspy_experiment", "unofficial_api_experiment", "rights_review_experiment")
INDEPENDENT = ("customer_review", "employee_review", "licensed_news", "public_news", "public_mention")
INDEPENDENT_NEWS = ("licensed_news", "public_news", "official_notice", "licensed_review")
LABELS = ("positive", "neutral", "negative", "mixed")


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def rejection_reasons() -> Column:
    """Why an observation may not be published; empty where it may."""
    c = F.col
    in_ = lambda name, values: F.coalesce(c(name), F.lit("")).isin(*values)
    labelled = c("sentiment_label").isNotNull()
    rules = {
        "missing observation id": F.trim(F.coalesce(c("id"), F.lit(""))) == "",
        "missing or invalid organisation number": ~F.coalesce(c("organisation_number"), F.lit("")).rlike(r"^\d+$"),
        "unsupported platform": ~in_("platform", PLATFORMS),
        "unsupported signal type": ~in_("signal_type", SIGNALS),
        "missing or invalid source URL": urls.host(c("source_url")) == "",
        "missing retrieval time": _missing("retrieved_at"),
        "missing content hash": F.length(F.coalesce(c("content_sha256"), F.lit(""))) != 64,
        "exact legal entity is not verified": ~F.coalesce(c("exact_entity"), F.lit(False)),
        "missing exact-entity proof": F.coalesce(F.size("identity_proof"), F.lit(0)) <= 0,
        "acquisition mode is not approved for publication": ~in_("acquisition_mode", APPROVED_MODES),
        "source rights are not approved": ~in_("rights_status", ("approved",)),
        "missing evidence span": in_("signal_type", ("review", "public_post", "public_mention")) & _missing("evidence_span"),
        "unsupported sentiment label": labelled & ~in_("sentiment_label", LABELS),
        "sentiment source is not independent": labelled & ~in_("source_class", INDEPENDENT),
        "missing sentiment model version": labelled & _missing("sentiment_model_version"),
    }
    return F.array_compact(F.array(*[F.when(rule, why) for why, rule in rules.items()]))


def footprint(observations: DataFrame, as_of: Column, days: int = 45, key: str = "organisation_number") -> DataFrame:
    """One row per company: counts by platform, freshness, engagement and sentiment of its observations.

    A sentiment score needs ten items of two hosts or ten reviewers."""
    o = observations.withColumns({"ok": F.size(rejection_reasons()) == 0, "host": urls.host(F.col("source_url")), "at": F.try_to_timestamp("retrieved_at")})
    ok, kind = F.col("ok"), F.col("signal_type")
    public = ok & kind.isin("public_post", "public_mention", "buzz_metrics")
    felt = ok & F.col("sentiment_label").isNotNull()
    age = F.unix_timestamp(as_of) - F.unix_timestamp("at")
    value = F.when(F.col("sentiment_label") == "negative", -1).when(F.col("sentiment_label") == "neutral", 0).when(F.col("sentiment_label") == "positive", 1)
    metric = lambda m: F.coalesce(F.col("metrics")[m].try_cast("long"), F.lit(0))
    made = o.groupBy(key).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.array_sort(F.collect_set(F.when(ok, F.col("platform")))).alias("platforms"),
        F.count_if(ok & age.between(0, days * 86400)).alias("fresh"), F.count_if(ok & kind.isin("review", "review_summary")).alias("reviews"),
        F.count_distinct(F.when(ok & (kind == "job_posting"), F.col("source_url"))).alias("jobs"), F.count_distinct(F.when(public, F.col("source_url"))).alias("public_items"),
        F.coalesce(F.sum(F.when(public, metric("likes") + metric("comments") + metric("shares"))), F.lit(0)).alias("engagement"),
        F.count_if(felt).alias("sentiment_items"), F.count_distinct(F.when(felt, F.col("host"))).alias("hosts"),
        F.count_distinct(F.when(felt, F.nullif("reviewer_id", F.lit("")))).alias("reviewers"), F.avg(F.when(felt, value)).alias("mean"),
    )
    ready = (F.col("sentiment_items") >= 10) & ((F.col("hosts") >= 2) | (F.col("reviewers") >= 10))
    return made.withColumns({"sentiment_status": F.when(ready, "available").otherwise("abstain"), "sentiment_score": F.when(ready, F.bround(50 + 50 * F.col("mean"), 1))}).drop("mean")


def news_eligible() -> Column:
    present = [~_missing(c) for c in ("source_url", "retrieved_at", "evidence_span", "content_sha256")]
    return F.coalesce(F.col("exact_entity"), F.lit(False)) & F.coalesce(F.col("source_class"), F.lit("")).isin(*INDEPENDENT_NEWS) & reduce(lambda a, b: a & b, present)


def company_sentiment(items: DataFrame, key: str = "organisation_number") -> DataFrame:
    """Label of each company from items of at least two independent sources; else it abstains."""
    source = F.coalesce(F.nullif(F.lower(F.trim(F.col("source_id"))), F.lit("")), F.nullif(urls.host(F.col("source_url")), F.lit("")))
    good = news_eligible() & F.coalesce(F.col("label"), F.lit("")).isin(*LABELS)
    made = items.groupBy(key).agg(
        F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.count_distinct(F.when(good, source)).alias("sources"),
        F.array_sort(F.collect_set(F.when(good & (F.col("label") != "neutral"), F.col("label")))).alias("felt"),
    )
    label = F.when(F.size("felt") == 1, F.element_at("felt", 1)).when(F.size("felt") > 1, "mixed").otherwise("neutral")
    ready = F.col("sources") >= 2
    return made.select(key, F.when(ready, "available").otherwise("abstain").alias("status"), F.when(ready, label).alias("label"), "accepted", "rejected", "sources")


def label_scores(gold: DataFrame, predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, support, precision, recall, f1`` of predictions by id; without cases a measure is 0."""
    both = gold.select("id", F.col("label").alias("actual")).join(predictions.select("id", F.col("label").alias("said")), "id", "left")
    table = both.groupBy("actual", "said").agg(F.count("*").alias("_n"))  # as many rows as pairs of labels
    each = table.crossJoin(F.broadcast(gold.sparkSession.createDataFrame([(x,) for x in labels], "label string")))
    hit = lambda a, s: F.coalesce(F.sum(F.when(((F.col("actual") == F.col("label")) == F.lit(a)) & (F.col("said").eqNullSafe(F.col("label")) == F.lit(s)), F.col("_n"))), F.lit(0))
    n = each.groupBy("label").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return n.select("label", (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def development_score(observations: DataFrame, identified: Column, sentiment_ready: Column, key: str = "organisation_number") -> DataFrame:
    """Coverage score of each company from its publishable observations, each part capped."""
    ok = F.size(rejection_reasons()) == 0
    has = lambda *kinds: F.max(ok & F.col("signal_type").isin(*kinds))
    some = F.count_if(ok)
    handles = F.count_distinct(F.when(ok & (F.col("signal_type") == "profile_handle"), F.col("platform")))
    points = lambda flag, n: F.when(flag, float(n)).otherwise(0.0)
    parts = {
        "exact_external_identity": points(F.max(identified) & (some > 0), 20),
        "verified_handles": F.least(F.lit(15.0), handles * 5.0),
        "profile_metrics": points(has("profile_metrics"), 10),
        "places_identity": points(has("place_summary"), 5),
        "places_reviews": points(has("review", "review_summary"), 10),
        "workforce_jobs": points(has("job_posting", "workforce_snapshot"), 10),
        "public_buzz": points(has("public_post", "public_mention", "buzz_metrics"), 10),
        "independent_sentiment": points(F.max(sentiment_ready), 15),
        "freshness_evidence": points(some > 0, 5),
    }
    made = observations.groupBy(key).agg(*[v.alias(k) for k, v in parts.items()])
    return made.withColumn("score", F.round(reduce(lambda a, b: a + b, [F.col(k) for k in parts]), 3))


def strategy_order(strategies: DataFrame, history: DataFrame) -> DataFrame:
    """Strategies by mean gain and an exploration bonus; ties by their own order ``position``."""
    total = history.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    gains = history.groupBy("strategy").agg(F.count("*").alias("runs"), F.count_if(F.col("gain") > 0).alias("successes"), F.avg("gain").alias("mean"))
    all_ = strategies.join(gains, "strategy", "left").crossJoin(F.broadcast(total)).fillna({"runs": 0, "successes": 0, "mean": 0.0})  # one row
    priority = F.col("mean") + 0.35 * F.sqrt(F.ln(F.col("total") + 1) / (F.col("runs") + 1))
    return all_.select("strategy", "position", "runs", "successes", "mean", priority.alias("priority")).orderBy(F.col("priority").desc(), "position")


def top_n(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
