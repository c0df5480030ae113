"""The claims of an envelope, family by family, and the summary that restates them.

A claim is one row: ``organisation_number, position, field, value, availability, evidence_id, claim_span, source_url,
source_class, retrieved_at, content_sha256, confidence, note`` and what its family adds.  Families are
independent DataFrames that share this form and are put together by ``unionByName``; nothing is ever
claimed without the span of text that proves it, and a module without a result gives one claim that says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import canonical, names, urls
from skerry.operators import filings, registry
from skerry.operators.identity import STRONG

KEY = "organisation_number"
# Fixed values of the contract: fields of registry rows, parts of an address, flags, leading roles, modules.
REGISTRY_FIELDS = {
    "legal_name": "navn", "legal_form": "organisasjonsform.kode", "industry_code": "naeringskode1.kode", "industry": "naeringskode1.beskrivelse",
    "registered_employees": "antallAnsatte", "registry_declared_website": "hjemmeside",
}
ADDRESS_PARTS = ("adresse", "postnummer", "poststed", "kommune")
REGISTRY_FLAGS = {"bankrupt": "konkurs", "under_liquidation": "underAvvikling"}
LEADING_ROLES = ("daglig leder", "styrets leder", "ceo", "chair", "dagl", "leder")
MODULES = ("registry", "financials", "financial_history", "roles", "locations", "website", "social_profiles", "jobs", "site_jobs", "public_activity", "news_mentions")
OPTIONAL_MODULES = ("jobs", "site_jobs", "public_activity", "news_mentions")
FINANCIAL_FIELDS = ("revenue", "operating_result", "profit_before_tax", "annual_result", "assets", "equity", "debt")
PREVIOUS_FIELDS = ("revenue", "operating_result", "annual_result", "equity")
#: The field that stands for a module without a result.
EMPTY_FIELD = {
    "registry": "legal_identity", "financials": "financials", "financial_history": "financials.filed_years", "roles": "roles", "locations": "locations",
    "website": "official_website", "social_profiles": "social_profile", "jobs": "hiring_signal", "public_activity": "dated_news",
}
SOURCE = ("source_url", "source_class", "retrieved_at", "content_sha256")
COLUMNS = {
    KEY: "string", "module": "string", "position": "long", "field": "string", "value": "string", "availability": "string", "claim_span": "string", **dict.fromkeys(SOURCE, "string"),
    "evidence_id": "string", "confidence": "double", "note": "string", "signal_type": "string", "title": "string", "platform": "string", "published_at": "string", "expires_at": "string",
    "period_start": "string", "period_end": "string", "account_type": "string", "register_latest_year": "string", "relation": "string",
}


def claims(rows: DataFrame, module: str, **given: Column) -> DataFrame:
    """Rows as claims: named columns of COLUMNS that are given or there, the citation's id, and nulls for the rest."""
    c = lambda name: given[name] if name in given else F.col(name) if name in rows.columns else F.lit(None)
    made = rows.select(*[(F.lit(module) if n == "module" else c(n)).cast(t).alias(n) for n, t in COLUMNS.items() if n != "evidence_id"])
    cited = canonical.evidence_id(*map(F.col, SOURCE), F.col("claim_span"))
    made = made.withColumn("availability", F.coalesce("availability", F.lit("available"))).withColumn("evidence_id", F.when(F.col("source_url").isNotNull(), cited))
    return made.select(*COLUMNS)


def _spread(rows: DataFrame, structs: list[Column]) -> DataFrame:
    return rows.select("*", F.posexplode(F.array(*structs)).alias("position", "c")).select("*", "c.*").drop("c")


def registry_claims(rows: DataFrame) -> DataFrame:
    """Claims of registry rows whose ``raw`` maps columns to texts, ``live`` the columns that the live endpoint filled.

    A filled column cites ``live_url, live_retrieved_at, live_sha256``; an empty one is not available, never zero;
    a flag that is neither true nor false makes no claim."""
    value = lambda column: F.nullif(F.trim(F.coalesce(F.col("raw")[column], F.lit(""))), F.lit(""))
    from_live = lambda column: F.coalesce(F.array_contains("live", column), F.lit(False))
    one = lambda field, value, span, live, ok, note: F.struct(F.lit(field).alias("field"), value.alias("value"), span.alias("claim_span"), live.alias("_live"), ok.alias("_ok"), F.lit(note).alias("_why"))
    made = []
    for field, column in REGISTRY_FIELDS.items():
        typed = F.coalesce(value(column).try_cast("int").cast("string"), value(column)) if field == "registered_employees" else value(column)
        made.append(one(field, typed, F.concat(F.lit(f"{column}: "), F.coalesce(value(column), F.lit("(empty)"))), from_live(column), F.lit(True), "Empty in the official registry snapshot"))
    parts = {p: value(f"forretningsadresse.{p}") for p in ADDRESS_PARTS}
    there = parts["adresse"].isNotNull() | parts["poststed"].isNotNull()
    span = F.concat(F.lit("forretningsadresse: "), F.when(there, F.concat_ws(", ", *parts.values())).otherwise("(empty)"))
    made.append(one("business_address", F.when(there, canonical.canonical_json(parts)), span, from_live("forretningsadresse.adresse"), F.lit(True), None))
    for field, column in REGISTRY_FLAGS.items():
        flag = F.lower(value(column))
        made.append(one(field, flag, F.concat(F.lit(f"{column}: "), flag), F.lit(False), F.coalesce(flag.isin("true", "false"), F.lit(False)), None))
    each = _spread(rows, made).where("_ok")
    live = F.col("_live")
    source = {"source_url": F.when(live, F.col("live_url")).otherwise(F.col("source_url")), "source_class": F.when(live, "official_registry_live").otherwise(F.col("source_class")),
              "retrieved_at": F.when(live, F.col("live_retrieved_at")).otherwise(F.col("retrieved_at")), "content_sha256": F.when(live, F.col("live_sha256")).otherwise(F.col("content_sha256"))}
    empty = F.col("value").isNull()
    return claims(each, "registry", availability=F.when(empty, "not_available"), confidence=F.when(~empty, 1.0), note=F.when(empty, F.col("_why")), **source)


def register_latest_year(registry_year: Column, history_years: Column) -> Column:
    """The newest year of which the register says that accounts were filed."""
    years = F.concat(F.array(registry_year.cast("string")), F.coalesce(history_years, F.array().cast("array<string>")))
    return F.array_max(F.filter(years, lambda y: y.rlike(r"^\d+$")))


def financial_claims(filed: DataFrame, sources: DataFrame, latest_years: DataFrame) -> DataFrame:
    """Claims of the newest filing and of the one strictly before it, within one scope.

    ``filed`` holds filings ``period_start, period_end, account_type, record_id, currency`` and their measures,
    ``latest_years`` the ``register_latest_year`` of a company; a newer one marks the figures as stale."""
    both = filings.latest_in_scope(filed).join(sources, KEY).join(latest_years, KEY, "left")
    stale = F.when(F.col("register_latest_year") > F.substring("latest.period_end", 1, 4), F.col("register_latest_year"))
    out = []
    for prefix, side, fields in (("financials", "latest", FINANCIAL_FIELDS), ("financials.previous", "previous", PREVIOUS_FIELDS)):
        there = [f for f in fields if f in dict(filed.dtypes)]
        r = F.col(side)
        span = F.concat(F.lit("Regnskap "), F.concat_ws(" ", r["record_id"], r["account_type"], F.concat(r["period_start"], F.lit(".."), r["period_end"])))
        each = _spread(both.where(f"{side} IS NOT NULL"), [F.struct(F.lit(f"{prefix}.{f}").alias("field"), r[f].cast("double").alias("amount")) for f in there])
        none = F.col("amount").isNull()
        made = claims(
            each, "financials", value=F.when(~none, F.concat(F.col("amount").cast("string"), F.lit(" "), F.coalesce(r["currency"], F.lit("")))), availability=F.when(none, "not_available"), claim_span=span,
            confidence=F.when(~none, 1.0), period_start=r["period_start"], period_end=r["period_end"], account_type=r["account_type"], register_latest_year=stale,
        )
        out.append(made if side == "latest" else made.where("availability = 'available'"))
    return out[0].unionByName(out[1])


def history_claims(history: DataFrame) -> DataFrame:
    """One claim of the filed ``years`` of each company."""
    years = F.array_join("years", ", ")
    return claims(history.where("size(years) > 0"), "financial_history", field=F.lit("financials.filed_years"), value=years, claim_span=F.concat(F.lit("Filed annual-account years: "), years), confidence=F.lit(1.0))


def role_claims(roles: DataFrame) -> DataFrame:
    """One claim of each active role ``role, name``; holders that have left are not claimed."""
    active = roles.where(~F.coalesce("inactive", F.lit(False)))
    told = F.concat_ws(": ", "role", "name")
    return claims(active, "roles", field=F.lit("role"), value=told, claim_span=told, title=F.col("role"), confidence=F.lit(1.0), published_at=F.col("last_changed"))


def workplace_claims(locations: DataFrame) -> DataFrame:
    """One claim of each open subunit ``subunit_number, name``."""
    told = F.concat_ws(" ", F.lit("Underenhet"), "subunit_number", "name")
    return claims(locations, "locations", field=F.lit("registered_workplace"), value=F.col("subunit_number"), claim_span=told, title=F.col("name"), confidence=F.lit(1.0))


def website_claims(sites: DataFrame) -> DataFrame:
    """One claim of each site that is published, with its best proof's span: ``final_url, proofs, proof_spans`` (a map).

    Confidence follows the strongest proof: an identifier on the site, a declared site, else less."""
    strong = F.arrays_overlap("proofs", F.array(*map(F.lit, STRONG)))
    sure = F.when(strong, 0.99).when(F.array_contains("proofs", "registry_declared_website"), 0.95).otherwise(0.9)
    first = F.element_at(F.array_sort(F.map_entries("proof_spans")), 1)
    return claims(sites, "website", field=F.lit("official_website"), value=F.col("final_url"), claim_span=first["value"], title=F.array_join(F.array_sort("proofs"), ","), confidence=sure)


def social_claims(profiles: DataFrame) -> DataFrame:
    """One claim of each profile ``platform, url``, however its address is written; the first by ``position`` counts."""
    made = profiles.withColumn("value", urls.canonical_social(F.col("url"), F.col("platform")))
    once = made.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, "value").orderBy("position"))).where("_k = 1")
    return claims(once, "social_profiles", field=F.lit("social_profile"), claim_span=F.coalesce("claim_span", "url"), signal_type=F.lit("profile_handle"), confidence=F.lit(0.95), relation=F.lit("linked_from_verified_company_website"))


def hiring_claims(ads: DataFrame, postings: DataFrame, careers: DataFrame) -> DataFrame:
    """Claims of job ads from the national feed, then of postings on the site, then of its careers page.

    Rows have ``url, title, claim_span`` and their source; an address is claimed once, by the first of these."""
    sub = F.coalesce("employer_is_subunit", F.lit(False))
    feed = claims(ads, "jobs", field=F.lit("hiring_signal"), value=F.coalesce("url", "source_url"), confidence=F.lit(0.99), signal_type=F.lit("job_posting"), relation=F.when(sub, "registered_subunit_employer").otherwise("exact_employer"))
    site = claims(postings, "site_jobs", field=F.lit("hiring_signal"), value=F.col("url"), confidence=F.lit(0.95), signal_type=F.lit("job_posting"), relation=F.lit("listed_on_verified_company_website"))
    page = claims(careers, "site_jobs", field=F.lit("hiring_signal"), value=F.col("url"), confidence=F.lit(0.95), signal_type=F.lit("careers_page"), title=F.lit("Careers page"), relation=F.lit("linked_from_verified_company_website"))
    every = reduce(DataFrame.unionByName, [x.withColumn("_from", F.lit(k)) for k, x in enumerate((feed, site, page))])
    # the feed's own ads are all claimed; a posting or careers page only if nothing before has its address
    before = F.min("_from").over(Window.partitionBy(KEY, "value"))
    nth = F.row_number().over(Window.partitionBy(KEY, "value", "_from").orderBy(F.col("position").asc_nulls_last(), "evidence_id"))
    return every.withColumns({"_first": before, "_n": nth}).where("_from = 0 OR (_from = _first AND _n = 1)").drop("_from", "_first", "_n")


def activity_claims(items: DataFrame, news: DataFrame) -> DataFrame:
    """Claims of dated news: publishers' items ``url, title, date`` that the site does not list itself, then the site's."""
    own = claims(items, "public_activity", field=F.lit("dated_news"), value=F.col("url"), confidence=F.lit(0.9), signal_type=F.lit("public_post"), published_at=F.col("date"), relation=F.lit("published_on_verified_company_website"))
    told = claims(news, "news_mentions", field=F.lit("dated_news"), value=F.col("url"), confidence=F.lit(0.85), signal_type=F.lit("news_mention"), published_at=F.col("date"), relation=F.lit("exact_legal_name_in_news_title"))
    once = told.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, "value").orderBy(F.col("position").asc_nulls_last(), "evidence_id"))).where("_k = 1").drop("_k")
    return once.join(own.select(KEY, "value").distinct(), [KEY, "value"], "left_anti").select(*COLUMNS).unionByName(own)


def unavailable_claims(modules: DataFrame, made: DataFrame) -> DataFrame:
    """One claim for each module ``module, status, note`` that gave no claim, with its state.

    A module that ran and found nothing is not available.  A job feed that found nothing says nothing
    where the site's own postings answer."""
    state = registry.availability(F.col("status"))
    empty = modules.where(F.col("module").isin(*EMPTY_FIELD)).join(made.select(KEY, "module").distinct(), [KEY, "module"], "left_anti")
    answered = made.where("module = 'site_jobs'").select(KEY, F.lit("jobs").alias("module")).distinct()
    news = made.where("module = 'news_mentions'").select(KEY, F.lit("public_activity").alias("module")).distinct()
    empty = empty.join(answered.unionByName(news), [KEY, "module"], "left_anti")
    field = F.create_map(*[F.lit(x) for pair in EMPTY_FIELD.items() for x in pair])[F.col("module")]
    each = empty.withColumns({"field": field, "availability": F.when(state == "available", "not_available").otherwise(state)})
    return claims(each, "").withColumn("module", F.lit(None).cast("string"))


def envelope(inputs: DataFrame, made: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per input in input order: module states, claims in family order, evidence by id, errors."""
    state = registry.availability(F.col("status"))
    place = F.struct(F.coalesce(F.array_position(F.array(*map(F.lit, MODULES)), F.col("module")), F.lit(99)).alias("_m"), F.coalesce("position", F.lit(0)).alias("_p"), "field", "value", "availability", "evidence_id", "confidence")
    listed = made.groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda c: F.struct(c["field"], c["value"], c["availability"], c["evidence_id"], c["confidence"])).alias("claims"),
        F.array_sort(F.collect_set(F.when(F.col("evidence_id").isNotNull(), F.struct(F.col("evidence_id").alias("id"), *SOURCE, "claim_span")))).alias("evidence"),
    )
    run = modules.groupBy(KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", state.alias("state"))))).alias("ran"),
        F.array_sort(F.collect_list(F.when(state == "failed", F.struct("module", F.coalesce("note", F.lit("source failed")).alias("message"))))).alias("errors"),
    )
    required = F.map_from_arrays(F.array(*[F.lit(m) for m in MODULES if m not in OPTIONAL_MODULES]), F.array(*[F.lit("failed") for m in MODULES if m not in OPTIONAL_MODULES]))
    whole = F.map_concat(F.map_filter(required, lambda m, _: ~F.coalesce(F.map_contains_key("ran", m), F.lit(False))), F.coalesce("ran", F.create_map().cast("map<string,string>")))
    return inputs.join(listed, KEY, "left").join(run, KEY, "left").withColumn("modules", whole).drop("ran").orderBy("input_ordinal")


# the summary: every point restates available claims


def _money(amount: Column) -> Column:
    return names.money(amount)


def facts(made: DataFrame) -> DataFrame:
    """One row per company of what its available claims say, in the columns that the summary is written from."""
    ok = made.where("availability = 'available'")
    text = lambda field, column="value": F.min_by(F.when(F.col("field") == field, F.col(column)), F.when(F.col("field") == field, F.struct(F.coalesce("position", F.lit(0)), "value")))
    amount = lambda field: F.substring_index(text(field), " ", 1).try_cast("double")
    of = lambda field: F.col("field") == field
    listed = lambda field, column, limit, where=F.lit(True): F.slice(F.transform(F.array_sort(F.collect_list(F.when(of(field) & where, F.struct(F.coalesce("position", F.lit(0)).alias("p"), F.col(column).alias("x"))))), lambda s: s["x"]), 1, limit)
    address = text("business_address")
    return ok.groupBy(KEY).agg(
        text("legal_name").alias("name"), text("legal_form").alias("form"), text("industry").alias("industry"),
        F.coalesce(F.get_json_object(address, "$.poststed"), F.get_json_object(address, "$.kommune")).alias("place"),
        (text("bankrupt") == "true").alias("bankrupt"), (text("under_liquidation") == "true").alias("liquidating"),
        listed("role", "value", 3, F.lower("title").isin(*LEADING_ROLES)).alias("leaders"),
        *[amount(f"financials.{f}").alias(f) for f in FINANCIAL_FIELDS], *[amount(f"financials.previous.{f}").alias(f"previous_{f}") for f in PREVIOUS_FIELDS],
        F.substring(F.max(F.when(F.col("field").startswith("financials.") & ~F.col("field").startswith("financials.previous"), F.col("period_end"))), 1, 4).alias("year"),
        F.substring(F.max(F.when(F.col("field").startswith("financials.previous"), F.col("period_end"))), 1, 4).alias("previous_year"),
        F.max(F.when(~F.col("field").startswith("financials.previous"), F.col("account_type"))).alias("scope"), F.max("register_latest_year").alias("newer"),
        text("registered_employees").alias("employees"), F.count_if(of("registered_workplace")).alias("workplaces"), text("official_website").alias("website"),
        F.count_if(of("hiring_signal") & (F.col("signal_type") == "job_posting")).alias("jobs"), listed("hiring_signal", "title", 3, F.col("signal_type") == "job_posting").alias("job_titles"),
        F.min(F.when(of("hiring_signal") & (F.col("signal_type") == "careers_page"), F.col("value"))).alias("careers"),
        F.array_sort(F.collect_set(F.when(of("social_profile"), F.col("platform")))).alias("platforms"),
        F.max_by(F.when(of("dated_news"), F.struct("title", "published_at", "signal_type")), F.when(of("dated_news"), F.struct(F.coalesce("published_at", F.lit("")), "value"))).alias("news"),
        F.struct(
            *[text(field, "evidence_id").alias(field) for field in ("legal_name", "legal_form", "industry", "business_address", "bankrupt", "under_liquidation", "registered_employees", "official_website")],
            *[text(f"financials.{f}", "evidence_id").alias(f) for f in FINANCIAL_FIELDS], *[text(f"financials.previous.{f}", "evidence_id").alias(f"previous_{f}") for f in PREVIOUS_FIELDS],
            listed("role", "evidence_id", 3, F.lower("title").isin(*LEADING_ROLES)).alias("leaders"), listed("registered_workplace", "evidence_id", 5).alias("workplaces"),
            listed("hiring_signal", "evidence_id", 3, F.col("signal_type") == "job_posting").alias("jobs"), listed("social_profile", "evidence_id", 5).alias("profiles"),
            F.min_by(*[F.when(of("hiring_signal") & (F.col("signal_type") == "careers_page"), F.col(x)) for x in ("evidence_id", "value")]).alias("careers"),
            F.max_by(F.when(of("dated_news"), F.col("evidence_id")), F.when(of("dated_news"), F.struct(F.coalesce("published_at", F.lit("")), "value"))).alias("news"),
        ).alias("cited"),
    )


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%"))


def comparison_phrase(label: str, before: Column, now: Column, ratio: bool) -> Column:
    """How one figure moved from filing to filing; null where there is nothing to compare."""
    share = (now - before) / F.nullif(before, F.lit(0.0))
    sized = lambda x: _money(F.abs(x))
    side = lambda x: F.when(x < 0, "a loss of ").otherwise("a profit of ")
    loss = "negative equity" if label == "equity" else f"{label}: loss"
    moved = F.when(F.abs(share) < 0.005, "flat").otherwise(F.concat(F.when(share > 0, "up ").otherwise("down "), _percent(F.abs(share))))
    both = before.isNotNull() & now.isNotNull() & ~((before == 0) & (now == 0))
    told = (
        F.when((before > 0) & (now >= 0) & F.lit(ratio), F.concat(F.lit(f"{label} "), moved, F.lit(" ("), _money(before), F.lit(" to "), _money(now), F.lit(")")))
        .when(before == now, F.concat(F.when(now < 0, loss).otherwise(label), F.lit(" unchanged at "), sized(now)))
        .when((before < 0) != (now < 0), F.concat(F.lit(f"{label} turned from "), side(before), sized(before), F.lit(" to "), side(now), sized(now)))
        .when(before < 0, F.concat(F.lit(loss), F.when(now > before, " narrowed from ").otherwise(" widened from "), sized(before), F.lit(" to "), sized(now)))
        .otherwise(F.concat(F.lit(label), F.when(now > before, " up from ").otherwise(" down from "), _money(before), F.lit(" to "), _money(now)))
    )
    return F.when(both, told)


def summary_health() -> Column:
    """Warnings of a company's newest accounts, the text of its ratios, and whether there is an operating margin."""
    h = filings.health(F.col("revenue"), F.col("operating_result"), F.col("equity"), F.col("assets"))
    ratios = F.concat_ws(", ", F.concat(F.lit("operating margin "), _percent(h["operating_margin"])), F.concat(F.lit("equity ratio "), _percent(h["equity_ratio"])))
    return F.struct((ratios != "").alias("known"), h["operating_margin"].isNotNull().alias("margin"), h["flags"].alias("flags"), ratios.alias("ratios"))


def _citations(c, phrases: dict[str, Column], trend: Column, signals: Column) -> dict[str, Column]:
    """The sorted evidence ids of the claims that each topic restates; the takeaway cites what the points behind it do."""
    ids = lambda *given: F.array_sort(F.array_distinct(F.array_compact(F.array(*given))))
    all_of = lambda *lists: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.array_compact(x), F.array().cast("array<string>")) for x in lists]))))
    of = lambda field: c(f"cited.{field}")
    when = lambda told, *fields: F.when(told, F.array(*map(of, fields)))
    margin, ratio = c("health.margin"), c("health.ratios").contains("equity ratio")
    made = {
        "identity": ids(*map(of, ("legal_name", "legal_form", "industry", "business_address"))), "risk": ids(F.when(c("bankrupt"), of("bankrupt")), F.when(c("liquidating"), of("under_liquidation"))),
        "leadership": all_of(of("leaders")), "financials": ids(*[F.when(c(f).isNotNull(), of(f)) for f in ("revenue", "annual_result", "equity")]),
        "comparison": all_of(*[when(told.isNotNull(), f"previous_{f}", f) for f, told in phrases.items()]),
        "financial_health": all_of(when(margin, "revenue", "operating_result"), when(ratio, "equity", "assets")),
        "size": ids(of("registered_employees")), "locations": all_of(of("workplaces")), "web": ids(of("official_website")), "hiring": F.when(c("jobs") > 0, all_of(of("jobs"))).otherwise(ids(of("careers"))),
        "profiles": all_of(of("profiles")), "activity": ids(of("news")),
    }
    last_risk = F.array(F.when(c("liquidating"), of("under_liquidation")).when(c("bankrupt"), of("bankrupt")))
    net_loss = F.array(F.when(margin & (F.size("health.flags") == 0) & (c("annual_result") < 0), of("annual_result")))
    shown = F.when(F.size(signals) > 0, F.flatten(F.array(*[made[t] for t in ("hiring", "activity", "web", "profiles")])))
    made["takeaway"] = all_of(last_risk, net_loss, F.when(c("health.known"), made["financial_health"]), F.when(trend.isNotNull(), made["comparison"]), shown)
    return made


def summary(made: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``organisation_number, place, topic, text, evidence_ids``: the points of each company's summary, and what is not known.

    Topics come in the order of ``place``, the takeaway first; a topic without claims has no row.  Every point cites
    the evidence of the claims that it restates; ``changes``, one row for each material change since the previous
    run, make a point that cites none.  The sentences are fixed texts."""
    f = facts(made).withColumn("health", summary_health())
    if changes is not None:
        f = f.join(changes.groupBy(KEY).agg(F.count("*").alias("changed")), KEY, "left")
    else:
        f = f.withColumn("changed", F.lit(None).cast("long"))
    c, join = F.col, F.concat
    some = lambda x: x.isNotNull() & (F.size(x) > 0)
    identity = join(c("name"), F.coalesce(join(F.lit(" ("), c("form"), F.lit(")")), F.lit("")), F.coalesce(join(F.lit(" operates in "), F.lower("industry")), F.lit("")), F.coalesce(join(F.lit(", registered in "), F.initcap("place")), F.lit("")), F.lit("."))
    risk = F.concat_ws(" ", F.when(c("bankrupt"), "The company is registered as bankrupt."), F.when(c("liquidating"), "The company is registered as under liquidation."))
    figures = F.concat_ws(", ", join(F.lit("revenue "), _money(c("revenue"))), join(F.lit("annual result "), _money(c("annual_result"))), join(F.lit("equity "), _money(c("equity"))))
    scope = F.when(c("scope") == "KONSERN", "group accounts").otherwise("accounts")
    late = join(F.lit("Most recent "), scope, F.lit(" with published figures ("), c("year"), F.lit("): "), figures, F.lit(". The register lists accounts filed for "), c("newer"), F.lit(", whose figures are not yet in the open data."))
    now = join(F.lit("Latest filed "), scope, F.coalesce(join(F.lit(" ("), c("year"), F.lit(")")), F.lit("")), F.lit(": "), figures, F.lit("."))
    change = F.try_divide(c("revenue") - c("previous_revenue"), c("previous_revenue"))
    moved = F.when(F.abs(change) < 0.005, "flat").otherwise(join(F.when(change > 0, "up ").otherwise("down "), _percent(F.abs(change))))
    trend = F.when((c("previous_revenue") > 0) & (c("revenue") >= 0), join(F.lit("revenue "), moved, F.lit(" on the previous year")))
    told = {n: comparison_phrase(label, c(f"previous_{n}"), c(n), n in ("revenue", "equity")) for n, label in (("revenue", "revenue"), ("operating_result", "operating result"), ("annual_result", "annual result"), ("equity", "equity"))}
    phrases = F.concat_ws("; ", *told.values())
    health = join(F.lit("Financial health from the same accounts: "), c("health.ratios"), F.lit("."), F.when(F.size("health.flags") > 0, join(F.lit(" Watch: "), F.array_join("health.flags", ", "), F.lit("."))).otherwise(""))
    accounts = F.when(c("newer").isNotNull(), join(F.lit("its "), c("year"), F.lit(" accounts (a newer filing is not yet published)"))).otherwise("its latest accounts")
    standing = (
        F.when(F.exists(c("health.flags"), lambda x: x.contains("equity")), join(F.lit("financially at risk ("), F.array_join("health.flags", ", "), F.lit(")"), F.when(c("newer").isNotNull(), join(F.lit(" on "), accounts)).otherwise("")))
        .when(F.size("health.flags") > 0, join(F.lit("loss-making on "), accounts, F.lit(" but with adequate equity")))
        .when(c("health.margin") & (c("annual_result") < 0), join(F.lit("an operating profit but a net loss on "), accounts, F.lit(", with adequate equity")))
        .when(c("health.margin"), join(F.lit("profitable with adequate equity on "), accounts)).otherwise(join(F.lit("adequate equity on "), accounts))
    )
    hiring = (c("jobs") > 0) | c("careers").isNotNull()
    signals = F.array_compact(F.array(F.when(hiring, "hiring"), F.when(c("news").isNotNull(), "recent public activity"), F.when(c("website").isNotNull(), "verified website"), F.when(F.size("platforms") > 0, "social presence")))
    footprint = F.when(F.size(signals) > 0, join(F.lit("public signals: "), F.array_join(signals, ", "))).otherwise("no verified public footprint beyond the official register")
    takeaway = join(F.lit("In short: "), F.concat_ws("; ", F.when(c("bankrupt") | c("liquidating"), "formally distressed (bankruptcy or liquidation registered)"), F.when(c("health.known"), standing), trend, footprint), F.lit("."))
    where = F.when(c("news.signal_type") == "news_mention", "in the news").otherwise("on its website")
    unknown = F.array_compact(F.array(
        F.when(c("website").isNull(), "no verified official website"), F.when(c("revenue").isNull(), "no revenue figure in the latest filed accounts"), F.when(~hiring, "no hiring signal found"), F.when(c("news").isNull(), "no dated news found"),
    ))
    points = {
        "takeaway": takeaway, "identity": identity, "risk": F.nullif(risk, F.lit("")), "leadership": F.when(some(c("leaders")), join(F.lit("Leadership in the official register — "), F.array_join("leaders", "; "), F.lit("."))),
        "financials": F.when(figures != "", F.when(c("newer").isNotNull(), late).otherwise(now)),
        "comparison": F.when((phrases != "") & c("previous_year").isNotNull(), join(F.lit("Compared with "), c("previous_year"), F.lit(", in "), c("year"), F.lit(": "), phrases, F.lit("."))),
        "financial_health": F.when(c("health.known"), health),
        "size": join(c("employees"), F.lit(" employees registered in the official register.")), "locations": F.when(c("workplaces") > 0, join(c("workplaces"), F.when(c("workplaces") == 1, " registered workplace.").otherwise(" registered workplaces."))),
        "web": join(F.lit("Verified official website: "), c("website"), F.lit(".")),
        "hiring": F.when(c("jobs") > 0, join(F.lit("Hiring: "), c("jobs"), F.lit(" active job ad(s) naming this entity as employer ("), F.array_join("job_titles", ", "), F.lit(").")))
        .when(c("careers").isNotNull(), join(F.lit("Recruits through a careers page linked from its website: "), c("careers"), F.lit("."))),
        "profiles": F.when(some(c("platforms")), join(F.lit("Social profiles linked from its website: "), F.array_join("platforms", ", "), F.lit("."))),
        "activity": F.when(c("news").isNotNull(), join(F.lit("Most recent dated item "), where, F.lit(': "'), c("news.title"), F.lit('" ('), c("news.published_at"), F.lit(")."))),
        "changes": F.when(c("changed") > 0, join(c("changed"), F.lit(" material change(s) since the previous run."))),
        "unknowns": F.nullif(F.array_join(unknown, "; "), F.lit("")),
    }
    cited, none = _citations(c, told, trend, signals), F.array().cast("array<string>")
    each = f.select(KEY, F.posexplode(F.array(*[F.struct(F.lit(t).alias("topic"), x.alias("text"), cited.get(t, none).alias("evidence_ids")) for t, x in points.items()])).alias("place", "p"))
    return each.select(KEY, "place", "p.topic", "p.text", "p.evidence_ids").where("text IS NOT NULL")


def viewer_facts(made: DataFrame) -> DataFrame:
    """What filters and comparisons of companies read: ``revenue, growth`` in percent, ``employees, place``, flags and the latest dated item."""
    f = facts(made)
    growth = F.when(F.col("previous_revenue") > 0, F.round((F.col("revenue") - F.col("previous_revenue")) / F.col("previous_revenue") * 100, 1))
    return f.select(
        KEY, "revenue", growth.alias("growth"), F.col("employees").try_cast("int").alias("employees"), F.initcap("place").alias("place"), ((F.col("jobs") > 0) | F.col("careers").isNotNull()).alias("hiring"),
        F.col("website").isNotNull().alias("web"), F.col("news").isNotNull().alias("has_news"), (F.size("platforms") > 0).alias("social"), F.col("news.published_at").alias("news_at"), F.col("news.title").alias("news_title"),
    )
