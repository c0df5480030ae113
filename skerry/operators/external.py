"""External sources: queries that they are asked, profiles and titles that are a company's, mentions on publishers' pages, and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import names, urls
from skerry.operators import feeds, signals, webpages

#: Words after which a title may name a company (fixed values).
BEFORE_NAME = ("av", "for", "fra", "hos", "i", "med", "om", "på", "til", "og", "kjøper", "velger")
LABELS = signals.LABELS


def discovery_query(name: Column, organisation: Column, municipality: Column) -> Column:
    """The query that a company is searched by: its quoted name, number and place; null without name or number."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(""))
    number = F.nullif(names.digits(organisation), F.lit(""))
    return F.when(tidy(name).isNotNull() & number.isNotNull(), F.concat_ws(" ", F.concat(F.lit('"'), tidy(name), F.lit('"')), number, tidy(municipality)))


def label_of(text: Column) -> Column:
    """The label that a generated text is, without marks around it; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^[.,:;!?\"']+|[.,:;!?\"']+$", "")
    return F.when(bare.isin(*LABELS), bare)


def company_profile_url(url: Column) -> Column:
    """The canonical address of a company's profile on the professional network; null for anything else."""
    host, slug = urls.host(url), F.lower(F.regexp_extract(F.trim(url), r"(?i)^[a-z]+://[^/]+/+company/+([^/?#]+)", 1))
    return F.when(((host == "linkedin.com") | host.endswith(".linkedin.com")) & (slug != ""), F.concat(F.lit("https://linkedin.com/company/"), slug))


def title_names(name: Column, title: Column) -> Column:
    """Whether a title, without its publisher, names a company in full at its beginning or after an ordinary word."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9æøå]+)"), 1)
    wanted, said = tokens(name), tokens(F.regexp_replace(title, r" - (?:(?! - ).)*$", ""))
    places = F.sequence(F.lit(1), F.greatest(F.size(said), F.lit(1)))
    here = lambda k: (F.slice(said, k, F.greatest(F.size(wanted), F.lit(1))) == wanted) & ((k == 1) | F.coalesce(F.get(said, k - 2).isin(*BEFORE_NAME), F.lit(False)))
    return (F.size(wanted) > 0) & F.exists(places, here)


# Titles that name no company, and roles that lead one.
TITLES_OF_NONE = ("home", "homepage", "forside", "welcome", "velkommen", "official site")
LEADING = ("DAGL", "LEDE", "INNH")
_PROFILE = (
    "name string, evidence struct<website: struct<status: string, value: struct<title: string, registered_domain: string, structured_organisations: array<struct<name: string>>>>, "
    "roles: struct<value: struct<roles: array<struct<name: string, role_code: string>>>>, locations: struct<value: struct<municipality: string>>>"
)


def profile_names(profiles: DataFrame, body: str = "body") -> DataFrame:
    """``profiles`` with ``aliases`` and ``leaders`` out of their JSON ``body``, as ``profile_identity`` takes them.

    Aliases are what the company's verified site calls itself, its title before a dash or bar and its marked-up organisations, without
    general words and the legal name, three at most; leaders are five holders of a leading role at most."""
    read = profiles.withColumn("_p", F.from_json(body, _PROFILE))
    full = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9æøå]+)"), 1), " ")
    site = F.col("_p.evidence.website")
    said = F.concat(F.array(site["value"]["title"]), F.coalesce(site["value"]["structured_organisations"]["name"], F.array().cast("array<string>")))
    short = F.transform(said, lambda x: F.trim(F.get(F.split(F.coalesce(x, F.lit("")), r"\s+[|\u2013\u2014]\s+", 2), 0)))
    fit = F.filter(short, lambda x: F.length(full(x)).between(3, 80) & ~full(x).isin(*TITLES_OF_NONE) & (full(x) != full(F.col("_p.name"))))
    aliases = F.when(F.coalesce(site["status"] == "available", F.lit(False)), F.slice(F.array_distinct(fit), 1, 3)).otherwise(F.array().cast("array<string>"))
    held = F.filter(F.coalesce(F.col("_p.evidence.roles.value.roles"), F.from_json(F.lit("[]"), "array<struct<name: string, role_code: string>>")), lambda r: r["role_code"].isin(*LEADING) & (F.coalesce(r["name"], F.lit("")) != ""))
    return read.withColumns({"aliases": aliases, "leaders": F.slice(F.transform(held, lambda r: r["name"]), 1, 5)}).drop("_p")


def profile_identity(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a company and a found profile with ``exact_entity`` and what agrees.

    Rows have ``name, site, municipality`` of a company, ``profile_name, profile_site, headquarters, profile_text`` of the profile, and
    ``aliases, leaders`` (arrays) and ``job_link``."""
    full = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9æøå]+)"), 1), " ")
    core = lambda c: names.without_legal_suffix(full(c))
    theirs = F.col("profile_name")
    whole, main = (full(F.col("name")) != "") & (full(F.col("name")) == full(theirs)), (core(F.col("name")) != "") & (core(F.col("name")) == core(theirs))
    domain = (urls.registered_domain(F.coalesce("site", F.lit(""))) != "") & (urls.registered_domain(F.coalesce("site", F.lit(""))) == urls.registered_domain(F.coalesce("profile_site", F.lit(""))))
    place = (full(F.col("municipality")) != "") & full(F.col("headquarters")).contains(full(F.col("municipality")))
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (full(a) == full(theirs)) | (core(a) == core(theirs)))
    leader = F.exists(F.coalesce("leaders", F.array().cast("array<string>")), lambda x: full(F.col("profile_text")).contains(full(x)))
    made = pairs.withColumns({"full_name_match": whole, "core_name_match": main, "domain_match": domain, "location_match": place, "alias_match": alias, "leader_match": leader})
    c = F.col
    exact = (c("domain_match") & (c("core_name_match") | c("alias_match"))) | (c("full_name_match") & (c("location_match") | F.coalesce("job_link", F.lit(False)))) | (c("alias_match") & c("location_match") & c("leader_match"))
    return made.withColumn("exact_entity", exact)


def verified_mentions(items: DataFrame, pages: DataFrame, today: Column, limit: int = 3, key: str = "organisation_number") -> DataFrame:
    """``key, url, title, day, publisher, place``: news items ``key, name, url`` whose publisher's page ``url, html`` has a date and a headline
    of its own that names the company; at most ``limit`` of a company, the newest first."""
    facts = webpages.article_facts(pages, [], today).select(F.col("page").alias("url"), "title", "day")
    told = items.select(key, "name", "url").distinct().join(facts, "url").where(feeds.names_company(F.col("name"), F.col("title")))
    order = Window.partitionBy(key).orderBy(F.col("day").desc(), "url")
    made = told.select(key, "url", "title", "day", urls.host(F.col("url")).alias("publisher")).withColumn("place", F.row_number().over(order))
    return made.where(F.col("place") <= limit)


def strategy_run(observations: DataFrame, strategies: DataFrame, key: str = "organisation_number") -> DataFrame:
    """``key, position, strategy, new_observations, score_before, score_after, result``: the score of each company as strategies ``strategy,
    position`` (from 1) are taken one after the other.

    Every strategy is taken once, so the last score is that of all observations, whatever the order.  An
    observation counts from its strategy on, so it is copied at most as often as there are strategies."""
    n = strategies.count()
    placed = observations.join(F.broadcast(strategies), "strategy")  # a handful of strategies
    grown = placed.select("*", F.explode(F.sequence("position", F.lit(n))).alias("_at"))
    scored = signals.development_score(grown.withColumn("_k", F.struct(F.col(key), F.col("_at"))), F.lit(True), F.lit(False), "_k").select(F.col(f"_k.{key}").alias(key), F.col("_k._at").alias("position"), F.col("score").alias("score_after"))
    fresh = placed.groupBy(key, "position").agg(F.count("*").alias("new_observations"))
    every = observations.select(key).distinct().crossJoin(F.broadcast(strategies))  # companies by strategies, each one a step
    made = every.join(scored, [key, "position"], "left").join(fresh, [key, "position"], "left").fillna({"score_after": 0.0, "new_observations": 0})
    before = F.coalesce(F.lag("score_after").over(Window.partitionBy(key).orderBy("position")), F.lit(0.0))
    made = made.withColumn("score_before", before)
    result = F.when(F.col("score_after") > F.col("score_before"), "reinforce_publishable").when(F.col("new_observations") > 0, "hold").otherwise("blocked_no_input")
    return made.select(key, "position", "strategy", "new_observations", "score_before", "score_after", result.alias("result"))


def crawl_summary(events: DataFrame, seeds: DataFrame, key: str = "organisation_number") -> DataFrame:
    """One row over crawl events ``key, requested_url, final_url, content_sha256, status``: distinct ones, companies reached, events by status, and
    the share of seeds with an event of their own."""
    once = events.dropDuplicates([key, "requested_url", "final_url", "content_sha256", "status"])
    statuses = once.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("unique_events"))
    reached = seeds.select(key).distinct().join(once.select(key).distinct().withColumn("_seen", F.lit(1)), key, "left").agg(F.count("*").alias("seeds"), F.count("_seen").alias("seeds_with_events"))
    row = statuses.crossJoin(F.broadcast(reached))  # one row each
    return row.withColumn("terminal_coverage", F.round(F.try_divide(F.col("seeds_with_events"), F.col("seeds")), 6))


def news_mentions(companies: DataFrame, items: DataFrame, pages: DataFrame, today: Column, limit: int = 3, key: str = "organisation_number") -> DataFrame:
    """One record per company: ``key, state, items, note``, of news that names it in full on the publisher's own page.

    ``companies`` are ``key, name`` with ``reason``, why the name is not told from others, or null; ``items`` are all found
    headlines ``url, headline``; ``pages`` the saved articles ``url, html``.  A headline only points to its page."""
    fit = companies.where("reason IS NULL")
    found = feeds.headline_mentions(fit, items, key=key, item="url").join(fit.select(key, "name"), key)
    told = verified_mentions(found, pages, today, limit, key)
    each = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url", "title", "day", "publisher"))), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["day"].alias("day"), x["publisher"].alias("publisher"))).alias("items"))
    state = F.when(F.col("reason").isNotNull(), "not_applicable").when(F.col("items").isNotNull(), "available").otherwise("not_available")
    # fixed text
    note = F.coalesce("reason", F.when(F.col("items").isNull(), "No news article names the exact legal name on its publisher's page"))
    return companies.join(each, key, "left").select(key, state.alias("state"), "items", note.alias("note"))
