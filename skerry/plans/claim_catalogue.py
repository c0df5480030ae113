"""Queries over claims, summaries, answers and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import envelope, filings, profiles, refresh, registry, screens
from skerry.plans.catalogue import COMPANIES, FILINGS, SCOPED, _org, _read, annual_filings, companies, query

def _at() -> dict[str, Column]:
    """Where every row of these queries comes from."""
    return {"source_url": F.lit("https://data.example/row"), "source_class": F.lit("official_registry"), "retrieved_at": F.lit("2024-05-01T00:00:00Z"), "content_sha256": F.lit("ab")}


_ORG = "CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number"


def _registry_rows(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    raw = {
        "navn": F.col("c_name"), "organisasjonsform.kode": F.col("c_mktsegment"), "naeringskode1.kode": F.lit(" "), "naeringskode1.beskrivelse": F.concat(F.lit("Drift av nr "), F.col("c_nationkey")),
        "antallAnsatte": F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("string")).otherwise(""), "hjemmeside": F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("firma"), F.col("c_custkey"), F.lit(".no"))).otherwise(""),
        "forretningsadresse.adresse": F.when(F.col("c_custkey") % 2 == 0, "Gata 1"), "forretningsadresse.poststed": F.when(F.col("c_custkey") % 4 < 2, "OSLO"), "forretningsadresse.postnummer": F.lit("0150"),
        "konkurs": F.when(F.col("c_custkey") % 50 == 0, "True").when(F.col("c_custkey") % 7 == 0, "ukjent").otherwise("false"),
    }
    live = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("hjemmeside"))).otherwise(F.array().cast("array<string>"))
    at = {"live_url": F.lit("https://data.example/live"), "live_retrieved_at": F.lit("2024-05-02T00:00:00Z"), "live_sha256": F.lit("cd")}
    return c.select(_org("c_custkey"), F.create_map(*[x for k, v in raw.items() for x in (F.lit(k), v)]).alias("raw"), live.alias("live"), *[v.alias(k) for k, v in (_at() | at).items()])


_RAW = """r AS (SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, c_custkey, c_name AS navn, c_mktsegment AS form, 'Drift av nr ' || c_nationkey AS industry,
    CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) END AS employees, CASE WHEN c_custkey % 3 = 0 THEN 'firma' || c_custkey || '.no' END AS site,
    CASE WHEN c_custkey % 2 = 0 THEN 'Gata 1' END AS street, CASE WHEN c_custkey % 4 < 2 THEN 'OSLO' END AS city,
    CASE WHEN c_custkey % 50 = 0 THEN 'true' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'false' END AS bankrupt FROM customer)"""


@query(
    f"""WITH {_RAW}, f AS (
    SELECT organisation_number, 'legal_name' AS field, navn AS value, 'navn: ' || navn AS claim_span, false AS live FROM r
    UNION ALL SELECT organisation_number, 'legal_form', form, 'organisasjonsform.kode: ' || form, false FROM r
    UNION ALL SELECT organisation_number, 'industry_code', NULL, 'naeringskode1.kode: (empty)', false FROM r
    UNION ALL SELECT organisation_number, 'industry', industry, 'naeringskode1.beskrivelse: ' || industry, false FROM r
    UNION ALL SELECT organisation_number, 'registered_employees', employees, 'antallAnsatte: ' || coalesce(employees, '(empty)'), false FROM r
    UNION ALL SELECT organisation_number, 'registry_declared_website', site, 'hjemmeside: ' || coalesce(site, '(empty)'), c_custkey % 4 = 0 FROM r
    UNION ALL SELECT organisation_number, 'business_address', CASE WHEN street IS NOT NULL OR city IS NOT NULL THEN '{{"adresse": ' || coalesce('"' || street || '"', 'null') || ', "kommune": null, "postnummer": "0150", "poststed": ' || coalesce('"' || city || '"', 'null') || '}}' END,
        'forretningsadresse: ' || CASE WHEN street IS NOT NULL OR city IS NOT NULL THEN concat_ws(', ', street, '0150', city) ELSE '(empty)' END, false FROM r
    UNION ALL SELECT organisation_number, 'bankrupt', bankrupt, 'konkurs: ' || bankrupt, false FROM r WHERE bankrupt IS NOT NULL)
    SELECT organisation_number, field, value, CASE WHEN value IS NULL THEN 'not_available' ELSE 'available' END AS availability, claim_span,
    CASE WHEN live THEN 'official_registry_live' ELSE 'official_registry' END AS source_class FROM f"""
)
def registry_envelope(spark, sf_dir):
    """Claims of registry rows: six fields, the address, two flags; a column that the live endpoint filled cites it."""
    return envelope.registry_claims(_registry_rows(spark, sf_dir)).select("organisation_number", "field", "value", "availability", "claim_span", "source_class")


def _filing_rows(spark, sf_dir) -> DataFrame:
    f = annual_filings(spark, sf_dir)
    return f.withColumns({"period_start": F.concat(F.substring("period_end", 1, 4), F.lit("-01-01")), "currency": F.lit("NOK"), "equity": F.when(F.substring("period_end", 4, 1).cast("int") % 2 == 0, F.floor(F.col("revenue") / 4).cast("double"))})


def _financials(spark, sf_dir) -> DataFrame:
    sources = companies(spark, sf_dir).select("organisation_number", *[v.alias(k) for k, v in _at().items()])
    years = companies(spark, sf_dir).select("organisation_number", envelope.register_latest_year(F.when(F.col("organisation_number").cast("long") % 5 == 0, "2005").otherwise("x"), F.array(F.lit("1997"))).alias("register_latest_year"))
    return envelope.financial_claims(_filing_rows(spark, sf_dir), sources, years)


_EQUITY = "CASE WHEN CAST(substr({0}, 4, 1) AS INTEGER) % 2 = 0 THEN floor({1} / 4) END"


@query(
    f"""WITH {FILINGS}, {SCOPED}, a AS (SELECT * FROM scoped WHERE k = 1), b AS (SELECT s.* FROM scoped s JOIN a USING (organisation_number) WHERE s.period_end < a.period_end QUALIFY row_number() OVER (PARTITION BY s.organisation_number ORDER BY s.period_end DESC) = 1),
    x AS (SELECT organisation_number, 'financials.revenue' AS field, revenue AS amount, period_end, true AS now FROM a UNION ALL SELECT organisation_number, 'financials.annual_result', annual_result, period_end, true FROM a
    UNION ALL SELECT organisation_number, 'financials.equity', {_EQUITY.format('period_end', 'revenue')}, period_end, true FROM a
    UNION ALL SELECT organisation_number, 'financials.previous.revenue', revenue, period_end, false FROM b UNION ALL SELECT organisation_number, 'financials.previous.annual_result', annual_result, period_end, false FROM b
    UNION ALL SELECT organisation_number, 'financials.previous.equity', {_EQUITY.format('period_end', 'revenue')}, period_end, false FROM b)
    SELECT x.organisation_number, field, amount, x.period_end, CASE WHEN amount IS NULL THEN 'not_available' ELSE 'available' END AS availability,
    CASE WHEN (CASE WHEN CAST(x.organisation_number AS BIGINT) % 5 = 0 THEN '2005' ELSE '1997' END) > substr(a.period_end, 1, 4) THEN CASE WHEN CAST(x.organisation_number AS BIGINT) % 5 = 0 THEN '2005' ELSE '1997' END END AS register_latest_year
    FROM x JOIN a USING (organisation_number) WHERE now OR amount IS NOT NULL"""
)
def financial_envelope(spark, sf_dir):
    """Claims of the latest filing and the one before it, and whether the register knows of a newer one."""
    amount = F.substring_index("value", " ", 1).cast("double").alias("amount")
    return _financials(spark, sf_dir).select("organisation_number", "field", amount, "period_end", "availability", "register_latest_year")


@query("SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ', ' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS value, max('https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/' || (900000000 + o_custkey) || '/' || year(o_orderdate)) AS newest FROM orders GROUP BY 1")
def filed_years(spark, sf_dir):
    """The years for which a company has filed, and the address of the newest document."""
    years = _read(spark, sf_dir, "orders").groupBy(_org("o_custkey")).agg(F.collect_list(F.year("o_orderdate").cast("string")).alias("years"))
    made = filings.history(years)
    claimed = envelope.history_claims(made.withColumns(_at())).select("organisation_number", "value")
    return claimed.join(made.select("organisation_number", F.col("documents")[0]["url"].alias("newest")), "organisation_number")


@query(
    """SELECT CAST(900000000 + s_nationkey AS VARCHAR) AS organisation_number, 'role' AS field, CASE WHEN s_suppkey % 2 = 0 THEN 'Daglig leder' ELSE 'Styremedlem' END || ': ' || s_name AS value FROM supplier WHERE s_acctbal >= 0
    UNION ALL SELECT CAST(900000000 + s_nationkey AS VARCHAR), 'registered_workplace', CAST(800000000 + s_suppkey AS VARCHAR) FROM supplier"""
)
def role_and_workplace_claims(spark, sf_dir):
    """One claim of each active role and of each workplace."""
    s = _read(spark, sf_dir, "supplier").withColumns(_at()).withColumn("organisation_number", (F.lit(900000000) + F.col("s_nationkey")).cast("string"))
    roles = s.select("*", F.when(F.col("s_suppkey") % 2 == 0, "Daglig leder").otherwise("Styremedlem").alias("role"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("inactive"), F.lit("2020-01-01").alias("last_changed"))
    places = s.select("*", (F.lit(800000000) + F.col("s_suppkey")).cast("string").alias("subunit_number"), F.col("s_name").alias("name"))
    return envelope.role_claims(roles).unionByName(envelope.workplace_claims(places)).select("organisation_number", "field", "value")


def _sites(spark, sf_dir) -> DataFrame:
    proofs = F.array_compact(F.array(F.when(F.col("c_custkey") % 3 == 0, "registry_email"), F.when(F.col("c_custkey") % 2 == 0, "registry_declared_website"), F.lit("legal_name_on_site")))
    spans = F.map_from_arrays(proofs, F.transform(proofs, lambda p: F.concat(F.lit("span of "), p)))
    return _read(spark, sf_dir, "customer").where("c_custkey % 5 < 3").select(_org("c_custkey"), F.concat(F.lit("https://firma"), "c_custkey", F.lit(".no")).alias("final_url"), proofs.alias("proofs"), spans.alias("proof_spans"), *[v.alias(k) for k, v in _at().items()])


@query(
    f"""SELECT {_ORG}, 'https://firma' || c_custkey || '.no' AS value, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.99 WHEN c_custkey % 2 = 0 THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence,
    'span of legal_name_on_site' AS claim_span FROM customer WHERE c_custkey % 5 < 3"""
)
def website_claims(spark, sf_dir):
    """Published sites with the confidence of their strongest proof."""
    return envelope.website_claims(_sites(spark, sf_dir)).select("organisation_number", "value", "confidence", "claim_span")


def _profiles(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer").where("c_custkey % 4 < 3")
    one = lambda k, p, u: F.struct(F.lit(k).alias("position"), F.lit(p).alias("platform"), u.alias("url"))
    each = F.array(one(0, "facebook", F.concat(F.lit("https://Facebook.com/Firma"), "c_custkey")), one(1, "facebook", F.concat(F.lit("https://facebook.com/firma"), "c_custkey")), one(2, "youtube", F.concat(F.lit("https://YouTube.com/channel/UC"), "c_custkey")))
    return c.select(_org("c_custkey"), F.explode(each).alias("p"), *[v.alias(k) for k, v in _at().items()]).select("*", "p.*", F.lit(None).cast("string").alias("claim_span"))


@query(
    f"""SELECT {_ORG}, platform, value, claim_span FROM customer, LATERAL (VALUES ('facebook', 'https://facebook.com/firma' || c_custkey, 'https://Facebook.com/Firma' || c_custkey),
    ('youtube', 'https://youtube.com/channel/UC' || c_custkey, 'https://YouTube.com/channel/UC' || c_custkey)) AS t(platform, value, claim_span) WHERE c_custkey % 4 < 3"""
)
def social_claims(spark, sf_dir):
    """Profiles, once however their addresses are written; a channel keeps its case."""
    return envelope.social_claims(_profiles(spark, sf_dir)).select("organisation_number", "platform", "value", "claim_span")


def _hiring(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").withColumns(_at()).withColumns({"url": F.concat(F.lit("https://jobb.no/"), "o_orderkey"), "title": F.concat(F.lit("Stilling "), "o_orderkey"), "claim_span": F.lit("span"), "position": F.col("o_orderkey")})
    o = o.withColumn("organisation_number", (F.lit(900000000) + F.col("o_custkey")).cast("string"))
    ads = o.where("o_orderkey % 3 = 0").withColumn("employer_is_subunit", F.col("o_orderkey") % 2 == 0)
    careers = o.groupBy("organisation_number").agg(F.min("url").alias("url")).withColumns(_at() | {"claim_span": F.lit("karriere")})
    return envelope.hiring_claims(ads, o.where("o_orderkey % 4 = 0"), careers)


@query(
    """WITH o AS (SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, 'https://jobb.no/' || o_orderkey AS value, o_orderkey AS k FROM orders),
    a AS (SELECT organisation_number, value, 'job_posting' AS signal_type, CASE WHEN k % 2 = 0 THEN 'registered_subunit_employer' ELSE 'exact_employer' END AS relation FROM o WHERE k % 3 = 0
    UNION ALL SELECT organisation_number, value, 'job_posting', 'listed_on_verified_company_website' FROM o WHERE k % 4 = 0 AND k % 3 <> 0)
    SELECT * FROM a UNION ALL SELECT organisation_number, m, 'careers_page', 'linked_from_verified_company_website' FROM (SELECT organisation_number, min(value) AS m FROM o GROUP BY 1) WHERE m NOT IN (SELECT value FROM a)"""
)
def hiring_claims(spark, sf_dir):
    """Feed ads, then the site's postings, then its careers page; an address is claimed once."""
    return _hiring(spark, sf_dir).select("organisation_number", "value", "signal_type", "relation")


def _activity(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").withColumns(_at()).withColumns({
        "organisation_number": (F.lit(900000000) + F.col("o_custkey")).cast("string"), "url": F.concat(F.lit("https://avis.no/"), "o_orderkey"), "title": F.concat(F.lit("Sak "), "o_orderkey"), "claim_span": F.lit("span"),
        "date": F.to_date("o_orderdate").cast("string"), "position": F.col("o_orderkey"),
    })
    news = o.where("o_orderkey % 2 = 0")
    return envelope.activity_claims(o.where("o_orderkey % 3 = 0"), news.unionByName(news))


@query(
    """WITH o AS (SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, 'https://avis.no/' || o_orderkey AS value, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_at, o_orderkey AS k FROM orders)
    SELECT organisation_number, value, published_at, 'public_post' AS signal_type FROM o WHERE k % 3 = 0 UNION ALL SELECT organisation_number, value, published_at, 'news_mention' FROM o WHERE k % 2 = 0 AND k % 3 <> 0"""
)
def activity_claims(spark, sf_dir):
    """Publishers' items that the site does not list itself, each once, and the site's own."""
    return _activity(spark, sf_dir).select("organisation_number", "value", "published_at", "signal_type")


def _modules(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    one = lambda m, s: F.struct(F.lit(m).alias("module"), s.alias("status"), F.when(s == "source_error", "HTTP 503").alias("note"))
    key = F.col("c_custkey")
    each = [
        one("registry", F.lit("available")), one("financials", F.when(key % 3 == 0, "not_found").otherwise("available")), one("roles", F.when(key % 4 == 0, "source_error").otherwise("available")),
        one("website", F.when(key % 5 < 3, "available").otherwise("ambiguous")), one("jobs", F.lit("not_found")), one("social_profiles", F.when(key % 4 < 3, "available").otherwise("blocked")),
    ]
    return c.select(_org("c_custkey"), F.explode(F.array(*each)).alias("m")).select("organisation_number", "m.*")


@query(
    f"""WITH j AS (SELECT DISTINCT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number FROM orders), x AS (SELECT {_ORG}, c_custkey AS k FROM customer)
    SELECT organisation_number, 'financials' AS field, CASE WHEN k % 3 = 0 THEN 'not_available' ELSE 'not_available' END AS availability FROM x WHERE organisation_number NOT IN (SELECT organisation_number FROM j)
    UNION ALL SELECT organisation_number, 'roles', CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'not_available' END FROM x UNION ALL SELECT organisation_number, 'official_website', 'ambiguous' FROM x WHERE k % 5 >= 3
    UNION ALL SELECT organisation_number, 'social_profile', 'blocked' FROM x WHERE k % 4 = 3 UNION ALL SELECT organisation_number, 'hiring_signal', 'not_available' FROM x WHERE organisation_number NOT IN (SELECT organisation_number FROM j)"""
)
def unavailable_claims(spark, sf_dir):
    """Modules without a claim say so; the job feed says nothing where the site's own postings answer."""
    parts = [envelope.registry_claims(_registry_rows(spark, sf_dir)), _financials(spark, sf_dir), envelope.website_claims(_sites(spark, sf_dir)), envelope.social_claims(_profiles(spark, sf_dir)), _hiring(spark, sf_dir)]
    made = reduce(DataFrame.unionByName, parts)
    return envelope.unavailable_claims(_modules(spark, sf_dir), made).select("organisation_number", "field", "availability")


@query(
    f"""SELECT CAST(c_custkey AS BIGINT) AS input_ordinal, {_ORG}, 'failed' AS history, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'available' END AS roles, 'not_available' AS jobs,
    CASE WHEN c_custkey % 4 = 0 THEN CAST(1 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS errors, CASE WHEN c_custkey % 5 < 3 THEN CAST(1 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS claims FROM customer"""
)
def envelope_assembly(spark, sf_dir):
    """One envelope per input: module states (a required module that did not run has failed), claims, errors."""
    inputs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("input_ordinal"), _org("c_custkey"))
    made = envelope.envelope(inputs, envelope.website_claims(_sites(spark, sf_dir)), _modules(spark, sf_dir))
    return made.select(
        "input_ordinal", "organisation_number", F.col("modules")["financial_history"].alias("history"), F.col("modules")["roles"].alias("roles"), F.col("modules")["jobs"].alias("jobs"), F.size("errors").alias("errors"), F.coalesce(F.nullif(F.size("claims"), F.lit(-1)), F.lit(0)).alias("claims")
    )


@query(
    f"""WITH {_RAW}, j AS (SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, count(*) AS n, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS day FROM orders GROUP BY 1),
    x AS (SELECT r.*, coalesce(j.n, 0) > 0 AS news, c_custkey % 5 < 3 AS web FROM r LEFT JOIN j USING (organisation_number)),
    s AS (SELECT *, array_to_string(list_filter([CASE WHEN news THEN 'recent public activity' END, CASE WHEN web THEN 'verified website' END], lambda q: q IS NOT NULL), ', ') AS signals FROM x)
    SELECT organisation_number, 'takeaway' AS topic, 'In short: ' || CASE WHEN bankrupt = 'true' THEN 'formally distressed (bankruptcy or liquidation registered); ' ELSE '' END ||
        CASE WHEN signals = '' THEN 'no verified public footprint beyond the official register' ELSE 'public signals: ' || signals END || '.' AS text FROM s
    UNION ALL SELECT organisation_number, 'identity', navn || ' (' || form || ') operates in ' || lower(industry) || CASE WHEN city IS NOT NULL THEN ', registered in Oslo' ELSE '' END || '.' FROM s
    UNION ALL SELECT organisation_number, 'risk', 'The company is registered as bankrupt.' FROM s WHERE bankrupt = 'true'
    UNION ALL SELECT organisation_number, 'size', employees || ' employees registered in the official register.' FROM s WHERE employees IS NOT NULL
    UNION ALL SELECT organisation_number, 'web', 'Verified official website: https://firma' || c_custkey || '.no.' FROM s WHERE web
    UNION ALL SELECT organisation_number, 'unknowns', array_to_string(list_filter([CASE WHEN NOT web THEN 'no verified official website' END, 'no revenue figure in the latest filed accounts', 'no hiring signal found', CASE WHEN NOT news THEN 'no dated news found' END], lambda q: q IS NOT NULL), '; ') FROM s"""
)
def summary_points(spark, sf_dir):
    """What each company's summary says of its identity, risk, size, site and footprint, and what is not known."""
    return envelope.summary(_summary_claims(spark, sf_dir)).where("topic <> 'activity'").select("organisation_number", "topic", "text")


def _summary_claims(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumns(_at()).withColumns({"organisation_number": (F.lit(900000000) + F.col("o_custkey")).cast("string"), "url": F.concat(F.lit("https://avis.no/"), "o_orderkey"), "title": F.lit("Sak"), "claim_span": F.lit("s"), "date": F.to_date("o_orderdate").cast("string")})
    return envelope.registry_claims(_registry_rows(spark, sf_dir)).unionByName(envelope.website_claims(_sites(spark, sf_dir))).unionByName(envelope.activity_claims(o, o.limit(0)))


@query(
    f"""WITH {_RAW}, j AS (SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT r.*, coalesce(j.n, 0) AS n, coalesce(j.n, 0) > 0 AS news, c_custkey % 5 < 3 AS web FROM r LEFT JOIN j USING (organisation_number))
    SELECT organisation_number, 'takeaway' AS topic, array_to_string(list_filter([CASE WHEN bankrupt = 'true' THEN 'bankrupt' END, CASE WHEN news THEN 'dated_news' END, CASE WHEN web THEN 'official_website' END], lambda q: q IS NOT NULL), ',') AS cited FROM s
    UNION ALL SELECT organisation_number, 'identity', array_to_string(list_filter([CASE WHEN city IS NOT NULL OR street IS NOT NULL THEN 'business_address' END, 'industry', 'legal_form', 'legal_name'], lambda q: q IS NOT NULL), ',') FROM s
    UNION ALL SELECT organisation_number, 'risk', 'bankrupt' FROM s WHERE bankrupt = 'true'
    UNION ALL SELECT organisation_number, 'size', 'registered_employees' FROM s WHERE employees IS NOT NULL
    UNION ALL SELECT organisation_number, 'web', 'official_website' FROM s WHERE web
    UNION ALL SELECT organisation_number, 'activity', 'dated_news' FROM s WHERE news
    UNION ALL SELECT organisation_number, 'changes', '' FROM s WHERE n > 0
    UNION ALL SELECT organisation_number, 'unknowns', '' FROM s"""
)
def summary_citations(spark, sf_dir):
    """The fields of the claims whose evidence each point of the summary cites; orders stand for changes, too."""
    made = _summary_claims(spark, sf_dir)
    points = envelope.summary(made, _read(spark, sf_dir, "orders").select(_org("o_custkey")))
    known = made.where("availability = 'available'").select("organisation_number", F.col("evidence_id").alias("id"), "field").distinct()
    each = points.select("organisation_number", "topic", F.explode_outer("evidence_ids").alias("id")).join(known, ["organisation_number", "id"], "left")
    return each.groupBy("organisation_number", "topic").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("cited"))


@query(
    f"""WITH {FILINGS}, {SCOPED}, a AS (SELECT * FROM scoped WHERE k = 1), b AS (SELECT s.* FROM scoped s JOIN a USING (organisation_number) WHERE s.period_end < a.period_end QUALIFY row_number() OVER (PARTITION BY s.organisation_number ORDER BY s.period_end DESC) = 1)
    SELECT a.organisation_number, a.revenue, round((a.revenue - b.revenue) / b.revenue * 100, 1) AS growth FROM a LEFT JOIN b USING (organisation_number)"""
)
def viewer_facts(spark, sf_dir):
    """Revenue and its growth in percent, as lists of companies show them."""
    return envelope.viewer_facts(_financials(spark, sf_dir)).select("organisation_number", "revenue", "growth")


def _answer(spark, sf_dir, question: str) -> DataFrame:
    rows = companies(spark, sf_dir)
    latest = filings.listed_first(annual_filings(spark, sf_dir))
    s = _read(spark, sf_dir, "supplier").withColumn("organisation_number", (F.lit(900000000) + F.col("s_nationkey")).cast("string"))
    roles = s.select("organisation_number", F.col("s_suppkey").alias("position"), F.lit("Styremedlem").alias("role"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("inactive"))
    sites = rows.select("organisation_number", F.when(F.col("employees") > 50, "available").otherwise("not_found").alias("status"), (F.col("employees") % 2 == 0).alias("publishable"), F.lit("Om oss").alias("description"), F.array(F.struct(F.lit("x").alias("platform"), F.lit("https://x.com/a").alias("url"))).alias("social_links"))
    sources = rows.select("organisation_number", F.explode(F.array(*map(F.lit, ("registry", "financials", "roles", "locations", "website")))).alias("module")).withColumns({"source_url": F.concat(F.lit("https://data.example/"), "module"), "retrieved_at": F.lit("2024"), "content_sha256": F.lit("ab")})
    return screens.answer(rows, question, filings=latest, roles=roles, locations=roles.drop("inactive"), sites=sites, evidence=sources)


@query(
    f"""WITH {COMPANIES}, {FILINGS}, l AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY period_end DESC, CASE WHEN account_type = 'KONSERN' THEN 1 ELSE 0 END) = 1)
    SELECT organisation_number, 'Revenue' AS label, revenue AS amount, 'https://data.example/financials' AS source_url FROM l UNION ALL SELECT organisation_number, 'Annual result', annual_result, 'https://data.example/financials' FROM l
    UNION ALL SELECT organisation_number, 'No normalized annual-account record was returned; missing values are not interpreted as zero.', NULL, 'https://data.example/financials' FROM companies WHERE organisation_number NOT IN (SELECT organisation_number FROM l)"""
)
def answer_financials(spark, sf_dir):
    """The facts that a question about results asks for, with their source, and what cannot be said."""
    made = _answer(spark, sf_dir, "What was the annual result?").where("label <> 'Reporting period'")
    return made.select("organisation_number", "label", F.col("value").cast("double").alias("amount"), "source_url")


@query(
    f"""WITH {COMPANIES}, r AS (SELECT CAST(900000000 + s_nationkey AS VARCHAR) AS organisation_number, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal >= 0),
    p AS (SELECT CAST(900000000 + s_nationkey AS VARCHAR) AS organisation_number, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
    SELECT organisation_number, 'official_role_record' AS claim_type, s_name AS value FROM r WHERE k <= 12 AND organisation_number IN (SELECT organisation_number FROM companies) UNION ALL SELECT organisation_number, 'unsupported', NULL FROM companies WHERE organisation_number NOT IN (SELECT organisation_number FROM r)
    UNION ALL SELECT organisation_number, 'official_subunit_record', s_name FROM p WHERE k <= 12 AND organisation_number IN (SELECT organisation_number FROM companies) UNION ALL SELECT organisation_number, 'unsupported', NULL FROM companies WHERE organisation_number NOT IN (SELECT organisation_number FROM p)"""
)
def answer_people_and_places(spark, sf_dir):
    """At most twelve active roles and twelve locations of a company."""
    return _answer(spark, sf_dir, "Who leads the company and where is it?").select("organisation_number", "claim_type", "value")


@query(
    f"""WITH {COMPANIES} SELECT organisation_number, claim_type, label, value FROM companies, LATERAL (VALUES
    ('company_reported_claim', 'Website description', CASE WHEN employees > 50 AND employees % 2 = 0 THEN 'Om oss' END), ('company_linked_social_profile', 'Declared x profile', CASE WHEN employees > 50 AND employees % 2 = 0 THEN 'https://x.com/a' END)) AS t(claim_type, label, value) WHERE value IS NOT NULL
    UNION ALL SELECT organisation_number, 'unsupported', 'A registry-linked website was fetched, but exact legal-entity identity was not established; its claims and social links are quarantined.', NULL FROM companies WHERE employees > 50 AND employees % 2 = 1
    UNION ALL SELECT organisation_number, 'unsupported', 'The registry-linked company website was not available to this run.', NULL FROM companies WHERE coalesce(employees <= 50, true)"""
)
def answer_social(spark, sf_dir):
    """Claims and profiles of a site that is not proven are quarantined."""
    return _answer(spark, sf_dir, "Which social profiles?").select("organisation_number", "claim_type", "label", "value")


@query(
    f"""WITH {COMPANIES}, {FILINGS}, l AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY period_end DESC, CASE WHEN account_type = 'KONSERN' THEN 1 ELSE 0 END) = 1)
    SELECT c.organisation_number, 'financials:https://data.example/financials;registry:' AS citations FROM companies c JOIN l USING (organisation_number) WHERE employees > 40 AND revenue > 500000"""
)
def screen_citations(spark, sf_dir):
    """Each result cites the modules that its filters rest on."""
    rows = companies(spark, sf_dir).join(filings.listed_first(annual_filings(spark, sf_dir)).select("organisation_number", "revenue", "annual_result"), "organisation_number", "left")
    sources = rows.select("organisation_number", F.lit("financials").alias("module"), F.lit("https://data.example/financials").alias("source_url"), F.lit("2024").alias("retrieved_at"), F.lit("ab").alias("content_sha256"))
    made = screens.cited(rows, "more than 40 employees and revenue over 500000", sources)
    return made.select("organisation_number", F.array_join(F.transform("citations", lambda c: F.concat(c["module"], F.lit(":"), F.coalesce(c["source_url"], F.lit("")))), ";").alias("citations"))


# profiles


@query(
    f"""SELECT {_ORG}, c_name AS name, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS employees, CASE WHEN c_custkey % 2 = 0 THEN true END AS bankrupt, 'AS' AS legal_form FROM customer"""
)
def live_entities(spark, sf_dir):
    """Fields of live register answers; what an answer does not say is null."""
    body = F.to_json(F.struct((F.lit(900000000) + F.col("c_custkey")).cast("string").alias("organisasjonsnummer"), F.col("c_name").alias("navn"), F.struct(F.lit("AS").alias("kode")).alias("organisasjonsform"), F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("antallAnsatte"), F.when(F.col("c_custkey") % 2 == 0, True).alias("konkurs")))
    return profiles.entities(_read(spark, sf_dir, "customer").select(body.alias("body"))).select("organisation_number", "name", "employees", "bankrupt", "legal_form")


@query(
    f"""SELECT {_ORG}, CASE WHEN c_custkey % 4 = 0 THEN 'Nytt navn' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS name, c_mktsegment AS legal_form FROM customer"""
)
def presence_overlay(spark, sf_dir):
    """A live field that is present overwrites, even with a null; one that is absent does not."""
    base = companies(spark, sf_dir).select("organisation_number", "name", "legal_form")
    at = F.col("organisation_number").cast("long") % 4
    null = F.lit(None).cast("string")
    value = F.when(at == 0, F.create_map(F.lit("name"), F.lit("Nytt navn"))).when(at == 1, F.create_map(F.lit("name"), null)).when(at == 2, F.create_map(F.lit("other"), F.lit("x")))
    return profiles.overlaid(base, base.select("organisation_number", value.alias("value")), ["name", "legal_form"])


@query(
    f"""SELECT {_ORG}, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.no' WHEN c_custkey % 3 = 1 THEN 'live@b.no' END AS email, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' END AS phone,
    CASE c_custkey % 3 WHEN 0 THEN 'telefon' WHEN 1 THEN 'epostadresse,telefon' ELSE '' END AS filled FROM customer"""
)
def absent_contacts(spark, sf_dir):
    """Only columns that a snapshot lacks are filled from the live entity."""
    at = F.col("c_custkey") % 3
    rows = _read(spark, sf_dir, "customer").select(_org("c_custkey"), F.when(at == 0, F.create_map(F.lit("epostadresse"), F.lit("a@b.no"))).otherwise(F.create_map(F.lit("navn"), F.lit("x"))).alias("raw"))
    live = _read(spark, sf_dir, "customer").where("c_custkey % 3 <> 2").select(_org("c_custkey"), F.create_map(F.lit("epostadresse"), F.lit("live@b.no")).alias("raw"))
    made = profiles.filled_absent(rows, live, ["epostadresse", "telefon"])
    return made.select("organisation_number", F.col("raw")["epostadresse"].alias("email"), F.col("raw")["telefon"].alias("phone"), F.array_join("filled", ",").alias("filled"))


@query(
    """WITH c AS (SELECT CAST(900000000 + n_nationkey AS VARCHAR) AS organisation_number, n_name FROM nation)
    SELECT organisation_number, coalesce(string_agg(CAST(800000000 + s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS numbers, coalesce(string_agg(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_name END, ',' ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN s_name END), '') AS names
    FROM c LEFT JOIN supplier ON organisation_number = CAST(900000000 + s_nationkey AS VARCHAR) GROUP BY 1"""
)
def subunits_of_companies(spark, sf_dir):
    """Numbers and names of a company's subunits; one of the company's own name adds no name."""
    rows = _read(spark, sf_dir, "nation").select((F.lit(900000000) + F.col("n_nationkey")).cast("string").alias("organisation_number"), F.col("n_name").alias("name"))
    s = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = s.select((F.lit(900000000) + F.col("s_nationkey")).cast("string").alias("organisation_number"), (F.lit(800000000) + F.col("s_suppkey")).cast("string").alias("subunit_number"), F.lit("").alias("website"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lower("n_name")).alias("subunit_name"))
    made = profiles.with_subunits(rows, places)
    return made.select("organisation_number", F.array_join("subunit_numbers", ",").alias("numbers"), F.array_join("subunit_names", ",").alias("names"))


@query(
    f"""SELECT {_ORG}, 'post@firma.no' AS email, CASE WHEN c_custkey % 2 = 0 THEN '22334455' ELSE '22334455,99887766' END AS phones, '0150' AS postcode, 'Gata ' || c_custkey AS street FROM customer"""
)
def registry_identifiers(spark, sf_dir):
    """What may tie a site to a company."""
    rows = companies(spark, sf_dir)
    key = F.col("organisation_number").cast("long") - 900000000
    made = profiles.identifiers(rows.select("organisation_number", F.lit(" Post@Firma.no ").alias("email"), F.lit("+47 22 33 44 55").alias("phone"), F.when(key % 2 == 0, "004722334455").otherwise("998 87 766").alias("mobile"), F.array(F.lit("")).alias("subunit_numbers"), F.lit("0150 OSLO").alias("postcode"), F.concat(F.lit("Gata "), key, F.lit("\nEtasje 2")).alias("street")))
    return made.select("organisation_number", "email", F.array_join("phones", ",").alias("phones"), "postcode", "street")


@query(
    f"""SELECT {_ORG}, connector, candidate_url, substr(sha256('{{"candidate_url":' || coalesce('"' || candidate_url || '"', 'null') || ',"company_name":"' || c_name || '","connector":"' || connector || '","municipality":"OSLO","organisation_number":"' || (900000000 + c_custkey) || '","purpose":"' || purpose || '"}}'), 1, 24) AS task_id
    FROM customer, LATERAL (VALUES ('google_places_api', 'resolve_places_and_public_rating', NULL, true), ('licensed_news_search', 'discover_independent_mentions', NULL, true), ('jobs_provider', 'discover_active_jobs', NULL, true),
    ('facebook_connector', 'refresh_verified_profile_metrics', 'https://facebook.com/' || c_custkey, c_custkey % 2 = 0), ('permitted_search_api', 'discover_social_handles', NULL, c_custkey % 2 = 1)) AS t(connector, purpose, candidate_url, yes) WHERE yes"""
)
def external_tasks(spark, sf_dir):
    """Tasks of each company with ids from their content."""
    at = F.col("organisation_number").cast("long") - 900000000
    social = F.when(at % 2 == 0, F.array(F.struct(F.lit("facebook").alias("platform"), F.concat(F.lit("https://facebook.com/"), at).alias("url"))))
    rows = companies(spark, sf_dir).select("organisation_number", "name", F.lit("OSLO").alias("municipality"), social.alias("social_links"))
    return profiles.external_tasks(rows).select("organisation_number", "connector", "candidate_url", "task_id")


@query(f"SELECT {_ORG}, module, replace(url, '%', CAST(900000000 + c_custkey AS VARCHAR)) AS url FROM customer, LATERAL (VALUES ('registry_live', 'https://data.brreg.no/enhetsregisteret/api/enheter/%'), ('roles', 'https://data.brreg.no/enhetsregisteret/api/enheter/%/roller')) AS t(module, url)")
def module_requests(spark, sf_dir):
    """Addresses of the register's modules for each company."""
    return profiles.module_requests(companies(spark, sf_dir), ["registry_live", "roles"])


@query(
    f"""WITH r AS (SELECT {_ORG}, 'Firma ' || c_custkey % 100 AS name FROM customer) SELECT CAST(c_custkey AS BIGINT) AS input_ordinal, CAST(900000000 + c_custkey * 2 AS VARCHAR) AS organisation_number, n AS same_name, CASE WHEN r.name IS NULL THEN 'not_found' ELSE 'available' END AS status
    FROM customer LEFT JOIN r ON r.organisation_number = CAST(900000000 + c_custkey * 2 AS VARCHAR) LEFT JOIN (SELECT name, count(*) AS n FROM r GROUP BY 1) m ON m.name = r.name"""
)
def requested_name_totals(spark, sf_dir):
    """Requested companies with the number of registry rows of their exact name."""
    c = _read(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").cast("long").alias("input_ordinal"), (F.lit(900000000) + F.col("c_custkey") * 2).cast("string").alias("organisation_number"))
    rows = c.select(_org("c_custkey"), F.concat(F.lit(" FIRMA  "), F.col("c_custkey") % 100).alias("name"))
    return profiles.name_totals(asked, rows).select("input_ordinal", "organisation_number", "same_name", "status")


@query(
    """SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, min('https://f.no/nyheter/' || o_orderkey || '/sak') AS url, CAST(3 AS INTEGER) AS depth FROM orders GROUP BY 1"""
)
def deepest_news(spark, sf_dir):
    """The news link of each company whose path is deepest."""
    o = _read(spark, sf_dir, "orders")
    links = F.array(F.concat(F.lit("https://f.no/nyheter/"), "o_orderkey", F.lit("/sak")), F.lit("https://f.no/aktuelt"), F.concat(F.lit("https://f.no/a/b/c/d/"), "o_orderkey"))
    return profiles.deepest_news(o.select(_org("o_custkey"), F.explode(links).alias("url")))


@query("SELECT CAST(c_custkey % 7 AS BIGINT) AS chunk, count(*) AS wanted, count(*) FILTER (c_custkey % 11 <> 0) + count(*) FILTER (c_custkey % 13 = 0 AND c_custkey % 11 <> 0) AS made, count(*) FILTER (c_custkey % 11 = 0) AS missing, count(*) FILTER (c_custkey % 13 = 0 AND c_custkey % 11 <> 0) AS repeated FROM customer GROUP BY 1 HAVING missing > 0 OR repeated > 0")
def chunk_problems(spark, sf_dir):
    """Chunks whose results are not one for each of their companies."""
    c = _read(spark, sf_dir, "customer").select(_org("c_custkey"), (F.col("c_custkey") % 7).cast("long").alias("chunk"), "c_custkey")
    made = c.where("c_custkey % 11 <> 0")
    return refresh.chunk_problems(c, made.unionByName(made.where("c_custkey % 13 = 0")), "chunk").drop("foreign")


@query("SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, module, 'failed' AS status, 'run stopped' AS note FROM customer, LATERAL (VALUES ('registry'), ('website')) AS t(module) WHERE c_custkey % 11 = 0")
def fallback_modules(spark, sf_dir):
    """Companies without a result fail in every module, and say why."""
    c = _read(spark, sf_dir, "customer").select(_org("c_custkey"), "c_custkey")
    return refresh.fallback(c, c.where("c_custkey % 11 <> 0"), ["registry", "website"], "run stopped")


@query("SELECT CAST(o_custkey AS BIGINT) AS c, count(DISTINCT o_orderstatus) = 3 AS complete FROM orders GROUP BY 1")
def complete_profiles(spark, sf_dir):
    """Whether a company has a record of every wanted module; order states stand for modules."""
    modules = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("c"), F.col("o_orderstatus").alias("module"))
    return profiles.complete_for(modules, ["O", "F", "P"], "c")


@query(f"WITH {COMPANIES} SELECT legal_form, CASE WHEN CAST(organisation_number AS BIGINT) % 2 = 0 THEN 'filing_observed' ELSE 'special_rule_or_review_required' END AS obligation, count(*) AS n FROM companies GROUP BY ALL")
def accounting_obligations(spark, sf_dir):
    """Whether companies must file accounts, by legal form."""
    year = F.when(F.col("organisation_number").cast("long") % 2 == 0, "2023")
    return companies(spark, sf_dir).groupBy("legal_form", registry.accounting_obligation(F.col("legal_form"), year).alias("obligation")).agg(F.count("*").alias("n"))
