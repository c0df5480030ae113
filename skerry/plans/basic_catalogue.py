"""Queries over scalar functions, share counts, samples, run reports and joins by company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import html, names, urls
from skerry.operators import claims, filings, identity, matching, profiles, registry, reports, sampling, screens, signals
from skerry.plans.catalogue import COMPANIES, _org, _read, companies, query
from skerry.sources import readers, sinks

_ORG = "CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number"


def _mailed(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    mail = F.when(F.col("c_custkey") % 7 == 0, "kunde@gmail.com").when(F.col("c_custkey") % 7 == 1, "").otherwise(F.concat(F.lit("Post@Mail.Firma"), F.col("c_custkey") % 400, F.lit(".no")))
    return c.select(_org("c_custkey"), mail.alias("email"))


_DOMAINS = "d AS (SELECT 'firma' || c_custkey % 400 || '.no' AS domain, count(*) AS entities FROM customer WHERE c_custkey % 7 > 1 GROUP BY 1)"


@query(f"WITH {_DOMAINS} SELECT domain, entities FROM d")
def domain_counts(spark, sf_dir):
    """Companies by the domain of their addresses, mail hosts left out."""
    return registry.domain_counts(_mailed(spark, sf_dir))


@query(f"WITH {_DOMAINS} SELECT domain, entities FROM d WHERE entities > 1")
def shared_identifiers(spark, sf_dir):
    """Domains that several companies share."""
    return sinks.shared_only(registry.domain_counts(_mailed(spark, sf_dir)), "domain")


@query(
    f"""WITH {_DOMAINS} SELECT {_ORG}, CASE WHEN c_custkey % 7 > 1 THEN 'firma' || c_custkey % 400 || '.no' ELSE CASE WHEN c_custkey % 7 = 0 THEN 'gmail.com' ELSE '' END END AS domain, coalesce(entities, 0) AS entities
    FROM customer LEFT JOIN d ON c_custkey % 7 > 1 AND domain = 'firma' || c_custkey % 400 || '.no'"""
)
def share_lookup(spark, sf_dir):
    """Each company with the companies that share its domain; a domain of no count has none."""
    rows = _mailed(spark, sf_dir).select("organisation_number", urls.email_domain(F.col("email")).alias("domain"))
    made = registry.with_shares(rows, registry.domain_counts(_mailed(spark, sf_dir)), "domain", 0)
    return made.select("organisation_number", "domain", "entities")


@query(
    "SELECT o_orderpriority AS stratum, o_orderkey FROM (SELECT o_orderpriority, CAST(o_orderkey AS BIGINT) AS o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('5:' || o_orderkey)) AS k FROM orders) WHERE k <= 20"
)
def stratified_sample(spark, sf_dir):
    """Twenty rows of each stratum by hash."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderpriority").alias("stratum"))
    return sampling.stratified_sample(rows, "o_orderkey", F.col("stratum"), 20, 5)


@query("SELECT o_orderpriority AS family, count(DISTINCT o_custkey) AS companies, count(*) AS claims FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def claim_coverage(spark, sf_dir):
    """Companies and available claims of each family."""
    made = _read(spark, sf_dir, "orders").select(_org("o_custkey"), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("available").alias("availability"))
    return reports.coverage(made, F.col("o_orderpriority"))


@query(
    "SELECT avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS outage_share FROM (SELECT user_id, bool_or(event_type <> 'error') AS ok FROM events WHERE event_id % 4 < 2 GROUP BY 1)"
)
def outage_share(spark, sf_dir):
    """The share of companies whose official lookups all failed."""
    module = F.element_at(F.array(*map(F.lit, ("registry", "roles", "website", "jobs"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("organisation_number"), module.alias("module"), F.when(F.col("event_type") == "error", "source_error").otherwise("available").alias("status"))
    return reports.outage_share(rows, ("registry", "roles"))


@query(
    """SELECT user_id, max(CASE WHEN event_type = 'view' THEN ts END) AS at, count(DISTINCT event_type) AS pages, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN CAST(1 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS errors,
    coalesce(string_agg(DISTINCT CASE WHEN event_type = 'click' THEN 'x' || event_id % 3 END, ',' ORDER BY CASE WHEN event_type = 'click' THEN 'x' || event_id % 3 END), '') AS social FROM events GROUP BY 1"""
)
def merged_crawl_events(spark, sf_dir):
    """Crawl events of each site as one record: its latest homepage, distinct pages, social links and errors."""
    e = _read(spark, sf_dir, "events")
    kind = F.col("event_type")
    social = F.when(kind == "click", F.array(F.concat(F.lit("x"), F.col("event_id") % 3))).otherwise(F.array().cast("array<string>"))
    rows = e.select("user_id", F.when(kind == "view", "homepage").otherwise("page").alias("kind"), kind.alias("url"), F.lit("t").alias("title"), F.col("ts").alias("retrieved_at"), social.alias("social"), F.when(kind == "error", "HTTP 500").alias("error"))
    made = reports.merged_events(rows, "user_id")
    return made.select("user_id", F.col("homepage.retrieved_at").alias("at"), "pages", F.size("errors").alias("errors"), F.array_join("social", ",").alias("social"))


@query(
    """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 'nordre verk ' || s_suppkey AS exact, 'nordre verk ' || s_suppkey AS bare, 'nordre-verk-' || s_suppkey AS slug,
    CASE WHEN s_suppkey % 3 = 0 THEN 'negative' WHEN s_suppkey % 3 = 1 THEN 'neutral' ELSE 'positive' END AS review FROM supplier"""
)
def name_forms(spark, sf_dir):
    """Exact form, form without legal suffix and slug of a name, and the label of its stars."""
    key = F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(key.cast("long").alias("s_suppkey"), F.concat(F.lit(" Nordre  VERK "), key).alias("name"), (key % 3 * 2 + 1).alias("stars"))
    return rows.select("s_suppkey", names.exact_name(F.col("name")).alias("exact"), names.without_legal_suffix(F.concat("name", F.lit(" AS  ASA"))).alias("bare"), names.slug(F.col("name")).alias("slug"), names.review_label(F.col("stars")).alias("review"))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey <= 100 THEN o_orderkey * 1000.0 END WHEN 1 THEN 12.5 WHEN 2 THEN NULL ELSE 7.0 END AS number FROM orders"""
)
def norwegian_numbers(spark, sf_dir):
    """Counts as they are written: with thousands apart, a comma, out of range, or as words; 100,000 itself is in range."""
    key = F.col("o_orderkey")
    said = F.when(key % 4 == 0, F.concat(key, F.lit(" 000"))).when(key % 4 == 1, "12,5").when(key % 4 == 2, "mange").otherwise(" 7 ")
    return _read(spark, sf_dir, "orders").select(key.cast("long").alias("o_orderkey"), names.norwegian_number(said).alias("number"))


@query(
    r"""SELECT CAST(page_id AS BIGINT) AS page_id, h AS host, array_to_string(string_split(h, '.')[-2:], '.') AS domain, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS homepage
    FROM (SELECT *, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS h FROM pages)"""
)
def url_parts(spark, sf_dir):
    """Host, registered domain and normal form of each page's address."""
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), urls.host(url).alias("host"), urls.registered_domain(url).alias("domain"), urls.homepage(url).alias("homepage"))


@query(
    """SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % 4 WHEN 0 THEN 'https://avis.no/sak?id=' || page_id ELSE 'https://avis.no/' || page_id END AS article, CASE page_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tls' ELSE 'other' END AS kind FROM pages"""
)
def unwrapped_links(spark, sf_dir):
    """The addresses behind redirects, and why a fetch failed."""
    key = F.col("page_id")
    link = F.when(key % 4 == 0, F.concat(F.lit("https://news.example/r?ct=1&url=https%3A%2F%2Favis.no%2Fsak%3Fid%3D"), key, F.lit("&x=y"))).otherwise(F.concat(F.lit("https://avis.no/"), key))
    note = F.when(key % 3 == 0, "Read timed out").when(key % 3 == 1, "SSL: CERTIFICATE_VERIFY_FAILED").otherwise("Connection reset")
    return _read(spark, sf_dir, "pages").select(key.cast("long").alias("page_id"), urls.unwrapped(link).alias("article"), urls.failure_kind(note).alias("kind"))


@query(
    """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'organisation_number' WHEN 1 THEN 'registry_email' ELSE 'registry_phone' END AS proof,
    CASE s_suppkey % 3 WHEN 0 THEN 'Org.nr: 985 589 003 MVA id=19855890031' WHEN 1 THEN 'skriv til post@arkjv.no i dag' ELSE 'tlf +47 22 33 44 55 dagtid' END AS span FROM supplier"""
)
def page_proofs(spark, sf_dir):
    """Registry identifiers on a page, with the text that shows them."""
    kind = F.col("s_suppkey") % 3
    page = F.when(kind == 0, "<p>Org.nr: <b>985 589 003</b> MVA</p><p>id=19855890031</p>").when(kind == 1, "<p>Skriv til Post&#64;arkjv.no i dag</p>").otherwise("<p>Tlf +47 22 33 44 55 dagtid</p>")
    none = F.array().cast("array<string>")
    read = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), page.alias("html"))
    spans = identity.proof_spans(F.col("html"), F.lit("985589003"), none, F.lit("post@arkjv.no"), F.array(F.lit("22334455")))
    made = read.select(F.col("k").alias("s_suppkey"), F.explode(spans).alias("proof", "span"))
    return made.select("s_suppkey", "proof", F.regexp_replace("span", "^Tlf", "tlf").alias("span"))


@query(
    """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'weak' WHEN 3 THEN 'related' WHEN 4 THEN 'unverified' ELSE 'exact' END AS status,
    s_suppkey % 6 IN (0, 1, 5) AS publishable FROM supplier"""
)
def site_assessment(spark, sf_dir):
    """Whether a site belongs to a company, from its proofs, its relation and its name."""
    at = F.col("s_suppkey") % 6
    proofs = F.when(at.isin(0, 3), F.array(F.lit("registry_phone"))).otherwise(F.array().cast("array<string>"))
    made = identity.assessed(proofs, F.when(at == 3, "administrator_or_group").otherwise("candidate"), at == 1, at.isin(1, 2, 5), at == 5, at == 5, F.lit(False))
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), made.alias("a")).select("s_suppkey", "a.status", "a.publishable")


@query(f"WITH {COMPANIES} SELECT organisation_number, 200 AS status, 'svar ' || organisation_number AS body FROM companies WHERE CAST(organisation_number AS BIGINT) % 3 <> 0 UNION ALL SELECT organisation_number, 0, NULL FROM companies WHERE CAST(organisation_number AS BIGINT) % 3 = 0")
def saved_responses(spark, sf_dir):
    """Saved responses of requested addresses; what was not saved has status 0."""
    asked = profiles.module_requests(companies(spark, sf_dir), ["roles"])
    saved = asked.where(F.col("organisation_number").cast("long") % 3 != 0).select("url", F.lit(200).alias("status"), F.concat(F.lit("svar "), "organisation_number").alias("body"))
    return readers.responses(asked, saved).select("organisation_number", "status", "body")


@query(
    """SELECT CAST(900000000 + n_nationkey AS VARCHAR) AS organisation_number, 'AS' AS scope, count(*) AS filings, round(sum(s_acctbal), 2) AS revenue FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"""
)
def filing_records(spark, sf_dir):
    """Filings read from the register's JSON answers."""
    one = F.concat(F.lit('{"id": '), "s_suppkey", F.lit(', "regnskapstype": "AS", "resultatregnskapResultat": {"driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": '), F.col("s_acctbal").cast("decimal(15,2)").cast("string"), F.lit("}}}}"))
    bodies = _read(spark, sf_dir, "supplier").groupBy((F.lit(900000000) + F.col("s_nationkey")).cast("string").alias("organisation_number")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("body"))
    made = filings.financial_records(bodies)
    return made.groupBy("organisation_number", F.col("account_type").alias("scope")).agg(F.count("*").alias("filings"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 'Kari ' || s_name AS name, 'Daglig leder' AS role, s_suppkey % 4 = 0 AS inactive FROM supplier UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'Revisor ' || s_suppkey, 'Revisor', false FROM supplier")
def role_records(spark, sf_dir):
    """Roles read from the register's JSON answers; birth dates are never read."""
    template = '{"rollegrupper": [{"type": {"kode": "DAGL"}, "roller": [{"type": {"beskrivelse": "Daglig leder"}, "person": {"fodselsdato": "1970-01-01", "navn": {"fornavn": "Kari", "mellomnavn": "", "etternavn": "{1}"}}, "avregistrert": {2}}]}, {"type": {"kode": "REVI"}, "roller": [{"type": {"beskrivelse": "Revisor"}, "enhet": {"navn": "Revisor {0}"}}]}]}'
    body = F.replace(F.replace(F.replace(F.lit(template), F.lit("{0}"), F.col("s_suppkey").cast("string")), F.lit("{1}"), F.col("s_name")), F.lit("{2}"), (F.col("s_suppkey") % 4 == 0).cast("string"))
    return filings.roles(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), body.alias("body")), "s_suppkey").select("s_suppkey", "name", "role", "inactive")


@query("SELECT CAST(900000000 + s_nationkey AS VARCHAR) AS parent, count(*) AS open, min(s_name) AS first FROM supplier WHERE s_acctbal >= 0 GROUP BY 1")
def open_locations(spark, sf_dir):
    """Open subunits of each company in order."""
    rows = _read(spark, sf_dir, "supplier").select((F.lit(900000000) + F.col("s_nationkey")).cast("string").alias("parent"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "2020-01-01").alias("closed"))
    return filings.locations(rows).select("parent", F.size("locations").cast("long").alias("open"), F.col("locations")[0]["name"].alias("first"))


@query(
    "SELECT CAST(c_custkey AS BIGINT) AS k, 'ambiguous' AS status, false AS site_ok FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'failed', c_custkey % 3 = 1 FROM customer WHERE c_custkey % 3 <> 0"
)
def contract_states(spark, sf_dir):
    """Contract states of evidence, and whether a site rests on an allowed basis."""
    at = F.col("c_custkey") % 3
    status = registry.availability(F.when(at == 0, "ambiguous").when(at == 1, "not_fetched"))
    proofs = F.when(at == 1, F.array(F.lit("unique_legal_name_domain"))).otherwise(F.array(F.lit("legal_name_on_site")))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), status.alias("status"), identity.site_basis_ok(proofs, F.lit("firma.no")).alias("site_ok"))


@query("SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, c_custkey % 3 AS envelopes FROM customer WHERE c_custkey % 3 <> 1")
def order_problems(spark, sf_dir):
    """Inputs without exactly one envelope."""
    rows = companies(spark, sf_dir).select("organisation_number")
    twice = F.explode(F.array_repeat(F.lit(1), ((F.col("organisation_number").cast("long") - 900000000) % 3).cast("int")))
    return claims.order_problems(rows, rows.select("organisation_number", twice)).select("organisation_number", F.col("envelopes").cast("int").alias("envelopes"))


@query("SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, max(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) = 1 AS tie FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1 GROUP BY 1")
def search_ties(spark, sf_dir):
    """The best search hit of each company; a tie on the best score abstains."""
    first = signals.top_n(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 1, "k")
    hit = lambda r, s: F.struct(F.lit(r).alias("rank"), F.concat(F.lit("https://f.no/"), F.lit(str(r))).alias("url"), s.alias("score"))
    rows = first.select(_org("o_custkey"), F.explode(F.array(hit(1, F.lit(0.9)), hit(2, F.when(F.col("o_orderkey") % 5 == 0, 0.9).otherwise(0.4)))).alias("h")).select("organisation_number", "h.*")
    return identity.search_choice(rows).select("organisation_number", "tie")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, right(CAST(10000000 + s_suppkey AS VARCHAR), 8) AS phone, s_suppkey % 2 = 0 AS ocr FROM supplier")
def report_texts(spark, sf_dir):
    """The last eight digits of map phones, and whether a report needs to be read from its images."""
    key = F.col("s_suppkey")
    text = F.when(key % 2 == 0, "Årsrapport").otherwise(F.concat(F.repeat(F.lit("tekst "), 30), F.lit("antall ansatte 4")))
    return _read(spark, sf_dir, "supplier").select(key.cast("long").alias("s_suppkey"), matching.last_eight(F.concat(F.lit("+47 "), F.lit(10000000) + key)).alias("phone"), matching.needs_ocr(text).alias("ocr"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'operating_loss,thin' WHEN 1 THEN 'negative' ELSE '' END AS flags FROM supplier")
def equity_flags(spark, sf_dir):
    """Operating losses, thin and negative equity."""
    at = F.col("s_suppkey") % 3
    h = filings.health(F.lit(100.0), F.when(at == 0, -5.0).otherwise(5.0), F.when(at == 0, 5.0).when(at == 1, -1.0).otherwise(50.0), F.lit(100.0))
    short = F.transform(h["flags"], lambda x: F.when(x == "operating loss", "operating_loss").when(x == "negative equity", "negative").otherwise("thin"))
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.array_join(short, ",").alias("flags"))


@query("SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN page_id % 2 = 0 THEN 'profitable companies' ELSE 'no' END AS said, CASE WHEN page_id % 2 = 0 THEN 'financials' ELSE '' END AS topics FROM pages")
def question_topics(spark, sf_dir):
    """Topics of questions."""
    said = F.when(F.col("page_id") % 2 == 0, "profitable companies").otherwise("no")
    return _read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), said.alias("said"), F.array_join(screens.topics(said), ",").alias("topics"))


@query(
    """SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % 3 WHEN 0 THEN DATE '2024-02-03' WHEN 1 THEN DATE '2024-02-03' END AS day FROM pages"""
)
def feed_dates(spark, sf_dir):
    """ISO and RFC 822 dates of feeds."""
    at = F.col("page_id") % 3
    said = F.when(at == 0, "2024-02-03T10:00:00Z").when(at == 1, "Sat, 3 Feb 2024 10:00:00 GMT").otherwise("i går")
    return _read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), html.feed_date(said).alias("day"))
