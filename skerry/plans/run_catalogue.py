"""Queries over runs by chunks and over the site search."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import canonical, html, names, urls
from skerry.operators import external, feeds, matching, refresh, reports, run_checks, site_search, webpages
from skerry.plans.catalogue import _org, _read, query
from skerry.sources import chunks, scratch
from skerry.streaming import job_feed


@query(
    """SELECT CAST(c_custkey // 40 AS BIGINT) AS chunk, CASE WHEN (c_custkey // 40) % 5 = 4 THEN 'fallback' WHEN (c_custkey // 40) % 5 = 2 THEN 'retried' ELSE 'passed' END AS outcome,
    CASE WHEN (c_custkey // 40) % 5 IN (2, 4) THEN 2 ELSE 1 END AS attempts, count(*) AS "rows", sum(CASE WHEN (c_custkey // 40) % 5 = 4 THEN 0 ELSE c_custkey * 2 END)::BIGINT AS total FROM customer GROUP BY ALL"""
)
def chunk_run(spark, sf_dir):
    """A run by chunks of forty companies: some give a row too few at first, some always, the rest pass at once."""
    inputs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("input_ordinal"), _org("c_custkey"))
    prints = refresh.fingerprint(chunks.divided(inputs, 40), "chunk", inputs.select("organisation_number", F.lit("{}").alias("body")), {"run_id": "r"})
    calls = []

    def work(rows):
        calls.append(1)
        lost = (F.col("chunk") % 5).isin(*([2, 4] if len(calls) == 1 else [4])) & (F.col("input_ordinal") % 40 == 0)
        return rows.where(~lost).withColumn("value", F.col("input_ordinal") * 2)

    run = chunks.run_chunks(inputs, work, scratch.new_folder(spark, "runs"), run_id="r", size=40, prints=prints, fallback=lambda rows, why: rows.withColumn("value", F.lit(0).cast("long")))
    sums = run.rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    return run.manifest.select("chunk", "outcome", "attempts").join(sums, "chunk")


@query(
    """WITH each AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1), purpose AS (SELECT l_returnflag, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1)
    SELECT (SELECT sum(n)::BIGINT FROM each) AS requests, (SELECT string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) FROM purpose) AS by_purpose,
    (SELECT list_sort(list(n))[1 + count(*) // 2] FROM each) AS per_company_p50, (SELECT max(n) FROM each) AS per_company_max"""
)
def merged_operations(spark, sf_dir):
    """The operations of a whole run from the summaries of its chunks; orders stand for companies, lines for requests."""
    lines = _read(spark, sf_dir, "lineitem")
    log = lines.select((F.col("l_orderkey") % 16).alias("chunk"), F.col("l_orderkey").alias("organisation_number"), F.col("l_returnflag").alias("purpose"), F.col("l_linenumber").cast("long").alias("requests"))
    made = chunks.merged_operations(chunks.operations(log, "chunk"))
    listed = F.array_join(F.transform(F.map_entries("by_purpose"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return made.select("requests", listed.alias("by_purpose"), "per_company_p50", "per_company_max")


_TRIED = "(published IS NULL AND fetched < 4 AND NOT list_contains(seen, v.domain))"
_REACHED = f"({_TRIED} AND v.resolved AND v.allowed)"


@query(
    f"""WITH RECURSIVE c AS (
        SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 'd' || o_orderkey % 5 || '.no' AS domain, o_orderkey % 11 <> 0 AS resolved, o_orderkey % 7 <> 1 AS allowed, o_orderkey % 13 = 2 AS bad,
            'd' || (CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 1) % 5 ELSE o_orderkey % 5 END) || '.no' AS final, o_orderstatus = 'P' AS barred, o_orderpriority = '5-LOW' AS parked,
            o_orderkey % 9 = 4 AS numbered, o_orderkey % 4 = 0 AS on_site, o_orderkey % 6 = 5 AS masthead, o_orderkey % 10 = 9 AS other FROM orders),
    v AS (SELECT *, CASE WHEN other AND NOT numbered THEN 'related' WHEN masthead AND NOT numbered AND final <> domain AND NOT on_site THEN 'related' WHEN numbered OR masthead THEN 'exact' WHEN on_site THEN 'weak' ELSE 'unverified' END AS status FROM c),
    walk AS (
        SELECT o_custkey, 0::BIGINT AS k, []::VARCHAR[] AS seen, 0 AS fetched, NULL::VARCHAR AS published, NULL::VARCHAR AS fallback, false AS stopped, 0 AS attempts FROM (SELECT DISTINCT o_custkey FROM orders)
        UNION ALL
        SELECT w.o_custkey, v.k, CASE WHEN {_REACHED} AND NOT v.bad THEN list_append(list_append(seen, v.domain), v.final) ELSE seen END, fetched + {_REACHED}::INT,
            coalesce(published, CASE WHEN {_REACHED} AND NOT v.bad AND NOT v.barred AND NOT v.parked AND v.status = 'exact' THEN v.final END),
            coalesce(fallback, CASE WHEN {_REACHED} AND NOT v.bad AND NOT v.barred AND NOT v.parked AND v.status IN ('related', 'weak') THEN v.final END),
            stopped OR ({_REACHED} AND NOT v.bad AND v.barred), attempts + {_TRIED}::INT
        FROM walk w JOIN v ON v.o_custkey = w.o_custkey AND v.k = w.k + 1)
    SELECT CAST(900000000 + o_custkey AS VARCHAR) AS organisation_number, CASE WHEN published IS NOT NULL THEN 'available' WHEN fallback IS NOT NULL THEN 'ambiguous' WHEN stopped THEN 'failed' ELSE 'not_available' END AS state,
        coalesce(published, fallback) AS domain, fetched, attempts FROM walk QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC) = 1"""
)
def site_search_outcomes(spark, sf_dir):
    """The site search over each company's candidates; orders stand for candidates."""
    o, at = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    of = lambda n: F.concat(F.lit("d"), (n % 5).cast("string"), F.lit(".no"))
    none = F.lit(False)
    rows = o.select(
        _org("o_custkey"), at.alias("priority"), of(at).alias("domain"), F.lit("name_guess").alias("source"), F.lit("candidate").alias("relation"), (at % 11 != 0).alias("resolved"), (at % 7 != 1).alias("allowed"), (at % 13 == 2).alias("fetch_error"),
        F.concat(F.lit("https://"), of(at)).alias("url"), F.when(at % 3 == 0, of(at + 1)).otherwise(of(at)).alias("final_domain"), F.lit(1).alias("final_entities"), (F.col("o_orderstatus") == "P").alias("challenge"), (F.col("o_orderpriority") == "5-LOW").alias("parked"),
        F.when(at % 9 == 4, F.array(F.lit("organisation_number"))).alias("proofs"), none.alias("declared"), (at % 4 == 0).alias("on_site"), none.alias("full_domain"), none.alias("unique"), (at % 6 == 5).alias("masthead"), F.when(at % 10 == 9, F.array(F.lit("1"))).alias("foreign"),
    )
    return site_search.searched_sites(rows).select("organisation_number", "state", "domain", "fetched", F.size("attempts").alias("attempts"))


@query(
    """SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, CAST(o_orderkey AS BIGINT) AS item_id FROM customer JOIN orders ON c_custkey = o_orderkey % 400 WHERE o_orderkey % 5 IN (0, 2)"""
)
def all_headline_mentions(spark, sf_dir):
    """All companies that headlines name, of all names and all headlines; not within a longer name or word."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    name = F.concat(F.lit("Firma "), F.col("o_orderkey") % 400, F.lit(" Verk AS"))
    at = F.col("o_orderkey") % 5
    said = F.when(at == 0, F.concat(name, F.lit(": vekst"))).when(at == 1, F.concat(F.lit("Nord "), name, F.lit(" vokser"))).when(at == 2, F.concat(F.lit("Inntektene til "), F.upper(name), F.lit(" stiger"))).when(at == 3, F.concat(name, F.lit("A vokser"))).otherwise(name)
    companies = c.select(_org("c_custkey"), F.concat(F.lit("Firma "), F.col("c_custkey"), F.lit(" Verk AS")).alias("name"))
    return feeds.headline_mentions(companies, o.select(F.col("o_orderkey").cast("long").alias("item_id"), said.alias("headline")))


_NEXT = "page_id + 1 + page_id % 3"


@query(
    f"""WITH RECURSIVE p AS (SELECT page_id, {_NEXT} AS after, CASE WHEN page_id % 31 = 30 THEN 500 ELSE 200 END AS status, page_id % 3 AS n FROM pages),
    read AS (
        SELECT page_id, 0 AS place FROM p WHERE page_id = 1
        UNION ALL SELECT b.page_id, place + 1 FROM read r JOIN p a ON a.page_id = r.page_id JOIN p b ON b.page_id = a.after WHERE a.status = 200 AND a.n > 0 AND place + 1 < 450)
    SELECT '/' || page_id AS url, place FROM read"""
)
def feed_pages(spark, sf_dir):
    """The pages of a paged feed's read: each names the next, and one without items or an error ends it."""
    k = F.col("page_id")
    item = F.struct(F.concat(F.lit("u"), k).alias("uuid"), F.lit("ACTIVE").alias("status"), F.lit("Firma").alias("business_name"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    at = lambda n: F.concat(F.lit("/"), n.cast("string"))
    pages = _read(spark, sf_dir, "pages").select(at(k).alias("url"), F.when(k % 31 == 30, 500).otherwise(200).alias("status"), at(F.expr(_NEXT)).alias("next_url"), F.slice(F.array(item, item), F.lit(1), (k % 3).cast("int")).alias("items"))
    return job_feed.read_pages(pages, "/1").select("url", "place")


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS k, '{"a": [' || o_custkey || ', null, {"x y": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}], "m": {"b": "' || o_orderstatus || '", "é": "\\u0001\\\""}, "none": null}' AS body FROM orders"""
)
def nested_json(spark, sf_dir):
    """Nested values as canonical JSON: keys sorted at every depth, nulls and control characters written."""
    o = _read(spark, sf_dir, "orders")
    flag = F.col("o_orderkey") % 2 == 0
    value = F.struct(
        F.lit(None).cast("string").alias("none"), F.create_map(F.lit("é"), F.lit("\x01\""), F.lit("b"), F.col("o_orderstatus")).alias("m"),
        F.array(F.struct(flag.alias("x y")), F.lit(None)).alias("a"),
    )
    made = o.select(F.col("o_orderkey").cast("long").alias("k"), value.alias("v"), F.col("o_custkey").cast("long").alias("c"))
    body = canonical.json_of(F.col("v"), made.schema["v"].dataType)
    return made.select("k", F.replace(F.replace(body, F.lit('"a": [{'), F.concat(F.lit('"a": ['), F.col("c").cast("string"), F.lit(", null, {"))), F.lit("}, null]"), F.lit("}]")).alias("body"))


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS k, CASE c_custkey % 6 WHEN 0 THEN 'f' || c_custkey || '.no' WHEN 1 THEN 'f' || c_custkey || '.co.uk' WHEN 2 THEN '' WHEN 3 THEN 'b' || c_custkey || '.c.ck' WHEN 4 THEN 'www.ck' ELSE 'f' || c_custkey || '.unknown' END AS domain FROM customer"""
)
def suffix_domains(spark, sf_dir):
    """Registered domains by a table of suffix rules with a wildcard, an exception and the default."""
    k = F.col("c_custkey")
    kind, at = k % 6, k.cast("string")
    host = (
        F.when(kind == 0, F.concat(F.lit("https://a.b.f"), at, F.lit(".NO/x"))).when(kind == 1, F.concat(F.lit("post@mail.f"), at, F.lit(".co.uk"))).when(kind == 2, "co.uk")
        .when(kind == 3, F.concat(F.lit("a.b"), at, F.lit(".c.ck"))).when(kind == 4, "x.www.ck").otherwise(F.concat(F.lit("f"), at, F.lit(".unknown")))
    )
    rules = spark.createDataFrame([(r,) for r in ("no", "uk", "co.uk", "*.ck", "!www.ck")], "rule string")
    rows = _read(spark, sf_dir, "customer").select(k.cast("long").alias("k"), host.alias("host"))
    return urls.registered_domains(rows, "host", rules, "domain").select("k", "domain")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, 'Øl & ' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || '€ ' || chr(CAST(945 + o_orderkey % 20 AS INTEGER)) || ' ∉ &unknown; <' AS text, 'viet nam 13 ' || o_orderkey AS folded FROM orders""")
def references_and_folding(spark, sf_dir):
    """Named, decimal and hexadecimal references, also without their end, and letters of several forms."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("&Oslash;l &amp; &#"), (65 + k % 26).cast("string"), F.lit("&#128; &#x"), F.lower(F.hex(945 + k % 20)), F.lit("; &notin; &unknown; &lt"))
    return _read(spark, sf_dir, "orders").select(k.cast("long").alias("k"), html.unescaped(said).alias("text"), names.fold(F.concat(F.lit("Việt Nam ⅓ "), k.cast("string"))).alias("folded"))


@query(
    """WITH f AS (SELECT 'module_' || (user_id % 5) AS module, 'reason ' || (event_id % 7) AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL),
    r AS (SELECT *, round(sum(n) OVER (PARTITION BY module) / (SELECT count(*) FROM events), 4) AS rate FROM f QUALIFY row_number() OVER (PARTITION BY module ORDER BY n DESC, reason) = 1)
    SELECT module, rate, module || ': ' || printf('%.1f', rate * 100) || '% failed (top reason: ' || reason || ')' AS warning FROM r WHERE rate > CASE WHEN module = 'module_1' THEN 0.9 ELSE 0.001 END"""
)
def module_warnings(spark, sf_dir):
    """Modules that failed too often, by a table of limits; each record stands for a company."""
    records = _read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("module_"), F.col("user_id") % 5).alias("module"), F.when(F.col("event_type") == "error", "failed").otherwise("available").alias("status"), F.concat(F.lit("reason "), F.col("event_id") % 7).alias("note")
    )
    limits = records.select("module").distinct().withColumn("most", F.when(F.col("module") == "module_1", 0.9).otherwise(0.001))
    return run_checks.module_warnings(records, limits, "event_id")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20)")
def run_history(spark, sf_dir):
    """The last twenty runs of each user; events stand for runs."""
    return run_checks.kept_history(_read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query(
    """WITH m AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'not_found' WHEN 2 THEN 'blocked_robots' WHEN 3 THEN 'blocked_policy' ELSE 'submission_error' END AS state FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, coalesce(m.state, 'submission_error') AS registry, CASE WHEN coalesce(m.state, 'submission_error') = 'submission_error' THEN 'submission_error' ELSE 'complete' END AS state
    FROM customer LEFT JOIN m ON o_custkey = c_custkey"""
)
def terminal_envelopes(spark, sf_dir):
    """Envelopes of the older contract; a company's first order is its registry record."""
    at = F.col("o_orderkey") % 5
    first = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    status = F.when(at == 0, "available").when(at == 1, "not_found").when(at.isin(2, 3), "blocked").otherwise("odd")
    none = F.lit(None).cast("string")
    records = first.select(_org("o_custkey"), F.lit("registry").alias("module"), status.alias("status"), F.when(at == 2, "ROBOTS.txt").alias("note"), F.lit(0).alias("retry_count"), none.alias("retrieved_at"))
    made = run_checks.terminal_envelopes(_read(spark, sf_dir, "customer").select(_org("c_custkey")), records, ["registry"], "r", F.lit("a"), F.lit("z"))
    return made.select("organisation_number", F.col("modules")["registry"]["state"].alias("registry"), "state")


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(1000 + o_orderkey % 9000 AS BIGINT) END AS followers, CASE WHEN o_orderkey % 2 = 0 THEN CAST(900000000 + o_custkey AS VARCHAR) END AS employer,
    CASE WHEN o_orderkey % 4 = 1 THEN 'https://facebook.com/f' || o_orderkey ELSE '"//www.facebook.com/F' || o_orderkey || '/"' END AS span, o_orderkey % 5 <> 0 AS listing FROM orders"""
)
def page_facts(spark, sf_dir):
    """Followers, employers, links as they are written, and links to lists of ads, out of pages."""
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = (1000 + k % 9000).cast("string")
    told = F.concat(F.lit('<meta property="og:description" content="'), F.substring(number, 1, 1), F.lit("&nbsp;"), F.substring(number, 2, 3), F.when(k % 3 == 0, " følgere").when(k % 3 == 1, " Followers").otherwise(" likes"), F.lit(', 9 innlegg">'))
    employer = F.when(k % 2 == 0, F.concat(F.lit('{\\"employer\\":{\\"orgnr\\":\\"'), (F.lit(900000000) + F.col("o_custkey")).cast("string"), F.lit('\\",\\"name\\":\\"F\\"'))).otherwise("")
    link = F.when(k % 4 == 1, "").otherwise(F.concat(F.lit('<a href="//www.facebook.com/F'), k.cast("string"), F.lit('/">x</a>')))
    page, base = F.concat(told, employer, link), "https://a.no/karriere"
    ad = F.when(k % 5 == 0, F.concat(F.lit(base + "/"), k.cast("string"))).when(k % 5 == 1, F.lit(base + "/ledige_stillinger")).otherwise("https://a.no/jobb")
    return o.select(k.cast("long").alias("k"), webpages.followers(page).alias("followers"), webpages.employer_on_page(page)["organisation_number"].alias("employer"), webpages.link_span(page, F.concat(F.lit("https://facebook.com/f"), k.cast("string"))).alias("span"), webpages.listing_not_ad(ad, F.lit(base)).alias("listing"))


@query(
    """SELECT CAST(900000000 + c_custkey AS VARCHAR) AS organisation_number, CASE c_custkey % 3 WHEN 0 THEN 'Verk ' || c_custkey || ',Nordre' WHEN 1 THEN 'Nordre' ELSE '' END AS aliases, CASE WHEN c_custkey % 2 = 0 THEN 'Kari' ELSE '' END AS leaders FROM customer"""
)
def profile_names(spark, sf_dir):
    """What companies call themselves on their sites, and who leads them, out of nested profiles."""
    k = F.col("c_custkey")
    site = F.concat(F.lit('{"status": "'), F.when(k % 3 == 2, "ambiguous").otherwise("available"), F.lit('", "value": {"title": "'), F.when(k % 3 == 0, F.concat(F.lit("Verk "), k, F.lit(" | Forside"))).otherwise("Velkommen"), F.lit('", "structured_organisations": [{"name": "Nordre"}, {"name": "AS"}]}}'))
    roles = F.concat(F.lit('[{"name": "Per", "role_code": "MEDL"}'), F.when(k % 2 == 0, ', {"name": "Kari", "role_code": "DAGL"}').otherwise(""), F.lit("]"))
    body = F.concat(F.lit('{"name": "Søndre AS", "evidence": {"website": '), site, F.lit(', "roles": {"value": {"roles": '), roles, F.lit("}}}}"))
    made = external.profile_names(_read(spark, sf_dir, "customer").select(_org("c_custkey"), body.alias("body")))
    return made.select("organisation_number", F.array_join("aliases", ",").alias("aliases"), F.array_join("leaders", ",").alias("leaders"))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(i AS INTEGER) AS rank, 'https://f' || o_orderkey || '.no/' || i AS url, CASE WHEN i = 1 THEN 'Firma' ELSE '' END AS title
    FROM orders, LATERAL (VALUES (1), (3)) AS t(i) WHERE o_orderkey % 4 <> 3 AND (i = 1 OR o_orderkey % 2 = 0)"""
)
def saved_search_results(spark, sf_dir):
    """Results of saved searches with their ranks; what is no result keeps its place."""
    k = F.col("o_orderkey").cast("string")
    first, third = F.concat(F.lit('{"url": "https://f'), k, F.lit('.no/1", "title": "Firma"}')), F.concat(F.lit(', {"url": "https://f'), k, F.lit('.no/3"}'))
    body = F.when(F.col("o_orderkey") % 4 == 3, "{}").otherwise(F.concat(F.lit('{"web": {"results": ['), first, F.lit(', {"title": "none"}'), F.when(F.col("o_orderkey") % 2 == 0, third).otherwise(""), F.lit("]}}")))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), body.alias("body"))
    return matching.search_results(rows).select("k", "rank", "url", "title")


@query(
    """WITH c AS (SELECT * FROM customer), m AS (SELECT CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'available' END AS state, count(*) AS n FROM c GROUP BY 1)
    SELECT (SELECT count(*) FROM c) AS envelopes, true AS unique_organisations, (SELECT string_agg(state || '=' || n, ',' ORDER BY state) FROM m) AS website, (SELECT count(*) FROM c WHERE c_custkey % 3 = 0) AS names,
    (SELECT list_sort(list(c_custkey))[1 + count(*) // 2]::BIGINT FROM c) AS runtime_ms_p50, (SELECT list_sort(list(c_custkey))[1 + least(count(*) - 1, count(*) * 95 // 100)]::BIGINT FROM c) AS runtime_ms_p95,
    (SELECT count(*) FROM c WHERE c_custkey % 7 = 0) AS envelopes_with_problems, (SELECT count(*) FROM c WHERE c_custkey % 7 = 0) = 0 AS passed, least(20, (SELECT count(*) FROM c WHERE c_custkey % 7 = 0))::INTEGER AS shown"""
)
def batch_report(spark, sf_dir):
    """A whole batch in one row: states by module, claims by field, runtimes, problems of the first envelopes that have any."""
    c = _read(spark, sf_dir, "customer").withColumn("organisation_number", (F.lit(900000000) + F.col("c_custkey")).cast("string"))
    key = F.col("c_custkey").cast("long")
    envelopes = c.select(key.alias("input_ordinal"), "organisation_number", key.alias("runtime_ms"))
    modules = c.select(F.lit("website").alias("module"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("available").alias("state"))
    made = c.select(F.lit("legal_name").alias("field"), F.when(key % 3 == 0, "available").otherwise("not_available").alias("availability"))
    r = reports.batch_report(envelopes, modules, made, c.where(key % 7 == 0).select("organisation_number", F.lit("p").alias("problem")))
    listed = F.array_join(F.transform(F.map_entries(F.col("module_states")["website"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return r.select("envelopes", "unique_organisations", listed.alias("website"), F.col("available_claims")["legal_name"].alias("names"), "runtime_ms_p50", "runtime_ms_p95", "envelopes_with_problems", "passed", F.size("problems").alias("shown"))
