import json

from pyspark.sql import functions as F

from skerry.functions import names, urls
from skerry.operators import claims, external, matching, registry, reports, run_checks, webpages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_terminal_envelopes_and_checks(spark):
    profiles = spark.createDataFrame([("1",), ("2",), ("3",)], "organisation_number string")
    records = spark.createDataFrame([("1", "registry", "available", None, None, "t1"), ("1", "website", "blocked", "robots.txt", 2, None), ("2", "registry", "not_found", None, None, "t2"), ("3", "registry", "odd", None, None, None), ("3", "website", "blocked", "policy", None, None)], "organisation_number string, module string, status string, note string, retry_count int, retrieved_at string")
    made = run_checks.terminal_envelopes(profiles, records, ["registry", "website"], "r", F.lit("a"), F.lit("z"))
    got = {r["organisation_number"]: (r["state"], {m: (s["state"], s["retry_count"], s["final_timestamp"]) for m, s in r["modules"].items()}) for r in made.collect()}
    assert got["1"] == ("complete", {"registry": ("complete", 0, "t1"), "website": ("blocked_robots", 2, "z")})
    assert got["2"] == ("submission_error", {"registry": ("not_found", 0, "t2"), "website": ("submission_error", 0, "z")})
    assert got["3"][1]["website"][0] == "blocked_policy" and got["3"][0] == "submission_error"
    assert run_checks.batch_checks(made, 3).first().asDict() == {"passed": True, "exact_expected_count": True, "unique_organisation_numbers": True, "all_entity_states_terminal": True, "all_module_states_terminal": True, "zero_silent_drops": True, "invalid_states": 0}
    twice = run_checks.batch_checks(made.union(made.where("organisation_number = '1'")), 4).first()
    assert (twice["passed"], twice["exact_expected_count"], twice["unique_organisation_numbers"], twice["zero_silent_drops"]) == (False, True, False, False)
    assert run_checks.batch_checks(made.withColumn("state", F.lit("running")), 3).first()["all_entity_states_terminal"] is False


def test_warnings(spark):
    records = spark.createDataFrame([(str(k), m, "failed" if k < n else "available", "timeout" if k % 2 else "HTTP 500") for m, n in (("website", 6), ("jobs", 9), ("roles", 0)) for k in range(100)], "organisation_number string, module string, status string, note string")
    limits = spark.createDataFrame([("website", 0.05), ("jobs", 0.10), ("roles", 0.02)], "module string, most double")
    assert [tuple(r) for r in run_checks.module_warnings(records, limits).collect()] == [("website", 0.06, "website: 6.0% failed (top reason: HTTP 500)")]
    streams = [("news_stream", None, 3, 5, None, "late"), ("job_board_stream", None, 5, 5, None, None), ("directory_stream", None, 4, 4, 1, None), ("jobs_feed", "failed", None, None, None, "no token"), ("history_stream", None, 1, 2, 3, None)]
    got = [r["warning"] for r in run_checks.stream_warnings(spark.createDataFrame(streams, "stream string, state string, done int, of int, failed int, note string").coalesce(1)).collect()]
    assert got == ["news_stream: searched 3 of 5 companies (late)", "directory_stream: looked up 4 of 4, 1 failed", "NAV job feed failed: no token", "filing history fetched for 1 of 2 companies", "filing history stream: 3 companies failed with an error"]
    fed = run_checks.stream_warnings(spark.createDataFrame([("jobs_feed", "available", 1, 1, 0, "stopped early")], "stream string, state string, done int, of int, failed int, note string")).collect()
    assert [r["warning"] for r in fed] == ["NAV job feed incomplete: stopped early"]


def test_names_out_of_profiles(spark):
    body = {
        "name": "Nordre Maskin AS",
        "evidence": {
            "website": {"status": "available", "value": {"title": "NM Verk | Forside", "structured_organisations": [{"name": "Nordre Maskin AS"}, {"name": "Velkommen"}, {"name": "NM"}, {"name": "Nordre"}, {"x": 1}, {"name": "NM Verk"}]}},
            "roles": {"value": {"roles": [{"name": "Kari", "role_code": "DAGL"}, {"name": "Per", "role_code": "MEDL"}, {"name": "", "role_code": "LEDE"}, {"name": "Ola", "role_code": "INNH"}]}},
        },
    }
    closed = {"name": "X", "evidence": {"website": {"status": "ambiguous", "value": {"title": "Y Verk"}}}}
    df = spark.createDataFrame([("1", json.dumps(body)), ("2", json.dumps(closed)), ("3", "{}"), ("4", None), ("5", "not json")], "k string, body string")
    got = {r["k"]: (r["aliases"], r["leaders"]) for r in external.profile_names(df).collect()}
    assert got == {"1": (["NM Verk", "Nordre"], ["Kari", "Ola"]), "2": ([], []), "3": ([], []), "4": ([], []), "5": ([], [])}


def test_history_keeps_the_last(spark):
    runs = spark.range(250).selectExpr("CAST(id % 2 AS STRING) AS owner", "id AS at")
    got = run_checks.kept_history(runs, "owner", "at").collect()
    assert sorted((r["owner"], r["place"], r["at"]) for r in got) == sorted((o, k + 1, 250 - 200 + 2 * k + int(o)) for o in "01" for k in range(100))


def test_numbers_and_addresses(spark):
    page = '<meta content="1\xa0234 følgere, 12 innlegg" property="og:description"><meta name="keywords" content="99 followers">'
    assert one(spark, webpages.followers(F.lit(page))) == 1234 and one(spark, webpages.followers(F.lit("<p>5 followers"))) is None
    assert [one(spark, names.clean_number(F.lit(x))) for x in ("1 234", "a", "", None)] == [1234, None, None, None]
    same = [("https://www.a.no/x", "http://a.no", True), ("https://jobb.a.no", "https://a.no", True), ("https://a.no", "https://b.no", False), ("", "", False)]
    assert [one(spark, urls.same_site(F.lit(a), F.lit(b))) for a, b, _ in same] == [x for *_, x in same]
    base = "https://a.no/karriere"
    cases = [(base + "/123", False), (base + "/ledige_stillinger/", True), ("https://a.no/om", True), (base + "/vacancies?x", True)]
    assert [one(spark, webpages.listing_not_ad(F.lit(u), F.lit(base))) for u, _ in cases] == [x for _, x in cases]
    assert one(spark, webpages.employer_on_page(F.lit('{\\"employer\\":{\\"orgnr\\":\\"987654321\\",\\"name\\":\\"Firma AS\\"'))).asDict() == {"organisation_number": "987654321", "name": "Firma AS"}
    assert one(spark, webpages.employer_on_page(F.lit("x"))) is None
    written = "<a href='https://evil.no/firma'>x</a><a href=\"//www.facebook.com/Firma/?ref=1\">y</a>"
    assert one(spark, webpages.link_span(F.lit(written), F.lit("https://facebook.com/firma"))) == '"//www.facebook.com/Firma/?ref=1"'
    assert one(spark, webpages.link_span(F.lit("none"), F.lit("https://facebook.com/firma"))) == "https://facebook.com/firma"
    assert one(spark, webpages.names_inner_page(F.lit("https://a.no/Om-Oss/x"))) and not one(spark, webpages.names_inner_page(F.lit("https://a.no/nyheter")))
    assert one(spark, matching.without_domain(F.lit("Se www.firma.no og Firma AS"), F.lit("firma.no"))).split() == ["Se", "og", "Firma", "AS"]
    assert [one(spark, claims.terminal_status(F.lit(s).cast("string"), F.lit(n))) for s, n in (("available", ""), ("blocked", "Robots"), (None, ""), ("source_error", ""))] == ["complete", "blocked_robots", "submission_error", "source_error"]


def test_semi_and_anti_joins_with_nulls(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    records = spark.createDataFrame([("a",), ("a",), (None,)], "r string")
    assert [r["k"] for r in registry.having(rows, records, "k", "r").collect()] == ["a"]
    assert {r["k"] for r in registry.lacking(rows, records, "k", "r").collect()} == {"b", None}


def test_transfer_and_ranks_with_an_outlier(spark):
    summary = spark.createDataFrame([("base", 50.0, 40.0), ("extension", 40.0, 44.0)], "part string, strict_score_mean double, experimental_score_mean double")
    assert reports.transfer(summary).first().asDict() == {"strict_mean_delta": -10.0, "strict_retention": 0.8, "experimental_mean_delta": 4.0, "experimental_retention": 1.1}
    values = [float(k) for k in range(999)] + [1e12]
    got = reports.nearest_rank(spark.createDataFrame([("a", v) for v in values], "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (got["n"], got["p50"], got["p99"], got["max"]) == (1000, 499.0, 989.0, 1e12)


def test_results_of_saved_searches(spark):
    bodies = ['{"web": {"results": [{"url": "https://a.no", "title": "A", "description": "d"}, "x", {"title": "no address"}, {"url": "https://b.no"}]}}', '{"web": {}}', "{}", "no json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = sorted(tuple(r) for r in matching.search_results(df).collect())
    assert got == [(0, "https://a.no", "A", "d", 1), (0, "https://b.no", "", "", 4)]


def test_batch_report(spark):
    envelopes = spark.createDataFrame([(k, f"c{k}", 10 * k) for k in range(40)], "input_ordinal long, organisation_number string, runtime_ms long")
    modules = spark.createDataFrame([("registry", "available")] * 40 + [("website", "failed")] * 3 + [("website", "available")] * 37, "module string, state string")
    made = spark.createDataFrame([("name", "available")] * 40 + [("revenue", "available"), ("revenue", "not_available")], "field string, availability string")
    problems = spark.createDataFrame([(f"c{k}", p) for k in range(30, 5, -1) for p in ("b", "a")], "organisation_number string, problem string")
    got = reports.batch_report(envelopes, modules, made, problems).first()
    assert (got["envelopes"], got["unique_organisations"], got["runtime_ms_p50"], got["runtime_ms_p95"], got["passed"], got["envelopes_with_problems"]) == (40, True, 200, 380, False, 25)
    assert got["module_states"] == {"registry": {"available": 40}, "website": {"available": 37, "failed": 3}} and got["available_claims"] == {"name": 40, "revenue": 1}
    assert [(p["organisation_number"], p["problems"]) for p in got["problems"]] == [(f"c{k}", ["a", "b"]) for k in range(6, 26)]
    clean = reports.batch_report(envelopes.limit(0), modules.limit(0), made.limit(0), problems.limit(0)).first()
    assert (clean["envelopes"], clean["passed"], clean["problems"], clean["module_states"], clean["runtime_ms_p50"]) == (0, True, [], {}, None)


def test_the_best_hit_of_each_company(spark):
    rows = [("1", "Nordre Maskin AS", "987654321", "Oslo", u, t, s, r) for u, t, s, r in (("https://proff.no/nordre", "Nordre Maskin AS", "987654321", 1), ("https://nordremaskin.no/om", "Nordre Maskin", "org 987654321 Oslo", 2), ("https://x.no", "Annet", "", 3))]
    hits = spark.createDataFrame(rows, "organisation_number string, name string, number string, municipality string, url string, title string, snippet string, rank int").drop("number").withColumn("organisation_number", F.lit("987654321"))
    best = matching.chosen_hit(hits).collect()
    assert [(r["url"].rstrip("/"), r["score"]) for r in best] == [("https://nordremaskin.no/om", 1.0)]


def test_search_domains(spark):
    rows = [("1", u, r) for r, u in enumerate(["https://www.proff.no/x", "https://a.no/1", "https://m.facebook.com/a", "https://a.no/2", "https://b.no", "https://c.no", "https://d.no", ""], 1)] + [("2", "https://finn.no", 1)]
    got = {r["organisation_number"]: r["search_domains"] for r in matching.search_domains(spark.createDataFrame(rows, "organisation_number string, url string, rank int")).collect()}
    assert got == {"1": ["a.no", "b.no", "c.no"], "2": []}
