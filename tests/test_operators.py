import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skerry.functions import canonical, html, names, urls
from skerry.operators import claims, feeds, filings, identity, refresh, registry, reports, sampling, screens, signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "name, key", [("Bjørn & Åse Maskin AS", "ase bjorn maskin"), ("Café Éole Holding", "cafe eole"), ("AS", ""), ("Ølve ØLVE AS", "olve"), (None, None)]
)
def test_name_key(spark, name, key):
    assert one(spark, names.name_key(text(name))) == key


@pytest.mark.parametrize("raw, phone", [("+47 22 33 44 55", "22334455"), ("0047 22334455", "22334455"), ("4722334455", "22334455"), ("123", ""), (None, "")])
def test_phone(spark, raw, phone):
    assert one(spark, names.phone(text(raw))) == phone


@pytest.mark.parametrize("amount, written", [(2.5e9, "NOK 2.5bn"), (-1.26e6, "NOK -1.3m"), (1500.0, "NOK 1.5k"), (12.0, "NOK 12")])
def test_money(spark, amount, written):
    assert one(spark, names.money(F.lit(amount))) == written


def test_domain_labels(spark):
    r = one(spark, names.domain_labels(F.lit("Nordre Ås Maskin AS")))
    assert r["full"][:2] == ["nordreasmaskin", "nordre-as-maskin"] or r["full"][0].startswith("nordre")
    assert not set(r["full"]) & set(r["partial"])


@pytest.mark.parametrize(
    "url, domain, key", [("https://www.Firma.no/om/", "firma.no", "firma.no/om"), ("firma.no", "firma.no", "firma.no"), ("http://a.b.co.uk:80/x?y", "b.co.uk", "a.b.co.uk/x"), ("post@Firma.no", "firma.no", None), ("", "", "")]
)
def test_urls(spark, url, domain, key):
    assert one(spark, urls.registered_domain(F.lit(url))) == domain
    if key is not None:
        assert one(spark, urls.site_key(F.lit(url))) == key


def test_social_keeps_case_of_channels_only(spark):
    assert one(spark, urls.canonical_social(F.lit("https://YouTube.com/channel/AbC"), F.lit("youtube"))) == "https://youtube.com/channel/AbC"
    assert one(spark, urls.canonical_social(F.lit("https://Facebook.com/Firma"), F.lit("facebook"))) == "https://facebook.com/firma"


def test_html(spark):
    page = "<html lang='nb'><title> A &amp; B </title><script>x</script><body>Hei <a href='/om'>Om  oss</a> org.nr 985 589 003</body>"
    assert one(spark, html.title(F.lit(page))) == "A & B"
    assert one(spark, html.visible_text(F.lit(page))).endswith("Hei Om oss org.nr 985 589 003")
    assert [tuple(r) for r in one(spark, html.anchors(F.lit(page)))] == [("/om", "Om oss")]
    assert one(spark, html.norwegian_tie(F.lit(page))) is True
    assert one(spark, identity.foreign_numbers(F.lit(page), F.array(F.lit("999999999")))) == ["985589003"]
    assert one(spark, html.is_parked(F.lit("<p>This domain is for sale"))) is True
    assert one(spark, html.visible_text(text(None))) == ""


def test_feed_items(spark):
    rss = "<rss><item><title><![CDATA[A & B]]></title><link>https://x.no/1</link><pubDate>Tue, 03 Feb 2026 10:00:00 GMT</pubDate></item></rss>"
    atom = "<feed xmlns:a='x'><a:entry><a:title>C</a:title><a:link href='https://x.no/2'/><a:updated>2026-02-04T00:00:00Z</a:updated></a:entry></feed>"
    assert [(r["title"], r["link"], str(r["published"])) for r in one(spark, html.feed_items(F.lit(rss)))] == [("A & B", "https://x.no/1", "2026-02-03")]
    assert [(r["title"], r["link"], str(r["published"])) for r in one(spark, html.feed_items(F.lit(atom)))] == [("C", "https://x.no/2", "2026-02-04")]


def test_evidence_id_is_the_hash_of_canonical_json(spark):
    entry = {"source_url": "https://x.no", "source_class": "reg", "retrieved_at": None, "content_sha256": "ab", "claim_span": 'navn: "Ås"'}
    wanted = "ev-" + hashlib.sha256(json.dumps(entry, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    assert one(spark, canonical.evidence_id(*[text(entry[k]) for k in ("source_url", "source_class", "retrieved_at", "content_sha256", "claim_span")])) == wanted


@pytest.mark.parametrize(
    "query, filters, sort",
    [
        ("companies in Oslo with more than 20 employees", [("municipality", "eq", "OSLO"), ("employees", ">", 20)], None),
        ("legal form AS revenue over 1,000,000 top 5 by revenue", [("legal_form", "eq", "AS"), ("revenue", ">", 1e6)], ("revenue", 5)),
        ("at least NOK 2.5 million revenue", [("revenue", ">=", 2.5e6)], None),
        ("unprofitable companies with a website and accounts", [("annual_result", "<", 0), ("website", "present", True)], None),
        ("companies in Oslo top 500 by employees", [("municipality", "eq", "OSLO")], ("employees", 100)),
    ],
)
def test_screen_grammar(query, filters, sort):
    plan = screens.parse(query)
    assert [(f.name, f.operator, f.value) for f in plan.filters][: len(filters)] == filters and plan.sort == sort and plan.executable


def test_screen_abstains_and_missing_numbers_never_match(spark):
    rows = spark.createDataFrame([("1", None), ("2", 0), ("3", 50)], "organisation_number string, employees int")
    assert [r[0] for r in screens.screen(rows, "fewer than 10 employees").collect()] == ["2"]
    assert screens.screen(rows, "top 3 by employees with linkedin").count() == 0
    assert [r[0] for r in screens.screen(rows, "top 3 by employees").collect()] == ["3", "2", "1"]


FILED = "organisation_number string, record_id string, account_type string, period_end string, revenue double"


def test_latest_filing_rules_differ(spark):
    rows = spark.createDataFrame([("1", "a", "SELSKAP", "2023-12-31", 5.0), ("1", "b", "KONSERN", "2024-12-31", 9.0), ("1", "c", "SELSKAP", "2022-12-31", None), ("2", "d", "KONSERN", "2024-12-31", 1.0)], FILED)
    assert {r["organisation_number"]: r["record_id"] for r in filings.listed_first(rows).collect()} == {"1": "b", "2": "d"}
    got = {r["organisation_number"]: r for r in filings.latest_in_scope(rows).collect()}
    assert got["1"]["latest"]["record_id"] == "a" and got["1"]["previous"]["record_id"] == "c" and got["1"]["previous"]["revenue"] is None
    assert got["2"]["latest"]["record_id"] == "d" and got["2"]["previous"] is None


def test_financial_records_and_roles(spark):
    body = json.dumps([{"id": 1, "regnskapstype": "SELSKAP", "regnskapsperiode": {"tilDato": "2024-12-31"}, "resultatregnskapResultat": {"aarsresultat": 0, "driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": 10}}}}])
    r = filings.financial_records(spark.createDataFrame([("1", body), ("2", "{}")], "organisation_number string, body string")).collect()
    assert len(r) == 1 and r[0]["annual_result"] == 0 and r[0]["revenue"] == 10 and r[0]["equity"] is None
    body = json.dumps({"rollegrupper": [{"type": {"kode": "STYR"}, "roller": [{"type": {"kode": "LEDE"}, "person": {"fodselsdato": "1970-01-01", "navn": {"fornavn": "A", "etternavn": "B"}}}, {"enhet": {"navn": "Firma"}, "avregistrert": True}]}]})
    r = filings.roles(spark.createDataFrame([("1", body)], "organisation_number string, body string")).collect()
    assert [(x["name"], x["inactive"]) for x in r] == [("A B", False), ("Firma", True)] and "1970" not in str(r)


@pytest.mark.parametrize("a, b, kind", [(100.0, 150.0, "up"), (100.0, 100.1, "flat"), (-5.0, 5.0, "turned to profit"), (-5.0, -2.0, "loss narrowed"), (0.0, 0.0, None), (None, 1.0, None)])
def test_change_kind(spark, a, b, kind):
    assert one(spark, filings.change_kind(F.lit(a).cast("double"), F.lit(b), False)) == kind


def test_registry_states_strata_and_normal_form(spark):
    raw = spark.createDataFrame([("1", "A", "AS", "", "TRUE"), ("2", "B", "", "7", None)], "organisasjonsnummer string, navn string, organisasjonsform_kode string, antallAnsatte string, konkurs string")
    got = registry.normalised(raw).orderBy("organisation_number").collect()
    assert got[0]["employees"] is None and got[0]["bankrupt"] and got[1]["employees"] == 7 and not got[1]["bankrupt"]
    assert one(spark, registry.stratum(F.lit("AS"), F.lit(12), F.lit(False), F.lit("x"))) == "AS|5-19|active|web"
    assert [one(spark, registry.availability(text(s))) for s in ("available", "not_found", "source_error", None)] == ["available", "not_available", "failed", "failed"]
    assert one(spark, registry.accounting_obligation(F.lit("enk"), text(None))) == "threshold_or_activity_dependent"


def test_page_proofs(spark):
    page = "<p>Org.nr: 985 589 003 MVA, ring +47 22 33 44 55 eller post&#64;arkjv.no</p>"
    spans = one(spark, identity.proof_spans(F.lit(page), F.lit("985589003"), F.array().cast("array<string>"), F.lit("post@arkjv.no"), F.array(F.lit("22334455"))))
    assert set(spans) == {"organisation_number", "registry_email", "registry_phone"} and "985 589 003" in spans["organisation_number"]
    none = one(spark, identity.proof_spans(F.lit("id=19855890031"), F.lit("985589003"), F.array().cast("array<string>"), F.lit("post@arkjv.no"), F.array(F.lit("22334455"))))
    assert not none


@pytest.mark.parametrize("proofs, relation, declared, status", [(["registry_email"], "candidate", False, "exact"), ([], "candidate", True, "exact"), (["registry_email"], "administrator_or_group", False, "related"), ([], "candidate", False, "weak")])
def test_assessed(spark, proofs, relation, declared, status):
    p = F.array(*map(F.lit, proofs)).cast("array<string>")
    no = F.lit(False)
    assert one(spark, identity.assessed(p, F.lit(relation), F.lit(declared), F.lit(True), no, no, no))["status"] == status


def test_candidates_first_source_wins(spark):
    rows = spark.createDataFrame([("1", "Fjord Maskin AS", "https://www.fjord.no", "post@fjord.no", 9, [], ["fjord.no", "x.no"], [], [], [])], "organisation_number string, name string, website string, email string, email_entities int, subunit_websites array<string>, search_domains array<string>, directory_domains array<string>, employer_homepages array<string>, subunit_names array<string>")
    got = {r["domain"]: (r["source"], r["relation"]) for r in identity.candidates(rows).collect()}
    assert got["fjord.no"] == ("registry_website", "candidate") and got["x.no"][0] == "search_result" and got["fjordmaskin.no"][0] == "name_guess"


def test_refresh(spark):
    schema = "organisation_number string, employees int, years array<string>"
    old = spark.createDataFrame([("1", 5, ["2023"]), ("2", None, None)], schema)
    new = spark.createDataFrame([("1", 6, ["2023"]), ("2", None, ["2024"])], schema)
    got = refresh.changes(old, new, ["employees", "years"]).orderBy("organisation_number").collect()
    assert [(r["field"], r["old_value"], r["new_value"]) for r in got] == [("employees", "5", "6"), ("years", None, '["2024"]')]
    assert refresh.changes(new, new, ["employees", "years"]).count() == 0
    site = "organisation_number string, site_status string, site_url string"
    a = spark.createDataFrame([("1", "available", "https://www.x.no/"), ("2", "available", "https://a.no"), ("3", "available", "https://a.no")], site)
    b = spark.createDataFrame([("1", "available", "http://x.no"), ("2", "failed", None), ("3", "not_available", None)], site)
    assert [r[0] for r in refresh.site_changes(a, b).collect()] == ["3"]
    assert {r["organisation_number"]: r["site_url"] for r in refresh.carried(a, b).collect()} == {"1": "http://x.no", "2": "https://a.no", "3": None}


@pytest.mark.parametrize("headline, named", [("Midt-Norsk Maskin AS er konkurs", False), ("Nord Norsk Maskin AS vokser", False), ("Norsk Maskin ASA kjøper", False), ("Inntektene til Norsk Maskin AS stiger", True), ("Norsk Maskin AS: Her er regnskapet", True), ("Norsk Maskin AS", False), ("", False)])
def test_headlines(headline, named):
    assert feeds.headline_names("NORSK MASKIN AS", headline) is named


def test_matched_ads(spark):
    ads = spark.createDataFrame([("a", "Fjord Maskin", "111111111"), ("b", "Fjord Maskin", "222222222"), ("c", "Fjord Maskin", "333333333")], "uuid string, business_name string, employer string")
    firms = spark.createDataFrame([("111111111", "FJORD MASKIN AS", ["222222222"])], "organisation_number string, name string, subunits array<string>")
    assert {r["uuid"]: r["relation"] for r in feeds.matched_ads(ads, firms).collect()} == {"a": "employer", "b": "subunit_employer"}


def test_claims(spark):
    c = spark.createDataFrame([("1", "a", None, "available", "e1", None), ("1", "financials.revenue", "5", "available", "e9", None), ("1", "b", "x", "failed", None, None)], "organisation_number string, field string, value string, availability string, evidence_id string, period_end string")
    e = spark.createDataFrame([("1", "e1", "https://x.no", "")], "organisation_number string, evidence_id string, source_url string, retrieved_at string")
    got = {r["problem"] for r in claims.claim_problems(c, e).collect()}
    assert got == {"a: available claim without a value", "financials.revenue: dangling evidence id", "financials.revenue: financial claim without reporting period", "b: unavailable claim carries a value", "e1: evidence without source_url or retrieved_at"}


def test_label_scores_and_percentiles(spark):
    gold = spark.createDataFrame([("1", "positive"), ("2", "negative"), ("3", "positive")], "id string, label string")
    said = spark.createDataFrame([("1", "positive"), ("2", "positive")], "id string, label string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in signals.label_scores(gold, said).collect()}
    assert got["positive"] == (2, 0.5, 0.5) and got["mixed"] == (0, 0.0, 0.0)
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "k string, v double")
    assert tuple(reports.indexed_percentiles(df, ["k"], "v").first())[1:] == (20, 11.0, 20.0)
    assert reports.nearest_rank(df, ["k"], "v", {"p95": 0.95}).first()["p95"] == 19.0


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a = [r[0] for r in sampling.hash_sample(df, "k", 20, 3).collect()]
    b = [r[0] for r in sampling.hash_sample(df.orderBy(F.rand(1)), "k", 20, 3).collect()]
    assert a == b == sorted(map(str, range(500)), key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())[:20]
