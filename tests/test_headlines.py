import random

from pyspark.sql import functions as F

from skerry.operators import external, feeds


def test_all_names_against_all_headlines_equal_brute_force(spark, monkeypatch):
    r = random.Random(1)
    words = ["Nord", "Sør", "Bygg", "og", "Maskin", "Verk", "AS", "A/S", "B&B", "x-ray", "Øl", "1", "Åse", "ß"]
    said = words + ["vokser", "i", "dag:", "–", "Kjøper", "«Nord", "verk.", "STRASSE", "maskin", "øl"]
    names = [(str(k), " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for k in range(120)] + [("e", ""), ("n", None), ("p", "&"), (None, "Nord")]
    heads = [(k, " ".join(r.choice(said) for _ in range(r.randint(1, 9)))) for k in range(300)] + [(900, None), (901, ""), (None, "Nord")]
    heads += [(1000 + k, "I dag vokser Nord Bygg AS") for k in range(100)]  # one key with many headlines
    wanted = sorted((c, i) for c, n in names for i, h in heads if c is not None and i is not None and n and n != "&" and h and feeds.headline_names(n, h))
    companies = spark.createDataFrame(names + names[:5], "organisation_number string, name string")
    items = spark.createDataFrame(heads + heads[:5], "item_id long, headline string").withColumn("_k", F.lit("x"))
    assert wanted
    for many in (50_000, 20):
        monkeypatch.setattr(feeds, "MANY", many)
        assert sorted(map(tuple, feeds.headline_mentions(companies, items).collect())) == wanted
    assert feeds.headline_mentions(companies.limit(0), items).collect() == []


def test_news_records(spark):
    companies = spark.createDataFrame([("1", "Nordre Maskin AS", None), ("2", "Søndre Verk AS", None), ("3", "AS", "too short")], "organisation_number string, name string, reason string")
    items = spark.createDataFrame([("https://www.avis.no/1", "Vekst i Nordre Maskin AS i år"), ("https://www.avis.no/2", "Vekst i Søndre Verk AS i år")], "url string, headline string")
    page = '<meta property="article:published_time" content="2024-03-0{0}"><h1>{1}</h1>'
    pages = spark.createDataFrame([("https://www.avis.no/1", page.format(1, "Vekst i Nordre Maskin AS i år")), ("https://www.avis.no/2", page.format(2, "Noe helt annet"))], "url string, html string")
    got = {x["organisation_number"]: x for x in external.news_mentions(companies, items, pages, F.lit("2024-06-01").cast("date")).collect()}
    assert [got[k]["state"] for k in "123"] == ["available", "not_available", "not_applicable"]
    assert [(i["title"], i["publisher"]) for i in got["1"]["items"]] == [("Vekst i Nordre Maskin AS i år", "avis.no")] and got["3"]["note"] == "too short"
