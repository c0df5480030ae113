"""Which website belongs to which company: candidates, proofs and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import html, names, urls

SHARED_FROM = 5
STRONG = ("organisation_number", "subunit_organisation_number", "registry_email", "registry_phone")
GAP = r"[\s.\- ]?"


def candidates(rows: DataFrame, key: str = "organisation_number", full: int = 4, partial: int = 3) -> DataFrame:
    """``key, domain, source, relation, priority``: each domain once, by the first source that names it.

    Rows need ``name, website, email, email_entities`` (companies on the address's domain) and the arrays
    ``subunit_websites, search_domains, directory_domains, employer_homepages, subunit_names``."""
    one = lambda source, domains, relation="candidate": F.transform(domains, lambda d: F.struct(d.alias("domain"), F.lit(source).alias("source"), (relation if isinstance(relation, Column) else F.lit(relation)).alias("relation")))
    mail = urls.email_domain(F.coalesce("email", F.lit("")))
    shared = F.when(F.coalesce("email_entities", F.lit(0)) >= SHARED_FROM, "administrator_or_group").otherwise("candidate")
    rows = rows.withColumns({"_w0": names.words(F.col("name"), 0), "_w1": names.words(F.col("name"), 1)})  # folded once
    rows = rows.withColumn("_labels", names.labels_of(F.col("_w0"), F.col("_w1")))
    labels = F.col("_labels")
    own = F.slice(labels["full"], 1, full)
    ending = lambda list_, suffix: F.transform(list_, lambda x: F.concat(x, F.lit(suffix)))
    registered = lambda list_: F.transform(list_, urls.registered_domain)
    found = F.concat(
        one("registry_website", F.array(urls.registered_domain(F.coalesce("website", F.lit(""))))),
        one("subunit_registry_website", registered(F.col("subunit_websites"))),
        one("registry_email_domain", F.array(F.when(~mail.isin(*urls.FREE_MAIL), mail).otherwise("")), shared),
        one("search_result", F.col("search_domains")),
        one("directory_listing", F.col("directory_domains")),
        one("nav_employer_homepage", registered(F.col("employer_homepages"))),
        one("name_guess", F.concat(ending(own, ".no"), ending(own, ".com"))),
        one("subunit_name_guess", F.flatten(F.transform(F.slice("subunit_names", 1, 3), lambda n: ending(F.slice(names.domain_labels(n)["full"], 1, 2), ".no")))),
        one("name_guess", ending(F.slice(labels["partial"], 1, partial), ".no")),
    )
    each = rows.select(key, F.posexplode(F.filter(found, lambda c: F.coalesce(c["domain"], F.lit("")) != "")).alias("priority", "c")).select(key, "priority", "c.*")
    return first_per(each, [key, "domain"], "priority")


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def digits_pattern(number: Column, country: bool = False) -> Column:
    spaced = F.array_join(F.filter(F.split(number, ""), lambda c: c != ""), GAP)
    return F.concat(F.lit(r"(?<!\d)" + (rf"(?:(?:\+|00)47{GAP})?" if country else "")), spaced, F.lit(r"(?!\d)"))


def span_of(text: Column, pattern: Column, around: int = 60) -> Column:
    """The match with the text around it, without tags; null where there is none."""
    found = F.try_element_at(F.regexp_extract_all(text, F.concat(F.lit(rf"(?s)(.{{0,{around}}}"), pattern, F.lit(rf".{{0,{around}}})")), 1), F.lit(1))
    return F.nullif(F.substring(html.collapsed(F.regexp_replace(found, "<[^>]*>?", " ")), 1, 240), F.lit(""))


def proof_spans(page: Column, organisation: Column, subunits: Column, email: Column, phones: Column) -> Column:
    """Registry identifiers on a page with the text that shows them, as a map of proof to span.

    ``phones`` must leave out phones that many companies share."""
    text = html.unescaped(F.coalesce(page, F.lit("")))
    first = lambda list_, country: F.array_compact(F.transform(list_, lambda n: span_of(text, digits_pattern(n, country))))
    quoted = F.regexp_replace(email, r"([.+*?^$()\[\]{}|\\-])", r"\\$1")
    proofs = {
        "organisation_number": F.when(F.length(organisation) == 9, span_of(text, digits_pattern(organisation))),
        "subunit_organisation_number": F.try_element_at(first(F.filter(subunits, lambda n: (F.length(n) == 9) & (n != organisation)), False), F.lit(1)),
        "registry_email": F.when(email.contains("@"), span_of(F.lower(text), F.concat(F.lit(r"(?<![\w.+-])"), quoted, F.lit(r"(?![\w-])")))),
        "registry_phone": F.try_element_at(first(phones, True), F.lit(1)),
    }
    return F.map_filter(F.create_map(*[x for k, v in proofs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


#: How a page announces an organisation number (fixed pattern).
ANNOUNCED = r"(?i)(?:org(?:anisasjons)?\.?\s*(?:nr|nummer|no|number)\.?|foretaksregisteret|\bNO)\s*[:.]?\s*(\d{3}[\s.]?\d{3}[\s.]?\d{3})(?!\d)"


def foreign_numbers(page: Column, own: Column) -> Column:
    """Nine-digit numbers that a page announces as its operator's, without the company's own."""
    text = html.collapsed(F.regexp_replace(F.coalesce(page, F.lit("")), "<[^>]+>", " "))
    said = F.regexp_extract_all(text, F.lit(ANNOUNCED), 1)
    return F.array_except(F.array_distinct(F.transform(said, lambda n: F.regexp_replace(n, r"\D", ""))), own)


def assessed(proofs: Column, relation: Column, declared: Column, on_site: Column, full_domain: Column, unique: Column, masthead: Column) -> Column:
    """``status, publishable, proofs`` of a candidate site."""
    strong = F.arrays_overlap(proofs, F.array(*map(F.lit, STRONG)))
    told = declared & on_site
    named = unique & full_domain & on_site
    more = F.array_compact(
        F.array(F.when(on_site, "legal_name_on_site"), F.when(told, "registry_declared_website"), F.when(named, "unique_legal_name_domain"), F.when(masthead, "legal_name_masthead"))
    )
    every = F.array_sort(F.array_union(proofs, more))
    status = (
        F.when((relation == "administrator_or_group") & ~(full_domain & (strong | told)), "related")
        .when(strong | told | named | masthead, "exact")
        .when(F.size(every) > 0, "weak")
        .otherwise("unverified")
    )
    return F.struct(status.alias("status"), (status == "exact").alias("publishable"), every.alias("proofs"))


def chosen_sites(checked: DataFrame, key: str = "organisation_number", hosts: int = 4) -> DataFrame:
    """One outcome per company from its checked candidates ``priority, domain, fetched, challenge, status``.

    Only the first ``hosts`` fetched hosts count.  The first exact one is published; else a related or weak
    one leaves the site ambiguous; else a bot challenge fails the check; else there is none."""
    order = Window.partitionBy(key).orderBy("priority")
    seen = checked.withColumn("n", F.sum(F.col("fetched").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("fetched") & (F.col("n") <= hosts))
    rank = reduce(lambda w, x: w.when(x[0], x[1]), [(F.col("status").isin("related", "weak"), 2), (F.col("challenge"), 3)], F.when(F.col("status") == "exact", 1)).otherwise(4)
    best = seen.groupBy(key).agg(F.min_by(F.struct("domain", rank.alias("rank")), F.struct(rank, "priority")).alias("b"))
    outcome = F.when(F.col("b.rank") == 1, "available").when(F.col("b.rank") == 2, "ambiguous").when(F.col("b.rank") == 3, "failed").otherwise("not_available")
    every = checked.select(key).distinct().join(best, key, "left")
    return every.select(key, F.coalesce(outcome, F.lit("not_available")).alias("state"), F.when(F.col("b.rank") == 1, F.col("b.domain")).alias("official_domain"))


def site_basis_ok(proofs: Column, domain: Column) -> Column:
    """Whether a published site rests on a proof that alone suffices."""
    allowed = F.arrays_overlap(proofs, F.array(*map(F.lit, (*STRONG, "registry_declared_website"))))
    local = domain.endswith(".no") | F.arrays_overlap(proofs, F.array(F.lit("registry_address"), F.lit("norway_contact")))
    return F.when(allowed, True).when(F.array_contains(proofs, "unique_legal_name_domain"), local).otherwise(F.array_contains(proofs, "legal_name_masthead"))


def search_choice(scored: DataFrame, key: str = "organisation_number") -> DataFrame:
    """The best search hit of each company; a tie on the best score abstains."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "rank", "url")
    return scored.withColumns({"_k": F.row_number().over(order), "_next": F.lead("score").over(order)}).where("_k = 1").select(key, "url", "score", (F.col("score") == F.col("_next")).alias("tie"))
