"""Registry rows: normal form, states, strata, share counts and requested companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import names, urls

#: Columns of a registry snapshot under both of its spellings (fixed values).
COLUMNS = {
    "organisation_number": ("organisasjonsnummer", "Organisasjonsnummer"),
    "name": ("navn", "Navn"),
    "legal_form": ("organisasjonsform_kode", "Organisasjonsform_kode"),
    "municipality": ("forretningsadresse_kommune", "Forretningsadresse_kommune"),
    "municipality_number": ("forretningsadresse_kommunenummer", "Forretningsadresse_kommunenummer"),
    "industry_code": ("naeringskode1_kode", "Næringskode1_kode"),
    "industry_label": ("naeringskode1_beskrivelse", "Næringskode1_beskrivelse"),
    "website": ("hjemmeside", "Hjemmeside"),
    "latest_submitted_accounts": ("sisteInnsendteAarsregnskap", "Siste innsendte årsregnskap"),
}
#: Contract states of evidence statuses (fixed values); anything else has failed.
STATES = {"available": "available", "not_available": "not_available", "not_found": "not_available", "not_applicable": "not_applicable", "blocked": "blocked", "ambiguous": "ambiguous"}
#: Legal forms that must file accounts always, or above thresholds (fixed values).
ALWAYS_OBLIGED = ("AS", "ASA", "BRL", "BBL", "STI", "SF", "VPFO")
THRESHOLD_FORMS = ("ENK", "ANS", "DA", "SA", "FLI", "ESEK", "NUF", "UTLA", "ORGL", "SAM", "SPA", "KS", "BO")


def normalised(raw: DataFrame) -> DataFrame:
    """Twelve typed columns of a registry snapshot whose dotted names were joined by ``_``.

    Empty strings stay empty, a count of employees that is no number is null."""

    def first(*options: str) -> Column:
        there = [F.nullif(F.col(f"`{o}`").cast("string"), F.lit("")) for o in options if o in raw.columns]
        return F.coalesce(*there, F.lit(""))

    return raw.select(
        *[first(*options).alias(name) for name, options in COLUMNS.items()],
        first("antallAnsatte", "Antall ansatte").try_cast("int").alias("employees"),
        (F.lower(first("konkurs", "Konkurs")) == "true").alias("bankrupt"),
        (F.lower(first("underAvvikling", "Under avvikling")) == "true").alias("liquidating"),
    )


def availability(status: Column) -> Column:
    """Contract state of an evidence status; a missing or unknown one has failed."""
    return F.coalesce(*[F.when(status == k, v) for k, v in STATES.items()], F.lit("failed"))


def fetched_status(http: Column) -> Column:
    return F.when(http == 200, "available").when(http.isin(404, 410), "not_found").otherwise("source_error")


def accounting_obligation(legal_form: Column, latest_accounts: Column) -> Column:
    form = F.upper(F.coalesce(legal_form, F.lit("")))
    return (
        F.when(F.coalesce(latest_accounts.cast("string"), F.lit("")) != "", "filing_observed")
        .when(form.isin(*ALWAYS_OBLIGED), "required_by_legal_form")
        .when(form.isin(*THRESHOLD_FORMS), "threshold_or_activity_dependent")
        .otherwise("special_rule_or_review_required")
    )


def employee_band(n: Column) -> Column:
    return F.when(n.isNull(), "missing").when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")


def stratum(form: Column, employees: Column, adverse: Column, website: Column) -> Column:
    short = F.when(form.isin("AS", "ASA", "ENK"), form).otherwise("OTHER")
    return F.concat_ws("|", short, employee_band(employees), F.when(adverse, "adverse").otherwise("active"), F.when(F.coalesce(website, F.lit("")) != "", "web").otherwise("no-web"))


def filer_stratum(form: Column, employees: Column, industry: Column, municipality_number: Column, website: Column) -> Column:
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("missing"))
    return F.concat_ws("|", known(form), employee_band(employees), F.substring_index(known(industry), ".", 1), F.substring(known(municipality_number), 1, 2), F.when(F.coalesce(website, F.lit("")) != "", "web").otherwise("no-web"))


def filer_eligible(latest_accounts: Column, year: str, bankrupt: Column, liquidating: Column) -> Column:
    return (F.coalesce(latest_accounts.cast("string"), F.lit("")) == year) & ~F.coalesce(bankrupt, F.lit(False)) & ~F.coalesce(liquidating, F.lit(False))


def domain_counts(rows: DataFrame, email: str = "email") -> DataFrame:
    """``domain, entities`` of addresses at company-owned domains."""
    domain = urls.email_domain(F.col(email))
    return rows.select(domain.alias("domain")).where((F.col("domain") != "") & ~F.col("domain").isin(*urls.FREE_MAIL)).groupBy("domain").agg(F.count("*").alias("entities"))


def phone_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """``phone, entities``; a row with one phone twice counts once."""
    bare = rows.select(*[names.digits(F.col(c)).alias(c) for c in columns])  # once, as the rule reads them often
    phones = F.array_distinct(F.array(*[names.national(F.col(c)) for c in columns]))
    return bare.select(F.explode(phones).alias("phone")).where("phone <> ''").groupBy("phone").agg(F.count("*").alias("entities"))


def name_counts(rows: DataFrame, name: str = "name") -> DataFrame:
    """``key, entities`` of the order-free name keys."""
    return rows.select(names.name_key(F.col(name)).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("entities"))


def requested(orders: DataFrame, registry: DataFrame, key: str = "organisation_number") -> DataFrame:
    """One row per requested company in input order, with ``status``; an absent one is not found."""
    there = registry.withColumn("_there", F.lit(True))
    return orders.join(there, key, "left").withColumn("status", F.when(F.col("_there"), "available").otherwise("not_found")).drop("_there").orderBy("input_ordinal")


def with_shares(rows: DataFrame, counts: DataFrame, key: str, absent: int) -> DataFrame:
    """``entities`` of each row's ``key``; what no count names has ``absent`` (0 for domains and phones, 1 for names)."""
    return rows.join(counts, key, "left").fillna({"entities": absent})


def having(rows: DataFrame, records: DataFrame, key: str, record_key: str | None = None) -> DataFrame:
    """Rows whose key has a record, each once however many it has; a null key has none."""
    return rows.join(records.select(F.col(record_key or key).alias(key)), key, "left_semi")


def lacking(rows: DataFrame, records: DataFrame, key: str, record_key: str | None = None) -> DataFrame:
    """Rows whose key has no record; a null key has none."""
    return rows.join(records.select(F.col(record_key or key).alias(key)), key, "left_anti")
