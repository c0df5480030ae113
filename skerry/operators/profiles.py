"""Company profiles: entities of the register, overlays that respect what is present, identifiers, subunits, task plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import canonical, names, urls

KEY = "organisation_number"
#: Modules and their addresses at the register (fixed values).
MODULE_URLS = {
    "registry_live": "https://data.brreg.no/enhetsregisteret/api/enheter/{org}",
    "financials": "https://data.brreg.no/regnskapsregisteret/regnskap/{org}",
    "financial_history": "https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/{org}/aar",
    "roles": "https://data.brreg.no/enhetsregisteret/api/enheter/{org}/roller",
    "locations": "https://data.brreg.no/enhetsregisteret/api/underenheter?overordnetEnhet={org}&size=1000",
    "group": "https://data.brreg.no/enhetsregisteret/api/konsernstruktur/{org}",
}
#: Fields of a live entity and where its answer holds them (fixed values).
ENTITY = {
    "organisation_number": "$.organisasjonsnummer", "name": "$.navn", "legal_form": "$.organisasjonsform.kode", "employees": "$.antallAnsatte", "bankrupt": "$.konkurs", "liquidating": "$.underAvvikling",
    "website": "$.hjemmeside", "industry": "$.naeringskode1", "business_address": "$.forretningsadresse", "postal_address": "$.postadresse", "latest_submitted_accounts": "$.sisteInnsendteAarsregnskap",
}


def entities(bodies: DataFrame, column: str = "body", *keep: str) -> DataFrame:
    """One row of named fields for each JSON answer; what it does not say is null, and objects stay JSON."""
    get = lambda p: F.get_json_object(column, p)
    typed = {"employees": "int", "bankrupt": "boolean", "liquidating": "boolean"}
    return bodies.select(*keep, *[(get(p).try_cast(typed[n]) if n in typed else get(p)).alias(n) for n, p in ENTITY.items()])


def module_requests(companies: DataFrame, modules: list[str], key: str = KEY) -> DataFrame:
    """``key, module, url`` of every company and module."""
    made = F.array(*[F.struct(F.lit(m).alias("module"), F.replace(F.lit(MODULE_URLS[m]), F.lit("{org}"), F.col(key)).alias("url")) for m in modules])
    return companies.select(key, F.explode(made).alias("m")).select(key, "m.*")


def overlaid(base: DataFrame, live: DataFrame, columns: list[str], key: str = KEY, present: str = "value") -> DataFrame:
    """``base`` with the columns that the map ``present`` of ``live`` holds; a null that is present overwrites, too."""
    new = live.select(key, F.col(present).alias("_live"))
    has = lambda c: F.coalesce(F.map_contains_key("_live", F.lit(c)), F.lit(False))
    joined = base.join(new, key, "left")
    types = dict(base.dtypes)
    return joined.withColumns({c: F.when(has(c), F.col("_live")[c].cast(types[c])).otherwise(F.col(c)) for c in columns}).drop("_live")


def filled_absent(rows: DataFrame, live: DataFrame, columns: list[str], key: str = KEY, raw: str = "raw") -> DataFrame:
    """``rows`` whose map ``raw`` has the absent ones of some columns from ``live``'s map, and which, as ``filled``.

    A column that is there stays, whatever it holds; one that the live answer lacks becomes empty.  A row
    that has them all, or no live answer, is as it was."""
    new = live.select(key, F.col(raw).alias("_live"))
    wanted = F.array(*map(F.lit, columns))
    absent = F.filter(wanted, lambda c: ~F.map_contains_key(raw, c))
    there = F.col("_live").isNotNull()
    more = F.map_from_arrays(absent, F.transform(absent, lambda c: F.coalesce(F.col("_live")[c], F.lit(""))))
    joined = rows.join(new, key, "left")
    return joined.withColumns({raw: F.when(there, F.map_concat(raw, more)).otherwise(F.col(raw)), "filled": F.when(there, F.array_sort(absent)).otherwise(F.array().cast("array<string>"))}).drop("_live")


def with_subunits(rows: DataFrame, locations: DataFrame, key: str = KEY) -> DataFrame:
    """``rows`` with ``subunit_numbers, subunit_websites, subunit_names``; a subunit of the company's own name adds none.

    ``locations`` has one row for each subunit ``subunit_number, website, subunit_name``."""
    upper = lambda c: F.upper(F.trim(c))
    said = locations.groupBy(key).agg(
        F.array_sort(F.collect_set(F.nullif("subunit_number", F.lit("")))).alias("subunit_numbers"), F.array_sort(F.collect_set(F.nullif("website", F.lit("")))).alias("subunit_websites"),
        F.array_sort(F.collect_set(F.nullif("subunit_name", F.lit("")))).alias("_names"),
    )
    joined = rows.join(said, key, "left").withColumn("subunit_names", F.filter("_names", lambda n: upper(n) != upper(F.coalesce("name", F.lit(""))))).drop("_names")
    none = F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("subunit_numbers", "subunit_websites", "subunit_names")})


def identifiers(rows: DataFrame) -> DataFrame:
    """What may tie a site to a company: number, e-mail, its phones once each, subunits, postcode and first address line.

    Rows have ``organisation_number, email, phone, mobile, subunit_numbers, postcode, street``."""
    mail = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    numbers = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x != "")))
    return rows.select(
        names.digits(F.col(KEY)).alias(KEY), F.when(mail.contains("@"), mail).otherwise("").alias("email"), numbers(F.array(names.phone(F.col("phone")), names.phone(F.col("mobile")))).alias("phones"),
        numbers(F.transform(F.coalesce("subunit_numbers", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"\D", ""))).alias("subunit_numbers"),
        F.substring(names.digits(F.col("postcode")), 1, 4).alias("postcode"), F.trim(F.substring_index(F.coalesce("street", F.lit("")), "\n", 1)).alias("street"),
    )


def verified_observations(observations: DataFrame, companies: DataFrame) -> DataFrame:
    """Observations of known companies with well-formed hashes and an ``id`` from their content; others raise.

    The error names the first one; it is raised when the result is read."""
    known = companies.select(KEY, F.lit(True).alias("_known")).distinct()
    good = F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    joined = observations.join(known, KEY, "left")
    told = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown organisation "), F.coalesce(KEY, F.lit("?"))))).when(~good, F.raise_error(F.concat(F.lit("invalid content hash of "), F.coalesce("source_url", F.lit("?")))))
    made = F.substring(F.sha2(F.concat_ws("|", KEY, "platform", "signal_type", "source_url", "content_sha256"), 256), 1, 24)
    return joined.withColumn("id", F.coalesce(told.cast("string"), made)).drop("_known")


def deepest_news(links: DataFrame, key: str = KEY) -> DataFrame:
    """The news link of each company whose path is deepest, by address where several are."""
    depth = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != ""))
    found = links.where(F.lower(urls.path(F.col("url"))).rlike("news|nyhet|aktuelt|press"))
    return found.groupBy(key).agg(F.min_by("url", F.struct(-depth, "url")).alias("url"), F.max(depth).alias("depth"))


def external_tasks(profiles: DataFrame, key: str = KEY) -> DataFrame:
    """Tasks that external sources are asked: three for each company, one for each social link, or else one search for handles.

    Profiles have ``name, municipality, social_links`` (platform, url); one without number or name has no task."""
    task = lambda connector, purpose, url=None: F.struct(F.lit(connector).alias("connector") if isinstance(connector, str) else connector.alias("connector"), F.lit(purpose).alias("purpose"), (F.lit(None).cast("string") if url is None else url).alias("candidate_url"))
    always = F.array(task("google_places_api", "resolve_places_and_public_rating"), task("licensed_news_search", "discover_independent_mentions"), task("jobs_provider", "discover_active_jobs"))
    linked = F.coalesce("social_links", F.array().cast("array<struct<platform:string,url:string>>"))
    whole = F.filter(linked, lambda s: (F.coalesce(s["platform"], F.lit("")) != "") & (F.coalesce(s["url"], F.lit("")) != ""))
    social = F.transform(whole, lambda s: task(F.concat(s["platform"], F.lit("_connector")), "refresh_verified_profile_metrics", s["url"]))
    search = F.when(F.size(linked) == 0, F.array(task("permitted_search_api", "discover_social_handles"))).otherwise(F.slice(always, 1, 0))
    rows = profiles.where((F.coalesce(key, F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    each = rows.select(F.col(key), F.col("name").alias("company_name"), F.coalesce("municipality", F.lit("")).alias("municipality"), F.explode(F.concat(always, social, search)).alias("t")).select(key, "company_name", "municipality", "t.*")
    fields = {c: F.col(c) for c in (key, "company_name", "municipality", "connector", "purpose", "candidate_url")}
    compact = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), canonical.json_text(fields[n])) for n in sorted(fields)]), F.lit("}"))
    return each.withColumns({"task_id": F.substring(F.sha2(compact, 256), 1, 24), "state": F.lit("pending")})


def complete_for(modules: DataFrame, wanted: list[str], key: str = KEY) -> DataFrame:
    """``key, complete``: whether each company has a record of every wanted module."""
    return modules.groupBy(key).agg((F.count_distinct(F.when(F.col("module").isin(*wanted), F.col("module"))) == len(set(wanted))).alias("complete"))


def name_totals(requested: DataFrame, registry: DataFrame, key: str = KEY) -> DataFrame:
    """Requested companies with ``status`` and the registry rows of their exact name, in one pass over the registry."""
    rows = registry.withColumn("_exact", names.exact_name(F.col("name")))
    totals = rows.groupBy("_exact").agg(F.count("*").alias("same_name"))
    found = requested.join(rows.select(key, "name", "_exact"), key, "left").join(totals, "_exact", "left").drop("_exact")
    return found.withColumn("status", F.when(F.col("name").isNull(), "not_found").otherwise("available")).orderBy("input_ordinal")


def compact(profiles: DataFrame) -> DataFrame:
    """Profiles for a list view: three filings, 30 roles, locations, ten posts and jobs; a site that is not verified is masked."""
    limits = {"filings": 3, "roles": 30, "locations": 30, "posts": 10, "jobs": 10}
    cut = {c: F.slice(c, 1, n) for c, n in limits.items() if c in profiles.columns}
    verified = F.coalesce("site_publishable", F.lit(False))
    return profiles.withColumns(cut | {"website": F.when(verified, F.col("website")), "social_links": F.when(verified, F.col("social_links")).otherwise(F.slice("social_links", 1, 0))})
