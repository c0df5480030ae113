"""Annual accounts: normal form, latest and previous filing, comparison and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a register's answer holds each measure (fixed values).
PATHS = {
    "revenue": "$.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter",
    "operating_result": "$.resultatregnskapResultat.driftsresultat.driftsresultat",
    "profit_before_tax": "$.resultatregnskapResultat.ordinaertResultatFoerSkattekostnad",
    "annual_result": "$.resultatregnskapResultat.aarsresultat",
    "assets": "$.eiendeler.sumEiendeler",
    "equity": "$.egenkapitalGjeld.egenkapital.sumEgenkapital",
    "debt": "$.egenkapitalGjeld.gjeldOversikt.sumGjeld",
}
GROUP = "KONSERN"


def financial_records(body: DataFrame, key: str = "organisation_number", column: str = "body") -> DataFrame:
    """One row per filing of a JSON array of filings; an answer that is no array has none."""
    item = F.explode(F.from_json(column, "array<string>")).alias("item")
    get = lambda p: F.get_json_object("item", p)
    return body.select(key, item).select(
        key, get("$.id").alias("record_id"), get("$.regnskapstype").alias("account_type"), get("$.regnskapsperiode.fraDato").alias("period_start"),
        get("$.regnskapsperiode.tilDato").alias("period_end"), get("$.valuta").alias("currency"), *[get(p).try_cast("double").alias(m) for m, p in PATHS.items()],
    )


def newest_first(*keys: str):
    """Order of a company's filings: newest period first, its own accounts before the group's."""
    return Window.partitionBy(*keys).orderBy(F.coalesce("period_end", F.lit("")).desc(), F.when(F.col("account_type") == GROUP, 1).otherwise(0), "record_id")


def listed_first(records: DataFrame, key: str = "organisation_number") -> DataFrame:
    """The first filing in the register's order, whatever its scope: what screens use."""
    return records.withColumn("_k", F.row_number().over(newest_first(key))).where("_k = 1").drop("_k")


def latest_in_scope(records: DataFrame, key: str = "organisation_number") -> DataFrame:
    """Each company's latest filing of one scope (its own accounts, the group's only if alone) as the
    ``latest`` struct, and the newest of strictly earlier periods as ``previous``."""
    fields = [c for c in records.columns if c != key]
    own = F.max(F.coalesce(F.col("account_type"), F.lit("")) != GROUP).over(Window.partitionBy(key))
    pool = records.withColumn("_own", own).where(~F.col("_own") | (F.coalesce("account_type", F.lit("")) != GROUP)).drop("_own")
    end = F.coalesce("period_end", F.lit(""))
    ranked = pool.withColumn("_end", F.max(end).over(Window.partitionBy(key))).withColumn("_rec", F.struct(end.alias("_e"), *fields))
    return ranked.groupBy(key).agg(
        F.max_by("_rec", F.struct(end, F.coalesce("record_id", F.lit("")))).dropFields("_e").alias("latest"),
        F.max_by(F.when((end < F.col("_end")) & (end != ""), F.col("_rec")), F.when((end < F.col("_end")) & (end != ""), F.struct(end, F.coalesce("record_id", F.lit(""))))).dropFields("_e").alias("previous"),
    )


def change_kind(before: Column, now: Column, signed: bool) -> Column:
    """How a figure moved; ``signed`` figures (results) have no share of change."""
    both = before.isNotNull() & now.isNotNull() & ~((before == 0) & (now == 0))
    share = (now - before) / F.nullif(before, F.lit(0.0))
    moved = F.when(F.abs(share) < 0.005, "flat").when(share > 0, "up").otherwise("down")
    ratio = (before > 0) & (now >= 0) & F.lit(not signed)
    rest = (
        F.when(before == now, "unchanged")
        .when((before < 0) != (now < 0), F.when(before < 0, "turned to profit").otherwise("turned to loss"))
        .when((before < 0) & (now < 0), F.when(now > before, "loss narrowed").otherwise("loss widened"))
        .otherwise(F.when(now > before, "up").otherwise("down"))
    )
    return F.when(both, F.when(ratio, moved).otherwise(rest))


def health(revenue: Column, operating: Column, equity: Column, assets: Column) -> Column:
    """Operating margin, equity ratio and the flags that follow; null where a figure is missing."""
    margin = F.when(revenue > 0, operating / revenue)
    ratio = F.when(assets > 0, equity / assets)
    flags = F.array_compact(
        F.array(
            F.when(margin.isNotNull() & (operating < 0), "operating loss"),
            F.when(ratio.isNotNull() & (equity < 0), "negative equity").when(ratio < 0.1, "thin equity (under 10% of assets)"),
        )
    )
    return F.struct(margin.alias("operating_margin"), ratio.alias("equity_ratio"), flags.alias("flags"))


def filed_years(years: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(years.cast("array<string>"), lambda y: y.rlike(r"^\d+$"))))


def history(bodies: DataFrame, key: str = "organisation_number", column: str = "years") -> DataFrame:
    """``key, years, documents``: filed years in order, and the address of each year's document, the newest first."""
    of = lambda y: F.concat(F.lit("https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/"), F.col(key), F.lit("/"), y)
    made = bodies.select(key, filed_years(F.col(column)).alias("years"))
    return made.withColumn("documents", F.transform(F.reverse("years"), lambda y: F.struct(y.alias("year"), of(y).alias("url"))))


def roles(body: DataFrame, key: str = "organisation_number", column: str = "body") -> DataFrame:
    """One row per role of a register's answer; birth dates are not read."""
    shape = (
        "rollegrupper array<struct<sistEndret string, type struct<kode string, beskrivelse string>, roller array<struct<type struct<kode string, beskrivelse string>, "
        "person struct<navn struct<fornavn string, mellomnavn string, etternavn string>>, enhet struct<organisasjonsnummer string, navn string>, avregistrert boolean>>>>"
    )
    grouped = body.select(key, F.explode(F.from_json(column, shape)["rollegrupper"]).alias("g"))
    each = grouped.select(key, "g", F.explode("g.roller").alias("r"))
    given = [F.nullif(F.col(f"r.person.navn.{p}"), F.lit("")) for p in ("fornavn", "mellomnavn", "etternavn")]
    return each.select(
        key, F.coalesce(F.nullif(F.concat_ws(" ", *given), F.lit("")), F.col("r.enhet.navn")).alias("name"), F.col("r.enhet.organisasjonsnummer").alias("role_organisation"),
        F.col("r.type.kode").alias("role_code"), F.col("r.type.beskrivelse").alias("role"), F.col("g.type.kode").alias("group_code"), F.col("g.type.beskrivelse").alias("role_group"),
        F.col("g.sistEndret").alias("last_changed"), F.coalesce("r.avregistrert", F.lit(False)).alias("inactive"),
    )


def locations(subunits: DataFrame, parent: str = "parent") -> DataFrame:
    """Open subunits of each company as one sorted array."""
    fields = [c for c in subunits.columns if c not in (parent, "closed")]
    return subunits.where(F.col("closed").isNull()).groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("locations"))
