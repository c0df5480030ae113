"""Job feeds and news: latest states, matching to companies, headlines that name them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import names


def latest_state(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key in arrival order; of several with one number, the one of the greatest content."""
    order = Window.partitionBy(key).orderBy(F.col(sequence).desc(), F.xxhash64(*log.columns).desc())
    return log.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def matched_ads(ads: DataFrame, companies: DataFrame) -> DataFrame:
    """Ads ``uuid, business_name, employer`` joined to companies ``organisation_number, name, subunits`` by
    name key and kept where the employer is the company or one of its subunits; ``relation`` says which."""
    a = ads.withColumn("_key", names.name_key(F.col("business_name"))).where("_key <> ''")
    c = companies.withColumn("_key", names.name_key(F.col("name")))
    own = F.col("employer") == F.col("organisation_number")
    part = F.array_contains("subunits", F.col("employer"))
    return a.join(c, "_key").where(own | F.coalesce(part, F.lit(False))).withColumn("relation", F.when(own, "employer").otherwise("subunit_employer")).drop("_key")


def names_company(name: Column, headline: Column) -> Column:
    """Whether a headline names the company itself: its whole name, not within a longer name, and more than it."""

    @F.pandas_udf("boolean")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for wanted, said in batches:
            yield pd.Series([bool(w and s) and headline_names(w, s) for w, s in zip(wanted, said)])

    return told(name, headline)


def headline_names(name: str, headline: str) -> bool:
    wanted, said = " ".join(name.split()), " ".join(headline.split())
    if not wanted or said.lower() == wanted.lower():
        return False
    for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}-]){regex.escape(wanted)}(?![\p{{L}}\p{{N}}-])", said, regex.IGNORECASE):
        before = regex.search(r"(\S+)\s*$", said[: m.start()])
        if not before:
            return True
        last = before[1]
        joins = last.lower() in ("og", "&", "and") and regex.search(r"\p{Lu}\p{L}*\s+\S+\s*$", said[: m.start()])
        if not joins and not regex.match(r"\p{Lu}", last.strip("–-:,«\"'")) or last[-1] in ":.,!?–":
            return True
    return False


def unrepeated_titles(items: DataFrame, key: str, title: str) -> DataFrame:
    """Items whose title the company uses once, whatever its case."""
    return items.withColumn("_n", F.count("*").over(Window.partitionBy(key, F.lower(title)))).where("_n = 1").drop("_n")


#: Headlines of one key that meet its names in one place.
MANY = 50_000
_BREAK = "\x1f"


def tokens(text: Column) -> Column:
    """Words of letters and digits, of one case; what names and headlines share in any case, they share here."""
    return F.regexp_extract_all(F.lower(F.upper(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _keys(words: Column) -> Column:
    """The words and the pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(_BREAK), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def headline_mentions(companies: DataFrame, items: DataFrame, *, key: str = "organisation_number", name: str = "name", item: str = "item_id", headline: str = "headline") -> DataFrame:
    """``key, item``: all companies that headlines name, of all names and all headlines, by ``headline_names``.

    A name is looked for where the rarest of its words and word pairs stands, as counted over the headlines; one
    that has a word which no headline has is looked for nowhere.  Keys of many headlines are dealt to parts, so
    neither side is told to all and no key is in one place.  Repeated rows count once; rows with a null key, item,
    name or headline and names without letters or digits take no part."""
    said = items.where(F.col(item).isNotNull()).select(F.col(item).alias("_item"), F.col(headline).alias("_said")).withColumn("_words", tokens(F.col("_said"))).where("size(_words) > 0").distinct()
    named = companies.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(name).alias("_name")).withColumn("_tokens", tokens(F.col("_name"))).where("size(_tokens) > 0").distinct()
    placed = said.select("_item", "_said", "_words", F.explode(_keys(F.col("_words"))).alias("_k"))
    counts = placed.groupBy("_k").agg(F.count("*").alias("_n"))
    wanted = named.select("_key", "_name", "_tokens", F.explode(_keys(F.col("_tokens"))).alias("_k")).join(counts, "_k", "left")
    rarest = wanted.groupBy("_key", "_name", "_tokens").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_k")).alias("r")).where("r.n > 0")
    parts = F.ceil(F.col("r.n") / MANY).cast("int")
    asked = rarest.select("_key", "_name", "_tokens", F.col("r._k").alias("_k"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    crowded = rarest.where(parts > 1).select(F.col("r._k").alias("_k"), parts.alias("_parts")).distinct()  # fewer than words of headlines by MANY
    dealt = placed.join(F.broadcast(crowded), "_k", "left").withColumn("_part", F.pmod(F.xxhash64("_item"), F.coalesce("_parts", F.lit(1))).cast("int"))
    line = lambda words: F.concat(F.lit(_BREAK), F.array_join(words, _BREAK), F.lit(_BREAK))
    near = dealt.join(asked, ["_k", "_part"]).where(F.contains(line(F.col("_words")), line(F.col("_tokens"))))
    return near.where(names_company(F.col("_name"), F.col("_said"))).select(F.col("_key").alias(key), F.col("_item").alias(item)).distinct()
