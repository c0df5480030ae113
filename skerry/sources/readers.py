"""Readers of registry snapshots, manifests and saved responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which a document wraps its list of rows, and names of the key column (fixed values).
WRAPPERS = ("_embedded", "enheter", "companies", "organisations", "organizations", "items", "data")
KEYS = ("organisation_number", "organisationnumber", "organisasjonsnummer", "organization_number", "orgnr", "org_nr", "org_number", "orgnumber", "org", "id", "number")


def underscored(df: DataFrame) -> DataFrame:
    """Dotted column names joined by ``_``."""
    return df.toDF(*[c.replace(".", "_").lstrip("﻿") for c in df.columns])


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as ``parent_child`` columns; links are left out and lists are joined by line ends."""
    while nested := [f for f in df.schema.fields if f.dataType.typeName() in ("struct", "array") or f.name in ("links", "_links")]:
        columns = []
        for f in df.schema.fields:
            name = F.col(f"`{f.name}`")
            if f.name in ("links", "_links"):
                continue
            if f.dataType.typeName() == "struct":
                columns += [name[g.name].alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            elif f.dataType.typeName() == "array":
                plain = f.dataType.elementType.typeName() not in ("struct", "array", "map")
                columns.append((F.array_join(name.cast("array<string>"), "\n") if plain else F.to_json(name)).alias(f.name))
            else:
                columns.append(name)
        df = df.select(*columns)
    return df


def registry_csv(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """A CSV snapshot as strings, with ``csv_row_misaligned`` where a row has too few or too many values; extra
    values that are all empty do no harm."""
    head = spark.read.option("sep", separator).option("header", True).csv(path)
    schema = ", ".join(f"`{c}` STRING" for c in head.columns) + ", _bad STRING"
    rows = spark.read.option("sep", separator).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(path)
    cells = F.split("_bad", separator, -1)
    extra = F.slice(cells, len(head.columns) + 1, F.greatest(F.size(cells) - len(head.columns), F.lit(0)))
    harmless = (F.size(cells) > len(head.columns)) & F.forall(extra, lambda x: F.trim(x) == "")
    return underscored(rows.withColumn("csv_row_misaligned", F.col("_bad").isNotNull() & ~F.coalesce(harmless, F.lit(False))).drop("_bad"))


def registry_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array, a wrapped array or JSON lines, flat or nested, as flat columns."""
    df = spark.read.option("multiLine", not lines).json(path)
    while (wrapped := [c for c in df.columns if c in WRAPPERS]) and not set(df.columns) & set(KEYS):
        inner = df.schema[wrapped[0]].dataType
        df = df.select(F.inline(F.col(wrapped[0])) if inner.typeName() == "array" else F.col(f"{wrapped[0]}.*"))
    return flattened(underscored(df))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a batch in file order: ``input_ordinal`` (from 0 without gaps) ``, organisation_number, evaluation_split, sample_slice,
    valid, repeated``.

    One number per line, CSV, JSON lines, or a JSON array or wrapped list of numbers or objects, with the
    number under a known name.  A manifest is the list of one batch, so it is numbered in one task."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("text"))
    wrapped = F.coalesce(*[F.get_json_object("text", f"$.{w}") for w in WRAPPERS], F.col("text"))
    listed = F.from_json(F.when(F.trim(wrapped).startswith("["), wrapped), "array<string>")
    lines = F.split("text", r"\r?\n")
    header = F.transform(F.split(F.lower(F.element_at(lines, 1)), "[,;\t]"), lambda h: F.trim(F.replace(h, F.lit('"'), F.lit(""))))
    each = text.select(F.posexplode(F.coalesce(listed, lines)).alias("_at", "value"), header.alias("_head")).where("trim(value) <> ''")
    cells = F.split("value", "[,;\t]")

    def named(*options: str) -> Column:
        from_json = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in options])
        place = F.array_max(F.array(*[F.array_position("_head", k) for k in options]))
        return F.coalesce(from_json, F.when((place > 0) & ~F.ltrim("value").startswith("{"), F.get(cells, F.when(place > 0, place.cast("int") - 1).otherwise(0))))

    number = F.regexp_replace(F.coalesce(named(*KEYS), F.when(~F.ltrim("value").startswith("{"), F.get(cells, 0))), r"\D", "")
    more = [F.nullif(F.trim(named(k)), F.lit("")).alias(k) for k in ("evaluation_split", "sample_slice")]
    rows = each.select("_at", number.alias("organisation_number"), *more).where("organisation_number <> ''")
    first = F.min("_at").over(Window.partitionBy("organisation_number"))
    ordinal = (F.row_number().over(Window.orderBy("_at")) - 1).cast("long")
    made = rows.withColumns({"input_ordinal": ordinal, "valid": F.length("organisation_number") == 9, "repeated": F.col("_at") != first})
    return made.select("input_ordinal", "organisation_number", "evaluation_split", "sample_slice", "valid", "repeated").orderBy("input_ordinal")


def separator(spark: SparkSession, path: str) -> str:
    """The likeliest separator of a CSV file: of semicolon, comma and tab the one that its first line holds most often."""
    line = (spark.read.text(path).limit(1).first() or [""])[0]
    return max(";,\t", key=line.count)


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a file is compressed, by its first two bytes and not by its name, which is what Spark goes by."""
    head = spark.read.format("binaryFile").load(path).select(F.hex(F.substring("content", 1, 2))).first()
    return bool(head) and head[0] == "1F8B"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry snapshot of any of the known forms: JSON (array, wrapped, lines) or CSV of any separator, whatever the
    name; rows whose number is not of nine characters are left out.

    A compressed file must be named so, as Spark decompresses by name; one that is not raises."""
    first = (spark.read.text(path).where("trim(value) <> ''").limit(1).first() or [""])[0].lstrip("\ufeff \t")
    if first.startswith("\x1f") or (not path.endswith(".gz") and "\ufffd" in first[:4] and is_gzip(spark, path)):
        raise ValueError(f"{path} is compressed but not named .gz")
    if first[:1] in "[{" and first:
        lines = first.startswith("{") and first.rstrip().endswith("}")
        rows = registry_json(spark, path, lines=lines)
    else:
        rows = registry_csv(spark, path, separator(spark, path))
    number = [c for c in rows.columns if c.lower() in KEYS]
    return rows.where(F.length(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in number], F.lit(""))) == 9) if number else rows.limit(0)


def responses(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved responses ``url, status, body`` of requested URLs; one that was not saved has status 0."""
    return requests.join(saved, "url", "left").fillna({"status": 0})
