"""Canonical JSON (sorted keys, nulls kept, spaced separators) and content hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType


def json_text(value: Column) -> Column:
    """A scalar as JSON; null is written."""
    one = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(one, F.lit(2), F.length(one) - 2), F.lit("null"))


def _text(value: Column) -> Column:
    """A string as JSON; control characters in lower-case hexadecimal."""
    made = json_text(value)
    for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
        made = F.replace(made, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    # an escaped backslash before a u spells no control character, so only what follows an even number of them is one
    return F.when(value.rlike(r"[\x00-\x1f]"), made).otherwise(json_text(value))


def _number(value: Column) -> Column:
    """A double with its shortest digits, in exponents from 1e16 on and below 1e-4."""
    size = F.abs(value)
    full, fewer = value.cast("string"), F.format_string("%.15e", value)
    # with an exponent one digit stands before the point, between 1e-3 and 1e7 there is none; older Java writes a digit too many at times
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(fewer, "0+e", "e"), r"\.e", ".0e"), "e[+]?(-?)0*([0-9])", "E$1$2")
    written = F.when(full.contains("E") & (F.length(F.regexp_replace(full, "E.*|[^0-9]", "")) > 16) & (fewer.try_cast("double") == value), trimmed).otherwise(full)
    digits, power = F.regexp_extract(written, r"^-?([0-9.]+)", 1), F.coalesce(F.nullif(F.regexp_extract(written, "E(-?[0-9]+)$", 1), F.lit("")), F.lit("0")).cast("int")
    sign = F.when(written.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(F.replace(digits, F.lit("."), F.lit("")), "0+$", "")  # one digit before the point where there is an exponent
    scaled = F.when(
        power > 0, F.when(F.length(bare) > power + 1, F.concat(F.substring(bare, F.lit(1), power + 1), F.lit("."), F.substring(bare, power + 2, F.length(bare)))).otherwise(F.concat(F.rpad(bare, power + 1, F.lit("0")), F.lit(".0")))
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare))
    short = F.when(F.length(bare) > 1, F.concat(F.substring(bare, 1, 1), F.lit("."), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)
    spelt = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    plain = F.when(power == 0, written).otherwise(F.concat(sign, F.when((size >= 1e16) | (size < 1e-4), spelt).otherwise(scaled)))
    return F.when(F.isnan(value), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(plain)


def json_of(value: Column, kind: DataType) -> Column:
    """Any value as canonical JSON by its type: keys of structs and maps sorted, nulls written, ``", "`` and ``": "`` between.

    Built from expressions all the way down, as deep as the type goes.  Maps need string keys; a type that JSON
    does not know is written as Spark writes it."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_of(value.getField(f.name), f.dataType)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, MapType):
        each = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(_text(e["key"]), F.lit(": "), json_of(e["value"], kind.valueType)))
        made = F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))
    elif isinstance(kind, ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (DoubleType, FloatType)):
        made = _number(value.cast("double"))
    else:
        made = _text(value) if isinstance(kind, StringType) else json_text(value)
    return F.when(value.isNull(), "null").otherwise(made)


def json_rows(df: DataFrame) -> Column:
    """Each row of a table as one canonical JSON object."""
    parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_of(F.col(f"`{f.name}`"), f.dataType)) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def canonical_json(fields: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f'"{k}": '), json_text(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def evidence_id(source_url: Column, source_class: Column, retrieved_at: Column, content_sha256: Column, claim_span: Column, **more: Column) -> Column:
    """Content address of a citation; ``more`` holds fields that are present in every row."""
    fields = {"source_url": source_url, "source_class": source_class, "retrieved_at": retrieved_at, "content_sha256": content_sha256, "claim_span": claim_span} | more
    return F.concat(F.lit("ev-"), F.substring(F.sha2(canonical_json(fields), 256), 1, 16))
