"""Licence scan by ordered signature rules, in DataFrame functions only.

A text's words, lower-cased, are written with one space between and around
them, and rules are regular expressions over words.  A document whose text
holds none of the gate's stems goes no further.  Elsewhere each rule whose
keyword the words hold is matched at all places: its matches are marked in the
text, and one cut at spaces tells their places, so the work grows with the
text and not with the matches.

Detections are resolved by priority, one after the other: a match stays if it
overlaps none of those of better priority that stay, and among matches of one
priority the leftmost stays, then the longest (which contains the others),
then the earlier rule.  A match that is thrown out suppresses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.license_rules import GATE_STEMS, RULES

#: The base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words before and after lower-casing A-Z are the same ones.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: First word, negative length, rule, priority, label, relevance, end: natural order is leftmost, longest, earliest.
MATCH = "struct<s:int,l:int,n:int,p:int,label:string,score:double,e:int>"
NOTHING = f"cast(array() AS array<{MATCH}>)"
#: Matches that one step of the sweep takes; its array of kept ones is copied for each of them.
CHUNK = 128


def _by_keyword(rules: list[tuple]) -> str:
    """SQL: an array of (keyword, rules), so that each keyword is looked for once."""
    groups: dict[str, list[str]] = {}
    for n, (p, label, keyword, pattern, score) in enumerate(rules):
        groups.setdefault(keyword, []).append(f"struct({n} AS n, {p} AS p, '{label}' AS label, ' ({pattern})(?= )' AS rx, {score}D AS score)")
    return "array(" + ", ".join(f"struct(' {k} ' AS keyword, array({', '.join(r)}) AS rules)" for k, r in groups.items()) + ")"


def _matches(rules: list[tuple]) -> str:
    """SQL: all matches of the rules whose keyword the words ``t`` hold.

    Begin and end of each match are marked by two characters that no word holds; of the words with a
    mark, the k-th begin and the k-th end belong together."""
    places = "filter(transform(w, (x, i) -> IF(contains(x, '{0}'), i, -1)), i -> i >= 0)"
    spans = f"arrays_zip({places.format(chr(1))} AS b, {places.format(chr(2))} AS f)"
    made = "struct(z.b - 1 AS s, z.b - z.f - 1 AS l, r.n AS n, r.p AS p, r.label AS label, r.score AS score, z.f AS e)"
    one = f"""flatten(transform(
        transform(filter(array(regexp_replace(t, r.rx, ' {chr(1)}$1{chr(2)}')), m -> contains(m, '{chr(1)}')), m -> split(m, ' ')),
        w -> transform({spans.replace(' AS b', '').replace(' AS f', '')}, z -> {made.replace('z.b', "z['0']").replace('z.f', "z['1']")})))"""
    return f"flatten(transform(flatten(filter({_by_keyword(rules)}, g -> contains(t, g.keyword)).rules), r -> {one}))"


def _chunks(hits: str) -> str:
    return f"transform(sequence(0, cast((size({hits}) - 1) / {CHUNK} AS int)), c -> slice({hits}, c * {CHUNK} + 1, {CHUNK}))"


def _swept(hits: str) -> str:
    """SQL: of sorted matches, those that begin where the last one that stays has ended."""
    inner = """aggregate(chunk, struct(acc.last AS last, {nothing} AS got),
        (a, m) -> IF(m.s >= a.last, struct(m.e AS last, array_append(a.got, m) AS got), a),
        a -> struct(a.last AS last, array_append(acc.parts, a.got) AS parts))"""
    step = inner.format(nothing=NOTHING)
    return f"aggregate({_chunks(hits)}, struct(0 AS last, cast(array() AS array<array<{MATCH}>>) AS parts), (acc, chunk) -> {step}, acc -> flatten(acc.parts))"


def resolved(hits: str, priorities: tuple[int, ...]) -> str:
    """SQL: the matches of an array of MATCH that stay, in order of place."""
    # a word taken by a match that stays is true in ``taken``, which ends with the last of them
    taken = """flatten(transform(kept, (m, i) -> concat(
        array_repeat(false, m.s - IF(i = 0, 0, get(kept, i - 1).e)), array_repeat(true, m.e - m.s))))"""
    free = "NOT exists(sequence(m.s, m.e - 1), k -> coalesce(get(taken, k), false))"
    level = f"filter(hits, m -> m.p = p AND {free})"
    merged = f"""transform(array({taken}), taken -> transform(array({level}), open ->
        IF(size(open) = 0, kept, array_sort(concat(kept, {_swept('open')})))))[0][0]"""
    return f"""transform(array(array_sort({hits})), hits -> aggregate(
        filter(array({', '.join(map(str, priorities))}), p -> exists(hits, m -> m.p = p)), {NOTHING}, (kept, p) -> {merged}))[0]"""


def _gate(low: Column, raw: Column) -> Column:
    held = raw.rlike(r"(?i)cc[^0-9a-z]+by")
    for stem in GATE_STEMS[::-1]:
        held = low.contains(stem) | held
    return held


def license_detections(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, base, kept``: words of the whole text, all places of base phrases, and the
    detections that stay, as arrays of MATCH.

    One output row per input row.  A null text counts as empty; other columns are ignored; repeated rows
    stay; an empty table gives an empty result.  A narrow projection without shuffle or Python."""
    base = [(0, label, phrase.split()[0], phrase, 1.0) for phrase, label in BASE]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    text = text.select("id", "text", F.lower("text").alias("low"))
    words = text.select(
        "id",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(_gate(F.col("low"), F.col("text")), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", upper, lower), SEPARATORS, " ")), F.lit(" "))).alias("t"),
    )
    found = words.selectExpr("id", "n_words", f"CASE WHEN t IS NULL THEN {NOTHING} ELSE {_matches(base)} END AS base", f"CASE WHEN t IS NULL THEN {NOTHING} ELSE {_matches(list(RULES))} END AS hits")
    kept = resolved("hits", tuple(sorted({r[0] for r in RULES})))
    return found.selectExpr(f"id AS `{id_col}`", "n_words", "base", f"CASE WHEN size(hits) = 0 THEN {NOTHING} ELSE {kept} END AS kept")


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``license_detections`` in scalar columns: ``id_col, n_words, n_base, first_word, last_word,
    base_labels, labels, score``; texts without a detection have empty labels and score 0."""
    return license_detections(df, id_col=id_col, text_col=text_col).selectExpr(
        f"`{id_col}`",
        "n_words",
        "cast(size(base) AS long) AS n_base",
        "cast(array_min(base.s) AS long) AS first_word",
        "cast(array_max(base.s) AS long) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, kept.label))), ',') AS labels",
        "coalesce(array_max(kept.score), 0D) AS score",
        "cast(size(kept) AS long) AS n_detections",
    )
