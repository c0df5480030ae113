"""Names, phones and amounts, as expressions over built-in functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norwegian legal forms and words that tell no company apart, and letters with two spellings.
LEGAL_FORMS = ("as", "asa", "ans", "da", "enk", "sa", "ba", "nuf", "ks", "bbl", "brl", "sf", "hf", "fli", "spa", "iks", "kf")
FILLERS = ("stiftelsen", "stiftelse", "sameiet", "borettslag", "og", "i", "the", "holding", "norge", "norway", "group", "gruppen")
SPELLINGS = ({"æ": "ae", "ø": "o", "å": "a"}, {"æ": "e", "ø": "o", "å": "aa"})


def _accents() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form has one ASCII letter or digit, these, and the Latin ones that have several."""
    single, several = [], {}
    for code in range(0x80, 0x10000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append((chr(code), plain))
        elif plain and (code < 0x250 or 0x1E00 <= code < 0x1F00 or 0x2150 <= code < 0x2190 or 0x2C60 <= code < 0x2C80 or 0xA720 <= code < 0xA800 or 0xFB00 <= code < 0xFB07):
            several[chr(code)] = plain
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


ACCENTED, PLAIN, SEVERAL = _accents()


def fold(name: Column, spelling: int = 0) -> Column:
    """Lower case in ASCII: Norwegian letters by ``spelling``, other letters as their compatibility form has them without
    accents, one or several; what has none is left out."""
    out = F.lower(name)
    for letter, written in SPELLINGS[spelling].items():
        out = F.replace(out, F.lit(letter), F.lit(written))
    spelt = out
    for letter, written in SEVERAL.items():
        spelt = F.replace(spelt, F.lit(letter), F.lit(written))
    out = F.when(out.rlike("[" + "".join(SEVERAL) + "]"), spelt).otherwise(out)
    return F.regexp_replace(F.translate(out, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def words(name: Column, spelling: int = 0) -> Column:
    return F.filter(F.split(fold(F.replace(name, F.lit("&"), F.lit(" og ")), spelling), "[^a-z0-9]+"), lambda w: w != "")


def distinctive_words(name: Column) -> Column:
    """Words of more than one letter that are no legal form and no filler."""
    return F.filter(words(name), lambda w: (F.length(w) > 1) & ~w.isin(*LEGAL_FORMS, *FILLERS))


def name_key(name: Column) -> Column:
    """The distinctive words once each, sorted: equal for namesakes."""
    return F.array_join(F.array_sort(F.array_distinct(distinctive_words(name))), " ")


def exact_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def without_legal_suffix(name: Column) -> Column:
    """Lower case without the legal forms at the end."""
    return F.regexp_replace(exact_name(name), rf"( ({'|'.join(LEGAL_FORMS)}))+$", "")


def slug(name: Column) -> Column:
    return F.array_join(words(name), "-")


def domain_labels(name: Column) -> Column:
    """Labels that a company of this name may use: ``full`` (all words) and ``partial`` (some), in order."""
    return labels_of(words(name, 0), words(name, 1))


def labels_of(*spelled: Column) -> Column:
    """``domain_labels`` from the words in each spelling; give columns, as the rule reads them often."""
    lists = []
    for found in spelled:
        bare = F.filter(found, lambda w: ~w.isin(*LEGAL_FORMS))
        lists += [F.filter(bare, lambda w: ~w.isin(*FILLERS)), bare]

    def written(parts: list[Column]) -> Column:
        both = F.array(*[F.array_join(p, sep) for p in parts for sep in ("", "-")])
        return F.array_distinct(F.filter(both, lambda x: F.length(x) >= 3))

    full = written(lists)
    pieces = [p for w in lists for p in (F.slice(w, 1, 2), F.when(F.size(w) > 1, F.slice(w, 2, 100)).otherwise(F.array().cast("array<string>")), F.slice(w, 1, 1), F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(w))]
    return F.struct(full.alias("full"), F.array_except(written(pieces), full).alias("partial"))


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")


def phone(value: Column) -> Column:
    """Eight national digits, or empty."""
    return national(digits(value))


def national(d: Column) -> Column:
    """Eight digits of a number without its country code, or empty."""
    d = F.when(d.startswith("0047"), F.substring(d, 5, 30)).when(d.startswith("47") & (F.length(d) == 10), F.substring(d, 3, 30)).otherwise(d)
    return F.when(F.length(d) == 8, d).otherwise("")


def money(amount: Column) -> Column:
    """NOK in billions, millions or thousands with one decimal."""
    size = F.abs(amount)
    scaled = lambda unit, mark: F.concat(F.lit("NOK "), F.replace(F.format_number(amount / unit, 1), F.lit(","), F.lit("")), F.lit(mark))
    return F.when(size >= 1e9, scaled(1e9, "bn")).when(size >= 1e6, scaled(1e6, "m")).when(size >= 1e3, scaled(1e3, "k")).otherwise(F.concat(F.lit("NOK "), F.replace(F.format_number(amount, 0), F.lit(","), F.lit(""))))


def norwegian_number(value: Column) -> Column:
    """A count written with spaces or points between thousands, 0 to 100,000; else null."""
    plain = F.regexp_replace(F.trim(value), r"(?<=\d)[\s. ](?=\d{3}\b)", "")
    n = F.when(plain.rlike(r"^\d+([.,]\d+)?$"), F.expr("1")).isNotNull()
    number = F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n & number.between(0, 100000), number)


def clean_number(value: Column) -> Column:
    """All digits of a text as one number; null without digits."""
    return F.regexp_replace(value, r"\D", "").try_cast("bigint")


def review_label(stars: Column) -> Column:
    return F.when(stars <= 2, "negative").when(stars >= 4, "positive").when(stars.isNotNull(), "neutral")
