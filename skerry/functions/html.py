"""Web pages and feeds, as expressions over built-in functions."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of parked and placeholder pages and of a host's bot check; both count on pages of little text only.
PARKED = (
    r"(?i)(is parked|domain (name )?is for sale|this domain (is|may be) for sale|buy this domain|future home of|is registered,? but|domain has (just )?been registered|parkingcrew|sedoparking|bodis\.com|dan\.com|"
    r"domenet er (til salgs|parkert|registrert)|kjøp (dette )?domenet|dette domenet|domene til salgs|under construction|kommer snart|coming soon|website is (currently )?under)"
)
CHALLENGE = r"(?i)please wait while your request is being verified"
LITTLE_TEXT = 3000
# Fixed patterns of a Norwegian phone, mail address and page language, of what is no text of a page, and of tags.
NO_PHONE = r"(?:\+|00)47[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}(?!\d)"
NO_EMAIL = r"(?i)[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.no\b"
UNREAD, UNSHOWN, TAG = r"(?is)<(script|style|noscript)\b.*?</\1\s*>", r"(?is)<(script|style)\b.*?</\1\s*>", "<[^>]+>"
NO_LANG = r"(?i)<html[^>]*\blang=[\"']?(?:no|nb|nn)(?:[-_][a-z]{2})?[\"'\s>]"


def _numbered() -> dict[str, str]:
    """Numeric references that do not stand for their own character: the standard reads 128 to 159 as Windows-1252,
    knows no null, and leaves out controls and code points that are no characters."""
    out = dict.fromkeys([*range(0x1, 0x9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))], "")
    for code in range(0x80, 0xA0):
        out[code] = bytes([code]).decode("cp1252", "ignore") or chr(code)
    return {str(k): v for k, v in (out | {0: "\ufffd", 0xD: "\r"}).items()}


NUMBERED = _numbered()
def _named() -> dict[str, dict[str, str]]:
    """Named references by their first letter, as maps are looked through one entry after the other."""
    out: dict[str, dict[str, str]] = {}
    for name, char in sorted(html.entities.html5.items(), key=lambda e: (-len(e[0]), e[0])):
        out.setdefault(name[0], {})[name] = char
    return out


NAMED = _named()
#: Names with a semicolon at their end, and the older ones that do without; the longest that fits is meant.
REFERENCE = "(&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|" + "|".join(f"{k}(?:{'|'.join(n[1:] for n in names)})" for k, names in sorted(NAMED.items())) + "))"


#: Stands for a reference while a text is cut; it is no character of any text.
MARK = "\ufdd1"


def _table(entries: dict, kind: str = "map<string,string>") -> Column:
    """A literal map, which is made once for a query."""
    return F.from_json(F.lit(json.dumps(entries)), kind)


def _referred(r: Column) -> Column:
    digits = lambda pattern: F.coalesce(F.nullif(F.substring(F.regexp_extract(r, pattern, 1), 1, 10), F.lit("")), F.lit("0"))
    number = F.when(r.rlike("^&#[xX]"), F.conv(digits("^&#[xX]0*([0-9a-fA-F]*)"), 16, 10)).otherwise(digits("^&#0*([0-9]*)"))
    code = number.cast("bigint")
    odd = F.try_element_at(_table(NUMBERED), number)
    named = F.try_element_at(F.try_element_at(_table(NAMED, "map<string,map<string,string>>"), F.substring(r, 2, 1)), F.substring(r, F.lit(2), F.length(r)))
    plain = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.when(r.startswith("&#"), F.coalesce(odd, plain)).otherwise(named)


def unescaped(text: Column) -> Column:
    """Character references, named and numeric, as the characters that the standard has them stand for, in one pass."""
    plain = F.translate(text, MARK, "\ufffd")  # a split by a pattern would compile it for each row, one by a character does not
    pieces, found = F.split(F.regexp_replace(plain, REFERENCE, MARK), MARK, -1), F.regexp_extract_all(plain, F.lit(REFERENCE), 1)
    whole = F.zip_with(pieces, F.transform(found, _referred), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(whole, "")).otherwise(text)


def collapsed(text: Column) -> Column:
    """One blank for each run of white space of any kind, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def listed(text: Column, references: Mapping[str, str]) -> Column:
    """The listed references as their characters, one reference after the other; all others stay as they are written."""
    for reference, char in references.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def ascii_collapsed(text: Column) -> Column:
    """One blank for each run of ASCII white space, no blank of any kind at the ends; other blanks stay."""
    return F.btrim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(" \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"))


#: How a page's references and its white space are read.
Reading = Callable[[Column], Column]


def visible_text(html: Column, limit: int = 300_000, unescape: Reading = unescaped, collapse: Reading = collapsed) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, " ")
    return F.substring(collapse(unescape(F.regexp_replace(bare, TAG, " "))), 1, limit)


def title(html: Column, unescape: Reading = unescaped, collapse: Reading = collapsed) -> Column:
    return collapse(unescape(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def anchors(html: Column) -> Column:
    """(href, text) of each link in order."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"'>]*[\"'][^>]*>.*?</a>)"), 1)
    return F.transform(
        whole, lambda a: F.struct(F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"'>]*)[\"']", 1).alias("href"), collapsed(unescaped(F.regexp_replace(a, "<[^>]+>", " "))).alias("text"))
    )


def json_ld(html: Column) -> Column:
    """The texts of all JSON-LD scripts that parse."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*[\"']([^\"']*)", 1)


def plain_text(html: Column, collapse: Reading = collapsed) -> Column:
    """Text without scripts and styles, then without tags; entities stay as they are written."""
    return collapse(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSHOWN, " "), TAG, " "))


def said_briefly(text: Column, pattern: str) -> Column:
    """Whether a page's plain text is short and holds the pattern."""
    return (F.length(text) < LITTLE_TEXT) & text.rlike(pattern)


def is_parked(html: Column) -> Column:
    return said_briefly(plain_text(html), PARKED)


def is_challenge(html: Column) -> Column:
    return said_briefly(plain_text(html), CHALLENGE)


def drawn_by_scripts(text: Column, html: Column) -> Column:
    """Little visible text and at least two scripts: the page is drawn by a browser."""
    return (F.length(text) < 100) & (F.regexp_count(F.coalesce(html, F.lit("")), F.lit("(?i)<script")) >= 2)


def needs_scripts(html: Column) -> Column:
    return drawn_by_scripts(visible_text(html), html)


def tied_to_norway(text: Column, html: Column) -> Column:
    """A page that is declared Norwegian, or whose text names a +47 phone or a .no address."""
    return F.coalesce(html, F.lit("")).rlike(NO_LANG) | text.rlike(NO_PHONE) | text.rlike(NO_EMAIL)


def norwegian_tie(html: Column) -> Column:
    return tied_to_norway(visible_text(html), html)


def feed_date(text: Column) -> Column:
    """ISO or RFC 822 dates; a weekday is dropped, as Spark's parser refuses it."""
    iso = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), "d MMM yyyy"))


def feed_items(xml: Column) -> Column:
    """(title, link, published) of RSS items and Atom entries, whatever their prefixes."""
    plain = F.regexp_replace(F.coalesce(xml, F.lit("")), r"<(/?)[A-Za-z0-9]+:", "<$1")
    whole = F.regexp_extract_all(plain, F.lit(r"(?is)<((?:item|entry)\b.*?</(?:item|entry))>"), 1)
    tag = lambda x, name: collapsed(unescaped(F.regexp_replace(F.regexp_extract(x, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"<!\[CDATA\[|\]\]>", "")))
    link = lambda x: F.coalesce(F.nullif(tag(x, "link"), F.lit("")), F.regexp_extract(x, r"(?is)<link\b[^>]*href=[\"']([^\"']+)", 1))
    when = lambda x: F.coalesce(*[F.nullif(tag(x, n), F.lit("")) for n in ("pubDate", "published", "date", "updated")])
    return F.transform(whole, lambda x: F.struct(tag(x, "title").alias("title"), link(x).alias("link"), feed_date(when(x)).alias("published")))
