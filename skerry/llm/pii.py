"""Personal data in texts, in plain sight and disguised, by offset-preserving deobfuscation.

Plain identifiers are found by the base patterns of PATTERNS.  For disguised
ones a text passes through a chain of transducers, each of which rewrites
some stretches and keeps where they came from:

1. characters: look-alikes of other scripts, full-width and styled forms,
   digits of other scripts become ASCII, invisible characters go;
2. marks: bracketed or escaped at and dot signs;
3. words: ``name at host dot org``, only where a dot of the host is disguised;
4. digits: runs of four or more digits of which some are spelled out.

The same patterns then run over the rewritten text, and what they find is
mapped back, transducer by transducer, to the characters it was written with.
A find is an addition only if it holds a rewritten stretch and does not lie
inside a plain find of its kind.  Every pattern takes time in proportion to
the text, whatever the text: each starts only where a run of its characters
begins, and runs are taken possessively.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import id_and_text, slices, with_id

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_ADDRESS = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@")
_ADDRESS_HERE = re.compile(rf"{_LOCAL}++@")
_DOMAIN = re.compile(rf"{_HOST}++(?:\.{_HOST}++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ODD = bytes.maketrans(b"0123456789", bytes((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
_DIGITS = re.compile("[^0-9]+")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
}
# The digits' names in the languages of the texts, and the words for a sign.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT_NAMES, DOT_NAMES, TIMES = ("at", "arroba", "ät"), ("dot", "punkt", "point", "punto", "ponto"), {"double": 2, "triple": 3}


def _characters() -> dict[str, str]:
    """What each rewritten character stands for: one ASCII character, or nothing."""
    table = dict(LOOKALIKES)
    for a, b in ((0x2000, 0x2070), (0x2070, 0x2100), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in map(chr, range(a, b)):
            if len(plain := unicodedata.normalize("NFKC", c)) == 1 and " " < plain <= "~":
                table[c] = plain
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif unicodedata.category(c) == "Pd":
            table[c] = "-"
        elif unicodedata.category(c) == "Zs":
            table[c] = " "
    table |= dict.fromkeys("­​‌‍⁠﻿᠎", "") | dict.fromkeys("。｡·∙․", ".") | {"−": "-", "﹢": "+", "﹫": "@"}
    return table


CHARACTERS = _characters()
_alternatives = lambda names: "|".join(sorted(map(re.escape, names), key=len, reverse=True))
_MARK = re.compile(
    rf"[\[({{<][ \t]{{0,3}}(?:(?P<at>@|{_alternatives(AT_NAMES)})|\.|{_alternatives(DOT_NAMES)})[ \t]{{0,3}}[\])}}>]"
    r"|(?P<at2>&#0{0,3}64;|&#x0{0,3}40;|&commat;|%40)|&#0{0,3}46;|&#x0{0,3}2e;|&period;|%2e",
    re.IGNORECASE,
)
_GAP = "(?:[ \\t]{1,3}|_)"
_WORD_DOT = rf"{_GAP}(?:{_alternatives(DOT_NAMES)}){_GAP}"
_WORDED = re.compile(rf"(?P<at>@|{_GAP}(?:{_alternatives(AT_NAMES)}){_GAP})(?P<host>[A-Za-z0-9-]++(?:(?:\.|{_WORD_DOT})[A-Za-z0-9-]++)++)", re.IGNORECASE)
_DOTS = re.compile(_WORD_DOT, re.IGNORECASE)
_BEFORE = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}++(?:{_WORD_DOT}{_LOCAL}++){{0,4}}\Z", re.IGNORECASE)
_NAMES = {name: str(d) for names in DIGIT_NAMES.values() for d, name in enumerate(names.split())}
_SPELLED = rf"(?:(?:{_alternatives(TIMES)})[ -])?(?:{_alternatives(_NAMES)})(?![^\W_])"
_ITEM = re.compile(rf"(?P<digits>[0-9]++)|(?:(?P<times>{_alternatives(TIMES)})[ -])?(?P<name>{_alternatives(_NAMES)})(?![^\W_])", re.IGNORECASE)
_BETWEEN = rf"(?:[ \t]{{1,2}}|-|,[ \t]?|\.|{_WORD_DOT})"
_RUN = re.compile(rf"(?:(?<![^\W_])plus[ \t]{{1,2}})?(?<![^\W_])(?:[0-9]++|{_SPELLED})(?:{_BETWEEN}(?:[0-9]++|{_SPELLED})){{3,}}+", re.IGNORECASE)
_HINTS = frozenset(x.encode() for x in (*_NAMES, *DOT_NAMES))
_WORD_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def hinted(text: str) -> bool:
    """Whether a digit's or a dot's name stands in the text as a word; without one, the last two transducers have
    nothing to rewrite."""
    for c in set(text) if not text.isascii() else ():
        if not c.isalnum():
            text = text.replace(c, " ")
    return not _HINTS.isdisjoint(text.lower().encode("utf-8", "replace").translate(_WORD_BREAKS).split())


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers: every second one from the right counts twice."""
    b = digits.encode()[::-1]
    return (sum(b[::2]) - 48 * len(b[::2]) + sum(b[1::2].translate(_ODD))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := _ADDRESS_HERE.match(text, at) or _ADDRESS.search(text, at):
        at = found.end()
        if host := _DOMAIN.match(text, at):
            at = host.end()
            yield found.start(), at


def matches(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of all identifiers written plainly, in code points, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class Rewritten:
    """A text with some stretches replaced, which still knows where everything came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits`` are ``start, end, put`` in order, without overlaps."""
        parts, at, made = [], 0, 0
        self.source_start, self.source_end, self.start, self.end = [], [], [], []
        for a, b, put in edits:
            parts += source[at:a], put
            made += a - at
            for column, value in zip((self.source_start, self.source_end, self.start, self.end), (a, b, made, made + len(put))):
                column.append(value)
            made, at = made + len(put), b
        self.text = "".join([*parts, source[at:]])

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """Where the stretch ``a`` to ``b`` came from, and whether any of it was rewritten."""
        first = bisect.bisect_right(self.end, a)  # the first edit that ends behind a, or at it when nothing was put
        k, m = first - 1, bisect.bisect_left(self.start, b) - 1  # the last edits that end at or before a, and begin before b
        if first < len(self.start) and self.start[first] < a:
            low = self.source_start[first]
        else:
            low = self.source_end[k] + a - self.end[k] if k >= 0 else a
        if m >= 0 and self.end[m] > b:
            high = self.source_end[m]
        else:
            high = self.source_end[m] + b - self.end[m] if m >= 0 else b
        return low, high, m >= first

    def changed(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.end, a)
        return k < len(self.start) and self.start[k] < b


def plain_characters(text: str, _: list[Rewritten]) -> list[tuple[int, int, str]]:
    here = "".join(sorted(CHARACTERS.keys() & set(text))) if not text.isascii() else ""
    return [(*m.span(), CHARACTERS[m[0]]) for m in re.finditer(f"[{re.escape(here)}]", text)] if here else []


def plain_marks(text: str, _: list[Rewritten]) -> list[tuple[int, int, str]]:
    """Bracketed and escaped signs; white space beside brackets goes with them."""
    edits: list[tuple[int, int, str]] = []
    for m in _MARK.finditer(text):
        a, b = m.span()
        if text[a] in "[({<":
            low = max(edits[-1][1] if edits else 0, a - 3)
            while a > low and text[a - 1] in " \t":
                a -= 1
            high = min(len(text), b + 3)
            while b < high and text[b] in " \t":
                b += 1
        edits.append((a, b, "@" if m["at"] or m["at2"] else "."))
    return edits


def plain_words(text: str, before: list[Rewritten]) -> list[tuple[int, int, str]]:
    """Written-out signs of addresses of which a dot behind the at is disguised; a name of over 256 characters
    begins within its last 256."""
    marks = before[-1]
    if not marks.start and not hinted(text):
        return []
    edits: list[tuple[int, int, str]] = []
    for m in _WORDED.finditer(text):
        a, b = m.span("host")
        dots = [d.span() for d in _DOTS.finditer(text, a, b)]
        if not dots and (m["at"] == "@" or not any(marks.changed(k, k + 1) for k in range(a, b) if text[k] == ".")):
            continue
        low = max(edits[-1][1] if edits else 0, m.start() - 256)
        own = _BEFORE.search(text[low : m.start()])
        if own:
            edits += [(low + d.start(), low + d.end(), ".") for d in _DOTS.finditer(text[low : m.start()], own.start())]
            edits += [(*m.span("at"), "@")] * (m["at"] != "@") + [(*d, ".") for d in dots]
    return edits


def plain_digits(text: str, _: list[Rewritten]) -> list[tuple[int, int, str]]:
    """Runs of four or more digits or digit names, of which some are disguised, without what separates names."""
    edits: list[tuple[int, int, str]] = []
    for run in _RUN.finditer(text) if hinted(text) else ():
        items = list(_ITEM.finditer(text, run.start(), run.end()))
        if run[0][0] in "pP":
            edits.append((run.start(), items[0].start(), "+"))
        for k, item in enumerate(items):
            if item["name"]:
                edits.append((*item.span(), _NAMES[item["name"].lower()] * TIMES.get((item["times"] or "").lower(), 1)))
            if k + 1 < len(items):
                a, b = item.end(), items[k + 1].start()
                if any(c.isalpha() for c in text[a:b]):
                    edits.append((a, b, "."))
                elif text[a:b] != "." and (item["name"] or items[k + 1]["name"]):
                    edits.append((a, b, ""))
    return edits


TRANSDUCERS = (plain_characters, plain_marks, plain_words, plain_digits)


def disguised(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, found`` of what the patterns find in the rewritten text and that holds a rewritten
    stretch, in the characters of ``text``; ``found`` is the identifier as rewritten."""
    chain: list[Rewritten] = []
    now, any_edit = text, False
    for rewrite in TRANSDUCERS:
        edits = rewrite(now, chain)
        chain.append(Rewritten(now, edits))
        now, any_edit = chain[-1].text, any_edit or bool(edits)
    out = []
    for a, b, kind in matches(now) if any_edit else ():
        low, high, touched = a, b, False
        for step in reversed(chain):
            low, high, here = step.back(low, high)
            touched |= here
        if touched:
            out.append((low, high, kind, now[a:b]))
    return out


def identifiers(text: str) -> list[tuple[str, int, int, str, bool]]:
    """``kind, start, end, found, base`` of all identifiers of a text, by start, then kind as listed, then end."""
    base = matches(text)
    out = [(kind, a, b, text[a:b], True) for a, b, kind in base]
    out += [(kind, a, b, found, False) for a, b, kind, found in disguised(text) if not any(k == kind and x <= a and b <= y for x, y, k in base)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind string, start long, end long, found string, base boolean>>"


def _found(frames: Iterator[pd.DataFrame], redact: bool) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        spans = [identifiers(t) for t in frame["text"]]
        out = pd.DataFrame({"id": frame["id"].to_numpy(), "spans": [[dict(zip(("kind", "start", "end", "found", "base"), s)) for s in own] for own in spans]})
        if redact:
            out["redacted"] = [redacted(t, own) for t, own in zip(frame["text"], spans)]
        yield out


def redacted(text: str, spans: list[tuple[str, int, int, str, bool]]) -> str:
    """The text with its identifiers replaced by their kind in brackets; overlapping ones by the first one's."""
    parts, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            parts += text[at:a], f"[{kind}]"
        at = max(at, b)
    return "".join([*parts, text[at:]])


def personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: ``id_col, spans`` and, if asked for, ``redacted``.

    ``spans`` are structs ``kind, start, end, found, base`` in code points, end exclusive, by start, kind (email,
    ip, card, phone) and end; ``base`` tells plain finds from disguised ones, ``found`` is the identifier in plain
    characters.  A null text counts as empty and has no spans; repeated rows stay, ids may be null; other
    columns are ignored; an empty table gives an empty result.  Texts of any length are read whole, in time and
    memory in proportion to them."""
    schema = f"id string, spans {_SPANS}" + (", redacted string" if redact else "")
    return with_id(id_and_text(df, id_col, text_col).mapInPandas(functools.partial(_found, redact=redact), schema), df, id_col)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised``: counts and digest of plain finds,
    all spans as text, the number of disguised ones; else as ``personal_data``."""
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    more = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_disguised")
    return personal_data(df, id_col=id_col, text_col=text_col).select(f"`{id_col}`", *counts, digest, joined(F.col("spans")).alias("spans"), more)
