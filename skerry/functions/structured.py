"""Structured data in pages: JSON-LD nodes, microdata items, and links made absolute.

These are small pandas UDFs, as recursion over JSON and tags of any depth and the rules of relative links
have no built-in form; all else works on their columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
NODE = "array<struct<kinds:array<string>,listed:boolean,node:string>>"


def _walk(value, listed: bool, found: list) -> None:
    """Every object in document order; ``listed`` ones are reached by lists, graphs and item lists alone."""
    if isinstance(value, list):
        for child in value:
            _walk(child, listed, found)
    elif isinstance(value, dict):
        kinds = value.get("@type")
        kinds = [str(k) for k in (kinds if isinstance(kinds, list) else [kinds]) if k is not None]
        found.append((kinds, listed, json.dumps(value, ensure_ascii=False)))
        for key, child in value.items():
            if key == "itemListElement" and listed:
                items = child if isinstance(child, list) else [child]
                _walk([i.get("item", i) if isinstance(i, dict) else i for i in items], True, found)
            else:
                _walk(child, listed and key == "@graph", found)


def nodes_of(html: str | None) -> list:
    found: list = []
    for text in _SCRIPT.findall(html or ""):
        try:
            _walk(json.loads(text), True, found)
        except ValueError:
            continue
    return found


#: Elements that have no end, and attributes that hold a property's value in place of its text (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
VALUES = ("content", "datetime", "href", "src")


class Items(HTMLParser):
    """Microdata items of a page as dicts of each property's first value, in document order."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.tags: list[str] = []
        self.items: list[tuple[int, dict]] = []  # depth and item
        self.texts: list[tuple[int, dict, str, list[str]]] = []  # depth, item, property, pieces

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        name = given.get("itemprop", "").split()
        if name and self.items and "itemscope" not in given:
            item, value = self.items[-1][1], next((given[v] for v in VALUES if v in given), None)
            if value is not None:
                item.setdefault(name[0], value)
            elif tag not in VOID:
                self.texts.append((len(self.tags), item, name[0], []))
        if "itemscope" in given:
            item = {"@type": given.get("itemtype", "").rstrip("/").rsplit("/", 1)[-1]}
            self.found.append(item)
            if tag not in VOID:
                self.items.append((len(self.tags), item))
        if tag not in VOID:
            self.tags.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.tags:
            return
        while self.tags.pop() != tag:
            pass
        while self.texts and self.texts[-1][0] >= len(self.tags):
            _, item, name, pieces = self.texts.pop()
            item.setdefault(name, " ".join("".join(pieces).split()))
        while self.items and self.items[-1][0] >= len(self.tags):
            self.items.pop()

    def handle_data(self, data):
        for _, _, _, pieces in self.texts:
            pieces.append(data)


def items_of(html: str | None) -> list:
    if "itemscope" not in (html or "").lower():
        return []
    parser = Items()
    parser.feed(html)
    return [([i["@type"]], True, json.dumps(i, ensure_ascii=False)) for i in parser.found]


def _join(base: str | None, link: str | None) -> str | None:
    try:
        return urljoin(base or "", (link or "").strip())
    except ValueError:
        return None


def json_nodes(html: Column) -> Column:
    """All JSON-LD objects of a page as (kinds, listed, node); a script that does not parse has none."""

    @F.pandas_udf(NODE)
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(nodes_of)

    return nodes(html)


def microdata_items(html: Column) -> Column:
    """All microdata items of a page in the form of ``json_nodes``."""

    @F.pandas_udf(NODE)
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(items_of)

    return items(html)


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page; null where it is no link at all."""

    @F.pandas_udf("string")
    def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, links in batches:
            yield pd.Series([_join(b, x) for b, x in zip(bases, links)])

    return joined(base, link)


def field(node: Column, *names: str) -> Column:
    """The first of some text fields of a node that is not empty; objects and lists do not count as text."""
    got = [F.get_json_object(node, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(~F.substring(F.ltrim(x), 1, 1).isin("{", "[") & (x != ""), x) for x in got])
