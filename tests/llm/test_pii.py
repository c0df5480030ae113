import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import pii, queries

SF = "/root/testdata/sf0.001"


def naive(text):
    """The base patterns as they are stated, run by the regex engine alone."""

    def digits(x):
        return re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(x)))) % 10 == 0

    stated = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    found = [(m.start(), n, m.end(), kind) for n, (kind, (p, ok)) in enumerate(stated.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+-_ %(0é", max_size=40) | st.text("0123456789.+ -", max_size=40) | st.lists(st.sampled_from(["4111 1111", "1.2.3.4", "a@b.c", "@", ".", "+1 ", "55", "é", "256"]), max_size=9).map("".join))
def test_plain_finds_are_those_of_the_patterns(text):
    assert pii.matches(text) == naive(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=30), st.data())
def test_spans_map_back_through_any_edits(text, data):
    chars = [(c, k, k + 1, False) for k, c in enumerate(text)]  # each character with the stretch it came from
    chain, now = [], text
    for _ in range(3):
        cuts = sorted(data.draw(st.lists(st.integers(0, len(now)), max_size=6, unique=True)))
        edits = [(a, b, data.draw(st.text("xyz", max_size=2))) for a, b in zip(cuts[::2], cuts[1::2])]
        chain.append(pii.Rewritten(now, edits))
        made, at = [], 0
        for a, b, put in edits:
            made += chars[at:a] + [(c, chars[a][1], chars[b - 1][2], True) for c in put]
            at = b
        chars = made + chars[at:]
        now = chain[-1].text
        assert now == "".join(c[0] for c in chars)
    for a in range(len(now)):
        for b in range(a + 1, len(now) + 1):
            low, high = a, b
            for step in reversed(chain):
                low, high, _ = step.back(low, high)
            assert (low, high) == (min(c[1] for c in chars[a:b]), max(c[2] for c in chars[a:b]))


@pytest.mark.parametrize(
    ("text", "kind", "part", "found"),
    [
        ("write john (at) example [dot] com please", "email", "john (at) example [dot] com", "john@example.com"),
        ("john dot smith at example dot co dot uk.", "email", "john dot smith at example dot co dot uk", "john.smith@example.co.uk"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("(jо​hn@exаmple.com)", "email", "jо​hn@exаmple.com", "john@example.com"),
        ("an x&#64;y&#46;com b", "email", "x&#64;y&#46;com", "x@y.com"),
        ("ann_at_example_dot_org", "email", "ann_at_example_dot_org", "ann@example.org"),
        ("ann at host (dot) org", "email", "ann at host (dot) org", "ann@host.org"),
        ("schreib an jo (ät) firma punkt de", "email", "jo (ät) firma punkt de", "jo@firma.de"),
        ("call plus one two one two five five five zero one two three four", "phone", "plus one two one two five five five zero one two three four", "+121255501234"),
        ("+1 ٩٧٤ 555 3436", "phone", "+1 ٩٧٤ 555 3436", "+1 974 555 3436"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
        ("at 192[.]168[.]1[.]1 now", "ip", "192[.]168[.]1[.]1", "192.168.1.1"),
        ("four triple one, double one double one 1111 1111", "card", "four triple one, double one double one 1111 1111", "411111111111 1111"),
        ("4111–1111–1111–1111", "card", "4111–1111–1111–1111", "4111-1111-1111-1111"),
        ("vier eins eins eins 1111 1111 1111", "card", "vier eins eins eins 1111 1111 1111", "41111111 1111 1111"),
    ],
)
def test_disguises(text, kind, part, found):
    got = [(k, text[a:b], f) for k, a, b, f, base in pii.identifiers(text) if not base]
    assert got == [(kind, part, found)]


@pytest.mark.parametrize(
    "text",
    ["Look at example.com for more.", "We met at noon. Dot came, too.", "stay-at-home", "one two three", "At five (at least) he left. It was one. Two came.", "un deux trois quatre cinq six", "5 dot 6", "(.)", "Größe – 12 · 3", "Иван и Пётр"],
)
def test_clean_texts_stay_clean(text):
    assert pii.identifiers(text) == []


def test_plain_finds_stay_beside_longer_disguised_ones():
    text = "j@mail.example[dot]com and j@mail.example"
    assert [(k, text[a:b], base) for k, a, b, _, base in pii.identifiers(text)] == [("email", "j@mail.example", True), ("email", "j@mail.example[dot]com", False), ("email", "j@mail.example", True)]


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = naive(docs[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(",")) and (r.n_disguised > 0 or r.spans == line)
    assert sum(r.n_email for r in got) and sum(r.n_phone for r in got)


def test_odd_rows_and_empty_tables(spark):
    long = "a@b.cd " + "x" * 2_000_000 + " é a [at] b [dot] cd"
    rows = [(1, None), (2, ""), (3, long), (4, "a@b.cd"), (4, "a@b.cd"), (None, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(0), "id": F.lit("x"), "kind": F.lit(1)})
    got = sorted(((r.doc_id, r.spans) for r in pii.personal_digest(df).collect()), key=str)
    end = len(long)
    assert got == sorted([(1, ""), (2, ""), (3, f"email:0:6,email:{end - 17}:{end}"), (4, "email:0:6"), (4, "email:0:6"), (None, "ip:0:7")], key=str)
    assert pii.personal_digest(df.limit(0)).collect() == []
    shown = pii.personal_data(df.where("doc_id = 4"), redact=True).first()
    assert shown.redacted == "[email]" and shown.spans[0].found == "a@b.cd" and shown.spans[0].base
