import html as standard
import html.entities
import json
import random
import unicodedata

from pyspark.sql import functions as F

from skerry.functions import canonical, html, names
from skerry.sources import sinks


def test_folding_equals_compatibility_forms_on_all_latin_blocks(spark):
    blocks = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xAB30, 0xAB70), (0xFB00, 0xFB07), (0xFF21, 0xFF5B), (0x300, 0x370)]
    letters = [chr(c) for a, b in blocks for c in range(a, b)] + ["Việt Nam", "Straße", "ﬁrma", "Ǆ", "Åsgård Ærlig Øl", "á"]
    df = spark.createDataFrame([(c,) for c in letters], "c string").coalesce(1)

    def wanted(text):
        out = text.lower()
        for k, v in names.SPELLINGS[0].items():
            out = out.replace(k, v)
        return unicodedata.normalize("NFKD", out).encode("ascii", "ignore").decode()

    assert {r[0]: r[1] for r in df.select("c", names.fold(F.col("c"))).collect()} == {c: wanted(c) for c in letters}


def test_references_equal_the_standard_on_all_names_and_numbers(spark):
    texts = [f"a&{n}b" for n in standard.entities.html5]
    texts += [f"&#{k};" for k in (*range(0, 300), 0x378, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9, 10**20)] + [f"&#x{k:x}" for k in (0, 9, 65, 0x80, 0x9F, 0xD800, 0x1F600, 2**40)]
    texts += ["", "&", "&&amp;", "&amp;amp;", "&notit;", "&notin;", "&unknown;", "&#;", "&#x;", "&#xZ", "x &lt y &gt;z", "&AMP", "&#0065;&#x00041;", "ö &ouml; &euml", "a;b & c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    got = {r[0]: r[1] for r in df.select("t", html.unescaped(F.col("t"))).collect()}
    assert {t: got[t] for t in texts if got[t] != standard.unescape(t)} == {}


def test_nested_values_equal_the_standard_byte_for_byte(spark, tmp_path):
    r = random.Random(4)
    kind = "b struct<y: array<struct<k: string, a: double>>, x: map<string, array<boolean>>, `Å b`: string>, a array<map<string, struct<v: double, u: long>>>, `c d` double, `é` string"
    odd = ["", "plain", 'q"\\', "\u0000\u001f\u000b\u007f", "\\u001F", "line\nbreak\ttab\r\f\b", "æøå 漢 😀", None]
    reals = [0.0, -0.0, 1.0, 1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.25e22, 1e-3, 1e-4, 1.5e-5, -2.5e-7, 0.1, 1e100, 5e-300, 12345678.9, None]
    rows = []
    for _ in range(120):
        inner = {"y": [{"k": r.choice(odd), "a": r.choice(reals)} for _ in range(r.randint(0, 3))] or None, "x": {k: [r.choice([True, False, None])] for k in r.sample(["b", "a", "Z", "é", "a\n"], r.randint(0, 3))}, "Å b": r.choice(odd)}
        rows.append((r.choice([inner, None]), [{r.choice("zay"): {"v": r.choice(reals), "u": r.randint(-5, 5)}}, None][: r.randint(0, 2)], r.choice(reals), r.choice(odd)))
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = [x[0] for x in df.select(canonical.json_rows(df)).collect()]
    wanted = [json.dumps(dict(zip(["b", "a", "c d", "é"], row)), sort_keys=True, ensure_ascii=False) for row in rows]
    assert got == wanted
    special = spark.createDataFrame([([float("nan"), float("inf"), -float("inf")],)], "v array<double>")
    assert special.select(canonical.json_rows(special)).first()[0] == '{"v": [NaN, Infinity, -Infinity]}'
    sinks.write_json_lines(df.limit(3), str(tmp_path / "out"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()] == wanted[:3]
