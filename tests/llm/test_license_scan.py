"""Licence rules: every rule in its own example, and suppression against a plain version."""

import random
import re
import time

from skerry.llm import license_scan
from skerry.llm.license_rules import RULES


def examples(pattern):
    """The strings of a pattern without its optional parts."""
    pattern = pattern.replace(" ?", "").replace("v?", "")
    while (short := re.sub(r"\(\?:[^()]*\)\?", "", pattern)) != pattern:
        pattern = short
    open_ = [pattern]
    while any("(?:" in o for o in open_):
        o = open_.pop(next(k for k, o in enumerate(open_) if "(?:" in o))
        m = re.search(r"\(\?:([^()]*)\)", o)
        open_ += [o[: m.start()] + a + o[m.end() :] for a in m.group(1).split("|")]
    return [o.replace("[cs]", "c").replace("[0-9]", "1") for o in open_]


def plain(hits):
    """The rule of the docstring, match by match against all that stay."""
    kept = []
    for s, l, n, p, e in sorted(hits, key=lambda h: (h[3], h[0], h[1], h[2])):  # noqa: E741
        if all(e <= a or b <= s for a, _, _, _, b in kept):
            kept.append((s, l, n, p, e))
    return sorted(kept)


def test_every_rule_is_found_in_its_own_example(spark):
    rows = [(n, 0, e) for n, r in enumerate(RULES) for e in examples(r[3])]
    assert len(RULES) > 200 and all(re.fullmatch(RULES[n][3], e) and f" {RULES[n][2]} " in f" {e} " for n, _, e in rows)
    df = spark.createDataFrame([(n, f"Xyz {e.title()}. Xyz") for n, _, e in rows], "doc_id long, text string")
    for r in license_scan.license_detections(df).collect():
        own = RULES[r["doc_id"]]
        assert any(k["p"] <= own[0] for k in r["kept"]), (own, r["kept"])


def test_names_as_people_write_them(spark):
    wanted = {
        "released under the BSD 3-Clause License": "bsd-3-clause", "BSD-3-Clause": "bsd-3-clause", "GPLv2": "gpl-2", "MPL-2.0": "mpl-2.0", "Apache-2.0": "apache-2.0",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "GNU LGPL v2.1": "lgpl-2.1", "CC BY-SA 4.0": "cc-by-sa-4.0", "nothing to see": "", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2+",
    }
    df = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(df).collect()}
    for k, (text, label) in enumerate(wanted.items()):
        assert label in got[k][0].split(","), (text, got[k])
        assert (got[k][1] > 0) == bool(label)
    assert got[5] == ("apache-2.0", 1.0)


def test_resolution_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 3)
    rng = random.Random(1)
    cases = [[(0, 5, 3), (1, 3, 3), (4, 6, 1)]]
    for _ in range(150):
        cases.append([(s := rng.randrange(20), s + rng.randrange(1, 6), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 18))])
    hits = [[(s, s - e, n, p, "x", 0.5, e) for n, (s, e, p) in enumerate(c)] for c in cases]
    df = spark.createDataFrame(list(enumerate(hits)), f"k int, hits array<{license_scan.MATCH}>")
    for r in df.selectExpr("k", f"{license_scan.resolved('hits', (1, 2, 3, 4))} AS kept").collect():
        got = [(m["s"], m["l"], m["n"], m["p"], m["e"]) for m in r["kept"]]
        assert got == plain([(s, s - e, n, p, e) for n, (s, e, p) in enumerate(cases[r["k"]])]), cases[r["k"]]
    assert [(a, b) for a, _, _, _, b in plain([(0, -5, 0, 3, 5), (1, -2, 1, 3, 3), (4, -2, 2, 1, 6)])] == [(1, 3), (4, 6)]


def test_a_megabyte_of_matches_takes_seconds(spark):
    df = spark.createDataFrame([(1, "see the mit license here " * 40_000)], "doc_id long, text string")
    began = time.time()
    r = license_scan.license_scan(df).first()
    assert (r["n_base"], r["n_detections"], r["labels"]) == (40_000, 40_000, "mit") and time.time() - began < 60
