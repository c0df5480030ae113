"""Places where an operator once did less than the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_near_copy_stage_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    has, group = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            has.setdefault(x, []).append(d)
    shared = {}
    for held in has.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [d for d, s in sets.items() if not s]
    for a, b in near + list(zip(empty, empty[1:])):
        x, y = sorted((root(a), root(b)))
        group[y] = x
    assert any(sets[a] != sets[b] for a, b in near)
    left = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect())
    assert left == sorted(d for d in sets if root(d) == d)


def test_near_copies_of_a_large_group_and_of_its_edge(spark):
    """A key's smallest text may be unlike some of the others, which are alike among themselves."""
    from skerry.llm import near_copies

    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    rows = []
    for d in range(60):  # each is the one before with a few words more: ends of the chain are unlike
        rows.append((d, " ".join(base[3 * d : 3 * d + 200])))
    rows += [(1000 + k, " ".join(f"x{j}" for j in rng.integers(0, 5000, 120))) for k in range(5)]
    got = near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(d, 0) for d in range(60)] + [(1000 + k, 1000 + k) for k in range(5)]


def test_long_words_are_learnt_from(spark, monkeypatch):
    import public_tokenizers

    from skerry.llm import lattice

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = lattice.load_pieces(path)
    words = ["thequickbrownfox" * 5, "日本語の文" * 12, "▁x" * 30, "short"]
    times, logp = np.array([3.0, 2.0, 1.0, 4.0]), np.log(pieces.prior)
    got = lattice.expected_counts(words, times, pieces, logp)
    monkeypatch.setattr(lattice, "LONGEST_ROW", 10**6)
    assert np.allclose(got, lattice.expected_counts(words, times, pieces, logp))
    monkeypatch.undo()
    word = "thequickbrownfox" * 5
    learnt = lattice.piece_probabilities(spark.createDataFrame([(word, 100_000)], "word string, c long"), 0, path)
    k = max((n for n in pieces.names if n in word), key=len)
    assert learnt[pieces.by_name[k]] > logp[pieces.by_name[k]] + 1


def test_lines_after_the_sixtieth_are_learnt_from(spark):
    from skerry.llm import line_crf

    prose = [f"The council of ward {k} met again and heard what was said about the road." for k in range(100)]
    links = [f"#{k} | $ * & | SHOP NOW ! | % {k}" for k in range(40)]
    rows = [(k, "\n".join(prose if k % 2 else prose[:60] + links)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    out = {r["doc_id"]: r["n_content_lines"] for r in line_crf.content_rules(df, labels).collect()}
    assert out[1] == 100 and out[0] == 60


def test_a_frequent_id_brings_one_row_to_the_fits(spark, monkeypatch):
    from skerry.llm import linear, pu_quality

    rows = [(7, f"The town hall opened on day {k} of the year. It was full.") for k in range(300)] + [(k, f"Text number {k} is here. It is short.") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1)] + [(k, k % 2) for k in range(100, 110)], "doc_id long, quality int")
    sample = linear.labelled_sample(df, labels, ["quality"], 100, "doc_id", "text").collect()
    assert sorted((int(r["id"]), r["y_quality"]) for r in sample) == [(7, 1)] + [(k, k % 2) for k in range(100, 110)]
    seen = []
    fit = pu_quality.fit_quality
    monkeypatch.setattr(pu_quality, "fit_quality", lambda p, folds, web: seen.append((len(p), web.rows)) or fit(p, folds, web))
    pu_quality.pu_quality(df, labels.where("quality = 1"), F.lit(True), sample_rows=5).count()
    assert seen == [(5, 330)]  # trusted ids are bounded, unlabelled rows are not


@pytest.mark.parametrize("n", [600, 2400])
def test_texts_that_share_a_passage_and_are_unlike_bring_few_pairs(spark, monkeypatch, n):
    """245 words of which 200 are the same everywhere: a similarity of 0.69, so no pair is a link, and none needs a look."""
    from skerry.llm import near_copies

    rng = np.random.default_rng(0)
    base, own = " ".join(f"p{k}" for k in range(200)), lambda k: " ".join(f"o{x}" for x in rng.integers(0, 10**7, k))
    rows, pairs, keep = [(d, f"{own(22)} {base} {own(23)}") for d in range(n)], [], near_copies.stored

    def counted(df, name):
        made = keep(df, name)
        if name == "near-pairs":
            pairs.append(made.count())
        return made

    monkeypatch.setattr(near_copies, "stored", counted)
    assert near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == n
    assert sum(pairs) < n / 10


def test_the_bound_loses_no_pair():
    """Two sets of similarity 0.8 or more meet at their first common element of any order, within the bound."""
    from skerry.llm import near_copies

    rng = np.random.default_rng(5)
    table, met = np.zeros(1 << near_copies.PART_BITS, np.uint16), 0
    for _ in range(400):
        pool = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 90)), np.int64)).astype(np.uint64)
        a, b = (np.sort(rng.permutation(pool)[: max(1, int(len(pool) * rng.uniform(0.8, 1)))]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            x, y = sorted((near_copies.prefix(s, table, 0.8).tolist() for s in (a, b)), key=len)
            first = next(k for k in x if k in y)
            big, small = (a, b) if len(a) >= len(b) else (b, a)
            r = [len(s) - near_copies.prefix(s, table, 0.8).tolist().index(first) for s in (big, small)]
            assert 0.8 * (len(a) + len(b)) <= 1.8 * min(r) + 1e-9 and 1.6 * len(small) <= 1.8 * r[1] + 1e-9
            met += 1
    assert met > 100


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    """What stays in the shared folder after a query is what its result still reads."""
    import os

    pipeline = pytest.importorskip("corpus_pipeline")
    from skerry.llm import common, queries

    stay = {"op1_toxicity": set(), "op9_pu_quality": set(), "op6_simhash": {"fingerprints", "groups", "hot-keys"}, "op12_prefix_trie": {"trie-points", "trie-ends", "hot-keys"}, "op13_hard_negatives": {"hard-anchors", "hard-facts", "hot-keys"}, "pipeline": {"stage-near-copies"}}
    for name, wanted in stay.items():
        monkeypatch.setattr(common, "shared_folder", lambda spark, name=name: str(tmp_path / name))
        (queries.QUERIES | {"pipeline": pipeline.run})[name](spark, "/root/testdata/sf0.001").count()
        root = tmp_path / name / "skerry"
        assert {x.rsplit("-", 1)[0] for x in os.listdir(root)} == wanted, name


def test_a_large_star_is_one_component(spark, monkeypatch):
    """Centres of many links are told by broadcast; the result is the same."""
    from skerry.llm import components

    monkeypatch.setattr(components, "MANY", 50)
    links = spark.range(1, 3000).selectExpr("0L AS a", "id AS b").unionByName(spark.range(3000, 3300).selectExpr("id AS a", "id + 1 AS b")).unionByName(spark.range(5000, 5200).selectExpr("5300L AS a", "id AS b"))
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(3000)} | {k: 3000 for k in range(3000, 3301)} | {k: 5000 for k in (*range(5000, 5200), 5300)}
