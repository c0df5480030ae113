"""Each operator against brute force, and on nulls, long texts, repeats, clashing columns and empty tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import byte_bpe, lattice, license_scan, line_crf, packing, pu_quality, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ("id", "p", "vec", "fp", "kind", "word", "score", "h", "i", "size", "count", "c", "t")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeats, foreign scripts, and columns with clashing names."""
    texts = [None, "", " \n\t ", "one", "two words", "Under the MIT License.\nall rights reserved" * 2, "idiot " * 30, "a" * 30_000, "word " * 20_000, "日本語 テキスト ▁x", "same text here now", "same text here now", "x\x85y z\x1cw"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


def operators(labels):
    trusted = labels.where("quality = 1")
    return {
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "line_crf": lambda d: line_crf.content_rules(d, labels),
        "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
        "lattice": lambda d: lattice.lattice_scores(d, public_tokenizers.path("piece_bpe_32k.model")),
        "simhash": lambda d: simhash.near_duplicate_groups(d),
        "sharding": lambda d: sharding.histogram_shards(d),
        "license_scan": lambda d: license_scan.license_scan(d),
        "pu_quality": lambda d: pu_quality.pu_quality(d, trusted, F.lit(True)),
        "byte_bpe": lambda d: byte_bpe.bpe_digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    }


@pytest.mark.parametrize("name", ["toxicity", "line_crf", "packing", "lattice", "simhash", "sharding", "license_scan", "pu_quality", "byte_bpe"])
def test_odd_rows_and_empty_tables(spark, odd, labels, name):
    made = operators(labels)[name](odd).collect()
    ids = Counter(r["doc_id"] for r in made)
    wanted = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert (set(ids) if name == "packing" else ids) == (set(wanted) if name == "packing" else wanted)
    assert operators(labels)[name](odd.limit(0)).collect() == []


def test_toxicity_holds_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    scored = toxicity.toxicity(docs, labels.where(~held)).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id")
    shares = dict(map(tuple, scored.groupBy("truth").agg(F.avg(F.col("toxic").cast("double"))).collect()))
    assert shares[0] < 0.01 and shares[1] > 0.8


def test_toxicity_without_labels_or_rows_in_a_partition(spark, docs, labels):
    assert {r["p_toxic"] for r in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.repartition(40), labels).count() == docs.count()


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.3).astype(np.float32)
    y = np.stack([x[:, 0], np.maximum(x[:, 0], x[:, 1])], 1)
    models = toxicity.train_chain(x, y, np.arange(600) % 3)
    assert [len(m) for m in models] == [7, 8]
    p = toxicity.chain_probabilities(x, models)
    assert ((p >= 0.5) == y).mean() > 0.98


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    held = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(held)


def test_base_counts():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "ä", "日", " ", " ", "\n", "\n", "#", "\t", "\x85", "a b c"]) for _ in range(rng.randint(0, 60)))
        assert line_crf.base_counts(text) == brute_base(text), repr(text)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    model = line_crf.LineCrf()
    for _ in range(50):
        model.step, model.first = rng.normal(size=(2, 2)), rng.normal(size=2)
        s = rng.normal(size=(6, 2))
        value = lambda path: model.first[path[0]] + sum(s[t, p] for t, p in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert model.viterbi(s) == list(max(itertools.product((0, 1), repeat=6), key=value))


def test_line_crf_separates_labelled_texts(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = line_crf.content_rules(docs, labels).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.98 and share.get(0, 0) < 0.1


def test_pu_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    got = pu_quality.pu_quality(docs, labels.where(learnt & (F.col("quality") == 1)), learnt).join(labels.where(~learnt), "doc_id")
    share = dict(map(tuple, got.groupBy("quality").agg(F.avg("predicted")).collect()))
    assert share[1] > 0.95 and share[0] < 0.15


def test_class_prior():
    rng = np.random.default_rng(3)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(pu_quality.class_prior(p, np.r_[p[:1400], n[:600]]) - 0.7) < 0.06


def test_packing_holds_every_id_once(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = packing.load_tokenizer(path)
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = packing.pack_documents(docs.repartition(3), path).toPandas()
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids[doc]) == own["doc_tokens"].iloc[0]
        for s, n, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(np.array(ids[doc][s : s + n], "<u4").tobytes()) == crc
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = own["length"].sum()
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and total <= 1024 and total & (total - 1) == 0
    assert set(pieces["doc_id"]) == set(ids)


def test_both_encoders_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t  aZé9.!'日s\x1c\x85-tl<|endoftext|>ªº×") for _ in range(rng.randint(0, 40)))
        assert packing.token_ids(text, path).tolist() == packing.load_tokenizer(path).encode(text, add_special_tokens=False).ids


def test_lattice_sums_all_segmentations():
    pieces = lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    logp = np.log(pieces.prior)

    def total(text):
        @lattice.functools.lru_cache(None)
        def after(a):
            if a == len(text):
                return 1.0
            out = sum(math.exp(logp[pieces.by_name[text[a:b]]]) * after(b) for b in range(a + 1, min(len(text), a + 16) + 1) if text[a:b] in pieces.by_name)
            if text[a] not in pieces.single:
                out += math.exp(logp[pieces.byte_numbers(ord(text[a]))].sum()) * after(a + 1)
            return out

        return math.log(after(0))

    words = ["the", "tion", "ärger", "日本", "zzqx", "a" * 20]
    assert np.allclose(lattice.marginals(words, pieces, logp), [total("▁" + w) for w in words])
    assert np.allclose([lattice._long(w, pieces, logp) for w in words], lattice.marginals(words, pieces, logp))
    counts = lattice.expected_counts(["tion"], np.array([3.0]), pieces, logp)
    spelled = sum(n * len(pieces.names[k]) for k, n in enumerate(counts[: len(pieces.names)]))
    assert abs(spelled - 3 * len("▁tion")) < 1e-6


def test_lattice_base_scores(spark, docs):
    rows = docs.collect()
    tokens = {r["doc_id"]: [w.decode() for w in (r["text"] or "").encode().lower().split()] + [None] for r in rows}
    train = Counter(w for k, own in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in own)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in lattice.lattice_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for k, own in tokens.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(w in train for w in own), n, zlib.crc32(str(k).encode()) % 10 == 0)
        assert abs(r["base_score"] - sum(math.log10((train.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)) < 1e-6 * len(own)
        assert r["score"] < 0


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in prints}


def test_simhash_components(spark, docs):
    prints = {r["doc_id"]: brute_print(r["text"] or "") for r in docs.collect()}
    groups = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {k: (f"{v:016x}", groups[k]) for k, v in prints.items()}


def test_simhash_links_in_crowded_cells(spark, monkeypatch):
    from skerry.llm.components import connected_components

    monkeypatch.setattr(simhash, "CELL_PAIRS", 6)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values)[:4]:
        values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    groups = brute_components({k: signed[k] for k in sorted(signed)})
    links = simhash.linked_pairs(spark.createDataFrame([(k,) for k in signed], "fp long"))
    names = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {k: names.get(k, k) for k in signed} == groups


def test_sharding(spark, docs):
    got = sharding.histogram_shards(docs, shards=8).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == len(texts) and (got["size"] == [len(texts[k].encode()) + 16 for k in got["doc_id"]]).all()
    assert (got["text_crc32"] == [zlib.crc32(texts[k].encode()) for k in got["doc_id"]]).all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.3 * sizes.mean() + 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_counts(spark, docs):
    more = spark.createDataFrame([(10_001, "MIT  License, apache-license; mit license mit license"), (10_002, "GNU General\nPublic License v3"), (10_003, "mit licenses"), (10_004, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {r["doc_id"]: r for r in license_scan.license_scan(both).collect()}
    for r in both.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute_license(r["text"] or "")
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert "gpl-3" in got[10_002]["labels"].split(",")


def test_license_containment(spark):
    """A match inside one of better priority gives no label of its own."""
    df = spark.createDataFrame([(1, "licensed under the apache license version 2 0 and nothing else")], "doc_id long, text string")
    kept = license_scan.license_detections(df).first()["kept"]
    assert all(a["e"] <= b["s"] for a, b in zip(kept, kept[1:])) and [k["label"] for k in kept][0].startswith("apache")


def test_byte_bpe_is_tiktoken(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    extra = [(20_000 + k, "".join(rng.choice(" \n\t  aZé9.!'日s-tl") for _ in range(rng.randint(0, 80)))) for k in range(200)] + [(30_000, "ab" * 5_000), (30_001, "  x  y "), *[(40_000 + n, "abcé"[n % 3 :] * 400 + "x" * n) for n in range(6)], *[(50_000 + n, "q" * n) for n in (255, 256, 257, 258)]]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in byte_bpe.bpe_digests(both, path, public_tokenizers.PATTERN).collect()}
    for r in both.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
