"""Packing against the tokenizer as it is, and how few documents are cut."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from skerry.llm import packing
from skerry.llm.queries import op4_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_plain_call(plain):
    rng = random.Random(9)
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|> é"]
    texts += ["".join(rng.choice([*" \n\taZé9.!'日s", "<|endoftext|>", "<|", "|>"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        assert packing.token_ids(t, PATH).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert packing.token_ids(texts[0], PATH).tolist() == [437, 220, 50256, 923]


def test_registered_query_packs_every_id_once(spark, plain):
    sf = "/root/testdata/sf0.01"
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = op4_packing(spark, sf).toPandas()
    assert set(pieces.doc_id) == set(ids)
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids[doc]) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(np.array(ids[doc][s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = own.length.sum()
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and total <= 1024 and total & (total - 1) == 0
    short = pieces[pieces.doc_tokens <= 1024].groupby("doc_id").size()
    assert (short > 1).mean() < 0.25


def test_windows_are_full_whatever_the_lengths():
    rng = np.random.default_rng(4)
    for turn in range(30):
        packer = packing.TierPacker(turn, (8, 16, 32))
        lengths = rng.integers(1, (3, 40, 200)[turn % 3], 60)
        for doc, n in enumerate(lengths):
            packer.add(doc, np.arange(n, dtype="<u4"))
            if doc % 7 == 0:
                packer.pack()
        packer.pack(last=True)
        seen = {}
        for doc, start, length, _, total, seq, offset, size, _ in packer.rows:
            seen.setdefault(doc, []).append((start, length))
            assert total == lengths[doc] and length > 0 and offset + length <= size
        assert {d: sorted(p) for d, p in seen.items()}.keys() == set(range(60))
        for d, own in seen.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == lengths[d]
        windows = {}
        for row in packer.rows:
            windows.setdefault((row[5], row[7]), []).append(row[2])
        assert all(sum(v) == size for (_, size), v in windows.items())
