"""Histogram sort against the sorted table, and on keys that repeat by the thousand."""

import random

import numpy as np
import pytest

from skerry.llm import sharding
from skerry.llm.queries import op7_sharding

SF = "/root/testdata/sf0.01"


def checked(got, sizes, shards):
    """Sizes by the stated tolerance, gapless slots, equal texts together unless a border cuts them."""
    total, largest = sum(sizes), max(sizes)
    assert len(got) == len(sizes) and sorted(got["size"]) == sorted(sizes)
    by_shard = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    room = 2 * ((sharding.TOLERANCE + sharding.GROUP_SLACK) * total / shards + largest)
    assert (by_shard - total / shards).abs().max() <= room
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    cut = got.groupby("text_crc32")["shard"].nunique()
    assert (cut > 1).sum() <= shards - 1  # each border cuts one group at most


def test_registered_query_has_forty_even_shards(spark):
    got = op7_sharding(spark, SF).toPandas()
    sizes = [len((r.text or "").encode()) + 16 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    checked(got, sizes, 40)
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and set(got["shard"]) == set(range(40))


@pytest.mark.parametrize("ids", ["null", "equal", "text"])
def test_rows_that_repeat_by_the_thousand_are_cut(spark, ids):
    of = {"null": lambda k: None, "equal": lambda k: 7, "text": lambda k: f"doc-{k}"}[ids]
    rows = [(of(k), "the same text") for k in range(5000)] + [(of(k), f"other {k % 7}" * 5) for k in range(3000)] + [(of(1), None), (of(2), "")]
    df = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'text' else 'long'}, text string").repartition(3)
    got = sharding.histogram_shards(df, shards=40).toPandas()
    checked(got, [len((t or "").encode()) + 16 for _, t in rows], 40)
    if ids == "text":
        assert sorted(got["doc_id"]) == sorted(d for d, _ in rows)


def test_splitters_cut_where_the_sorted_table_would(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(-50, 50), rng.randrange(3), k, rng.randrange(1, 400)) for k in range(4000)]
    keys = spark.createDataFrame(rows, "h long, i long, u long, size long").repartition(4).cache()
    rows.sort()
    before = np.r_[0, np.cumsum([r[3] for r in rows])]
    cuts = sharding.splitters(keys, 16, 0.0)  # no tolerance: the nearest border between two rows
    total = int(before[-1])
    for k, (key, size) in enumerate(cuts):
        at = sum(r[:3] < key for r in rows)
        assert size == before[at]
        assert abs(size - total * (k + 1) // 16) == np.abs(before - total * (k + 1) // 16).min()


def test_keys_compare_like_their_numbers():
    rng = np.random.default_rng(0)
    three = [tuple(int(x) for x in r) for r in rng.integers(-3, 3, (300, 3))] + [(sharding.LEAST,) * 3, (sharding.MOST,) * 3, (0, 256, 0), (0, 255, 2**40)]
    assert [three[k] for k in np.argsort(sharding.packed_keys(three), kind="stable")] == sorted(three)


def test_few_rows_and_none(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.histogram_shards(empty).collect() == []
    got = sharding.histogram_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)
