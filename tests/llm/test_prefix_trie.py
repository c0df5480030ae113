import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group=0, heads=0):
    """The node table of ``(conv, turn, role, text)`` rows, from every prefix of every conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(key).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = own
    if group:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % heads
            built[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = sum(saved[b] for b in below) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(built[c]) == len(p))))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(df, **how):
    got = prefix_trie.prefix_trie(df, **how)
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, got.collect()), key=str)


KIND = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 4), (2, 24)])
def test_random_tries_over_many_partitions(spark, seed, partitions):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-20, 160):
        copy = np.random.default_rng(int(rng.integers(0, 12)) if rng.random() < 0.7 else 1000 + c)  # families with common starts
        n = int(rng.integers(1, 14))
        rows += [(c, t, "ab"[int(copy.integers(0, 2))], "xé" * int(copy.integers(0, 2))) for t in range(n)]
    df = spark.createDataFrame(rows, KIND)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made(df, group=5, heads=9) == brute(rows, 5, 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, SF)
    wanted = brute(rows, 5, 9)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    answer = con.execute(queries.ORACLE_SQL["op12_prefix_trie"])
    at = [[c[0] for c in answer.description].index(c) for c in COLUMNS]
    assert sorted((tuple(r[k] for k in at) for r in answer.fetchall()), key=str) == wanted


def test_nulls_ties_copies_long_conversations_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "", ""), (3, 0, "u", "é" * 70_000), (3, 0, "u", "é" * 70_000), (None, 1, "u", "x")]
    rows += [(100 + k, t, "u", "same") for k in range(200) for t in range(3)]  # copies
    rows += [(c, t, "u", f"{t}") for c in (1000, 1001) for t in range(3000)] + [(1002, t, "u", f"{t}") for t in range(2500)]
    df = spark.createDataFrame(rows, KIND).withColumns({"codes": F.lit(1), "key": F.lit("k"), "depth": F.lit(2)})
    assert made(df) == brute(rows)
    assert made(df.where("conv_id < 100"), group=5, heads=9) == brute([r for r in rows if r[0] is not None and r[0] < 100], 5, 9)
    assert prefix_trie.prefix_trie(df.limit(0), group=5, heads=9).collect() == []
    # rebuilt without any turn: a member of the root alone
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    assert made(spark.createDataFrame([(c, 0, "u", "x")], KIND), group=5, heads=9) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_only_branches_ends_and_leaves_are_points():
    code = lambda *turns: b"".join(bytes([t]) * prefix_trie.CODE for t in turns)
    tree = prefix_trie.Patricia(-1, -1, b"")
    for s in sorted([code(1, 2, 3, 4, 5), code(1, 2, 3, 9), code(1, 2, 3, 9, 9, 9), code(7, 7)]):
        tree.add(s, np.arange(1, len(s) // prefix_trie.CODE + 1), 1, 1)
    tree.close()
    assert sorted(r[2] for r in tree.rows) == [0, 2, 3, 4, 5, 6]
