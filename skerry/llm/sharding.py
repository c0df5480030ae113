"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id, row number), so equal texts are
neighbours and no two rows have one key.  Splitters that cut this order into
parts of equal bytes are found without sorting: each round takes a few sampled
keys of every interval that still holds an unsettled splitter as probes,
counts the exact bytes and rows below every probe across all partitions, and
narrows the intervals, until each splitter meets its tolerance (Harsh, Kale
and Solomonik, "Histogram sort with sampling", 2019).  A splitter moves to a
border between two texts where one lies near enough.  Then the rows are
exchanged once.

The driver holds the splitters and their probes, a number that depends on the
shards alone.  A shard's rows are numbered by the counts of each (shard,
written partition), so neither a shard nor a group of equal texts is sorted in
one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skerry.llm.common import stored

#: Bytes by which a splitter may miss its place, and by which it may move to a border of texts, as parts of a shard.
TOLERANCE, GROUP_SLACK = 0.002, 0.01
#: Probes a round and open splitter; an interval of no more rows is probed at every key.
PROBES, WHOLE = 24, 96
LEAST, MOST = -(2**63), 2**63 - 1
Key = tuple[int, int, int]


def packed(h: np.ndarray, i: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Keys as byte strings of one length that compare like (h, i, u)."""
    sign = np.uint64(1 << 63)
    three = np.stack([np.asarray(x, np.int64).view(np.uint64) ^ sign for x in (h, i, u)], 1)
    return np.ascontiguousarray(three.astype(">u8")).view("S24").ravel()


def packed_keys(keys: list[Key]) -> np.ndarray:
    return packed(*(np.array([k[c] for k in keys], np.int64) for c in range(3)))


def place(frame: pd.DataFrame, probes: np.ndarray) -> np.ndarray:
    """How many of the sorted probes are at or below each row's key."""
    return np.searchsorted(probes, packed(*(frame[c].to_numpy() for c in "hiu")), "right")


def _counts(frames: Iterator[pd.DataFrame], probes: np.ndarray) -> Iterator[pd.DataFrame]:
    rows, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for f in frames:
        at = place(f, probes)
        rows += np.bincount(at, minlength=len(rows))
        size += np.bincount(at, f["size"].to_numpy(float), len(size)).astype(np.int64)
    held = np.flatnonzero(rows)
    yield pd.DataFrame({"slot": held, "size": size[held], "n": rows[held]})


def below(keys: DataFrame, probes: list[Key]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each of the sorted probes; as many rows reach the driver as there are probes."""
    work = functools.partial(_counts, probes=packed_keys(probes))
    got = keys.select("h", "i", "u", "size").mapInPandas(work, "slot long, size long, n long").groupBy("slot").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for slot, s, n in got:
        size[slot], rows[slot] = s, n
    return list(zip(size.cumsum()[:-1].tolist(), rows.cumsum()[:-1].tolist()))


def _sampled(frames: Iterator[pd.DataFrame], edges: np.ndarray, rates: np.ndarray, turn: int) -> Iterator[pd.DataFrame]:
    """Keys inside the intervals, each kept by a hash of its own and of the round against its interval's rate."""
    for f in frames:
        at = place(f, edges)
        mixed = np.full(len(f), turn, np.uint64)
        for c, by in zip("hiu", (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)):
            mixed = (mixed ^ f[c].to_numpy().view(np.uint64)) * np.uint64(by)
            mixed ^= mixed >> np.uint64(32)
        keep = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 < rates[at]
        if keep.any():
            yield f.loc[keep, ["h", "i", "u"]]


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[Key, int]]:
    """``parts - 1`` keys, with the bytes below each, that cut ``keys(h, i, u, size)`` into parts of equal bytes.

    Each lies within ``tolerance`` of a part of its place, or next to the one row that covers it.  Every
    round makes known at least one more key of each open interval (but for a chance of e^-24), and an
    interval of one row is settled, so the rounds end whatever repeats."""
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return []
    known: dict[Key, tuple[int, int]] = {(LEAST,) * 3: (0, 0), (MOST,) * 3: (total, rows)}
    wanted = np.array([total * k // parts for k in range(1, parts)], np.int64)
    slack, turn = tolerance * total / parts, 0
    while True:
        turn += 1
        order = sorted(known)
        sizes, counts = (np.array([known[k][c] for k in order], np.int64) for c in (0, 1))
        right = np.clip(np.searchsorted(sizes, wanted, "left"), 1, len(order) - 1)
        near = np.where(wanted - sizes[right - 1] <= sizes[right] - wanted, right - 1, right)
        far = (np.abs(sizes[near] - wanted) > slack) & (counts[right] - counts[right - 1] > 1)
        if not far.any():
            return [(order[k], known[order[k]][0]) for k in near]
        rates = np.zeros(len(order) + 1)
        for r, n in zip(*np.unique(right[far], return_counts=True)):
            held = counts[r] - counts[r - 1]
            rates[r] = 1.0 if held <= WHOLE else min(1.0, PROBES * n / held)  # rows placed at r lie at or above key r - 1
        found = keys.select("h", "i", "u").mapInPandas(functools.partial(_sampled, edges=packed_keys(order), rates=rates, turn=turn), "h long, i long, u long").collect()
        probes = sorted({tuple(r) for r in found}.difference(known))
        if probes:
            known |= dict(zip(probes, below(keys, probes)))


def _sharded(frames: Iterator[pd.DataFrame], edges: np.ndarray) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(shard=place(f, edges).astype(np.int32))


def histogram_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``; shards have nearly equal sizes: each
    border lies within TOLERANCE of a shard from its place, or next to the row that covers it, or at a
    border of two texts within GROUP_SLACK.  So equal texts (null and empty are equal) are together, unless
    a border must cut a group that is larger than that; rows that repeat id and text, of any number, are
    cut like any others.  ``slot`` numbers a shard's rows from 0.  An id that is null sorts first; ids may
    have any type.  An empty table gives an empty result; other columns are ignored.
    """
    text, own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    order = own.cast("long") if isinstance(df.schema[id_col].dataType, IntegralType) else F.when(own.isNotNull(), F.xxhash64(own.cast("string")))
    keys = stored(
        df.select(
            own.cast("string").alias("id"),
            F.coalesce(order, F.lit(LEAST)).alias("i"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("u", F.monotonically_increasing_id()),
        "keys",
    )
    found = splitters(keys, shards, TOLERANCE)
    cuts = [k for k, _ in found]
    if cuts:  # a border of two texts takes a splitter's place where it lies near enough
        total = keys.agg(F.sum("size")).first()[0]
        sides = [[(h, LEAST, LEAST), (min(h + 1, MOST), LEAST, LEAST)] for h, _, _ in cuts]
        borders = sorted({b for two in sides for b in two})
        lies = dict(zip(borders, (s for s, _ in below(keys, borders))))
        for k, two in enumerate(sides):
            miss, near = min((abs(lies[b] - total * (k + 1) // shards), b) for b in two)
            if miss <= GROUP_SLACK * total / shards:
                cuts[k] = near
    columns = "id string, i long, h long, size long, text_crc32 long, u long"
    placed = keys.select("id", "i", "h", "size", "text_crc32", "u").mapInPandas(functools.partial(_sharded, edges=packed_keys(sorted(cuts))), f"{columns}, shard int")
    placed = placed.withColumn("part", F.shiftright("u", 33))  # the partition that wrote the row
    counts = placed.groupBy("shard", "part").count()
    base = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("base"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "i", "u")))
    return numbered.join(base, ["shard", "part"]).select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("k") - 1).alias("slot")
    )
