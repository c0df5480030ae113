"""Near-duplicate groups of SimHash fingerprints.

Distinct fingerprints are embedded by the bit counts of their sixteen 4-bit
segments.  Two fingerprints that differ in k bits lie at most k apart in the
Manhattan distance of these counts, so a range join on the grid of counts
loses no link.  For a range of 2 the join meets in the middle: any two
points at distance 2 or less have a grid point within 1 of both, so each
fingerprint goes to its own cell and its (up to 32) neighbours, and partners
share a cell.  Pairs of a cell are then verified on the bits themselves.

Cells of many fingerprints are not paired up.  Each of their fingerprints goes
to the 65 keys that it or one flipped bit of it spells; all that share such a
key differ in 2 bits at most from each other, and whoever differs in 2 bits at
most shares one, so a star around each key's smallest member links them all
exactly, with 65 rows a fingerprint instead of pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import by_shuffle, discard, id_and_text, slices, small_batches, spread_join, stored, with_id
from skerry.llm.components import connected_components

SEGMENTS, SEGMENT_BITS, RANGE = 16, 4, 2
#: A cell with more fingerprints is linked by flipped bits instead of pairs.
CELL_PAIRS = 48

_HASH = functools.partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half the hashes of the text's shingles; no words: 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return _HASH(line)
    ends = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = ends.cumsum() - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(line.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    return bits_of(np.fromiter(map(_HASH, spans), np.uint64, len(words) - width + 1))


def bits_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; of none: 0."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        count += np.unpackbits(hashes[a : a + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        made = np.array([fingerprint(t, width) for t in frame["text"]], np.uint64)
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "fp": made.view(np.int64)})


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit number."""
    return with_id(id_and_text(df, id_col, text_col).mapInPandas(functools.partial(_fingerprints, width=width), "id string, fp long"), df, id_col)


def segment_counts(fp: str) -> str:
    """SQL: the bit counts of all 4-bit segments, each in its own 4 bits of one number."""
    even, odd = f"({fp} & 6148914691236517205L)", f"(shiftrightunsigned({fp}, 1) & 6148914691236517205L)"
    pairs = f"(({even} ^ {odd}) | shiftleft({even} & {odd}, 1))"  # no plus, which could overflow in the topmost bits
    return f"(({pairs} & 3689348814741910323L) + (shiftrightunsigned({pairs}, 2) & 3689348814741910323L))"


def linked_pairs(points: DataFrame) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints ``fp`` that keep every connection at RANGE bits or fewer."""
    shift = "4 * i"
    at = f"(shiftrightunsigned(c, {shift}) & 15)"
    cells = f"""concat(array(c),
        transform(filter(sequence(0, {SEGMENTS - 1}), i -> {at} > 0), i -> c - shiftleft(1L, {shift})),
        transform(filter(sequence(0, {SEGMENTS - 1}), i -> {at} < {SEGMENT_BITS}), i -> c + shiftleft(1L, {shift})))"""
    placed = points.selectExpr("fp", f"{segment_counts('fp')} AS c").selectExpr("fp", f"explode({cells}) AS cell")
    shared = placed.groupBy("cell").count().where("count > 1")
    met = stored(placed.join(by_shuffle(shared), "cell"), "cells")
    small = (
        met.where(F.col("count") <= CELL_PAIRS)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("fp")).alias("m"))
        .selectExpr(
            "explode(flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), "
            f"y -> bit_count(x ^ y) <= {RANGE}), y -> struct(x AS a, y AS b))))) AS p"
        )
        .select("p.a", "p.b")
    )
    crowded = met.where(F.col("count") > CELL_PAIRS).select("fp").distinct()
    keyed = crowded.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS key")
    hubs = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    stars = keyed.join(by_shuffle(hubs), "key").where("fp <> a").select("a", F.col("fp").alias("b"))
    pairs = stored(small.unionByName(stars).distinct(), "pairs")
    discard(met)
    return pairs


def near_duplicate_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits) ``, component_id``.

    With a ``similarity`` the links are those of texts whose sets of ``width``-word shingles have at least
    that Jaccard similarity; see ``near_copies``.

    ``component_id`` is the smallest id that links of RANGE differing bits or fewer reach, itself
    included.  A null text counts as empty; texts without words share the fingerprint zero and are
    linked like any others.  Ids that are null take part but are never a component's name, unless all of
    its ids are null.  Repeated rows stay; other columns are ignored.
    """
    if similarity is not None:
        from skerry.llm.near_copies import near_copy_groups

        return near_copy_groups(df, id_col=id_col, text_col=text_col, width=width, similarity=similarity)
    with small_batches(df.sparkSession):
        prints = stored(fingerprints(df, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min(id_col).alias("own")), "points")
    pairs = linked_pairs(points)
    labels = connected_components(pairs)  # node, component: both fingerprints
    named = points.join(by_shuffle(labels), points["fp"] == labels["node"], "left").selectExpr("fp", "own", "coalesce(component, fp) AS root")
    smallest = named.groupBy("root").agg(F.min("own").alias("component_id"))
    groups = stored(spread_join(named.select("fp", "root"), smallest, "root").select("fp", "component_id"), "groups")
    discard(pairs, labels, points)
    return spread_join(prints, groups, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
