"""The prefix trie of conversations by distributed Patricia construction.

A conversation is the string of its turns' codes, 16 bytes of SHA-256 each, so
that order and common prefixes of conversations are those of byte strings.
Distinct strings are sorted over the cluster.  Each range partition then
builds its own compressed tree in one pass over its strings with a stack of
open points: only branches, ends and leaves become points, and an edge keeps
the sizes of the turns between them.  Every aggregate of a point is a sum over
the strings below it:

* members: conversations of each string; the smallest one is a minimum;
* leaves: strings that are no prefix of the next one;
* children: a string opens one child at the depth where it leaves the one before it;
* saved tokens: members times turn size, summed over the nodes below, less the
  size of each of these nodes once, where its first string opens it.

Points that several partitions share lie on the common prefix of the strings
on both sides of a border.  Their depths are all made points, and the parts
are added up by the prefix's hash: a first turn that a third of all
conversations share is one row a partition.  Only then the compressed edges
are expanded, by suffix sums of their sizes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import discard, spread_join, stored

CODE = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_strings(df: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, codes, sizes``: each conversation's turns in order, as 16 bytes each, and the UTF-8 bytes of their texts.

    The turn's number orders, null first; equal numbers are ordered by the turns' codes."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * CODE)
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), code.alias("code"), F.octet_length(text).cast("long").alias("size"))
    turns = df.select(F.col(f"`{id_col}`").cast("long").alias("conv"), turn.alias("t")).where("conv IS NOT NULL")
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv", F.col("t.code").alias("codes"), F.col("t.size").alias("sizes"))


def grafted(strings: DataFrame, group: int, heads: int) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % ``group``; h is the unsigned crc32
    of the decimal id modulo ``heads``.  The remainder has the sign of the id."""
    base = F.col("conv") - F.col("conv") % group
    head = strings.select(F.col("conv").alias("base"), F.slice("codes", 1, max(1, heads - 1)).alias("head"), F.slice("sizes", 1, max(1, heads - 1)).alias("head_sizes"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h")
    with_head = strings.select("*", base.alias("base"), h).join(head, "base", "left")

    def joined(first: str, own: str, kind: str):
        none = F.array().cast(kind)
        taken = F.when(F.col("h") > 0, F.slice(F.coalesce(first, none), F.lit(1), F.col("h"))).otherwise(none)
        return F.concat(taken, F.slice(own, F.col("h") + 1, F.size(own)))

    return with_head.select("conv", joined("head", "codes", "array<string>").alias("codes"), joined("head_sizes", "sizes", "array<bigint>").alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns in which two strings agree from their start."""
    n = min(len(a), len(b)) // CODE
    if a[: n * CODE] == b[: n * CODE]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * CODE).reshape(n, CODE) for s in (a, b))
    return int((x != y).any(1).argmax())


class _Point:
    """An open point of the path: its depth and the sums over the strings below it so far."""

    __slots__ = ("depth", "children", "shared", "members", "least", "leaves", "weighed", "once", "ends", "key")

    def __init__(self, depth: int, children: int, shared: bool, size: int):
        self.depth, self.children, self.shared, self.once = depth, children, shared, size
        self.members = self.leaves = self.weighed = self.ends = 0
        self.least = self.key = None

    def take(self, other: _Point, edge: int) -> None:
        """Adds a finished point below, and the sizes of the nodes on the edge to it."""
        self.members += other.members
        self.leaves += other.leaves
        self.weighed += other.weighed + other.members * edge
        self.once += other.once + edge
        self.least = other.least if self.least is None else min(self.least, other.least)


class Patricia:
    """The compressed tree of one partition's sorted distinct strings, given one after the other.

    ``left`` and ``right`` are the turns that the partition's first string shares with the one before it and its
    last one with the one after it, -1 where there is none; ``spine`` is the start of the last string, of ``right``
    turns.  ``rows`` takes finished points in the order of POINT; ``tail`` are the saved tokens that the edge's nodes
    add from each of its depths down, the lowest depth first."""

    def __init__(self, left: int, right: int, spine: bytes):
        self.left, self.right, self.spine, self.rows = left, right, spine, []
        self.path: list[_Point] = []
        self.codes: bytes | None = None
        self.sizes = np.zeros(0, np.int64)

    def _key(self, point: _Point) -> str:
        point.key = point.key or hashlib.md5(self.codes[: point.depth * CODE]).hexdigest()
        return point.key

    def _finish(self, point: _Point, parent: _Point | None) -> int:
        """Writes a point whose strings have all been seen, and returns the sizes of the nodes on its edge."""
        onward = self.right == point.depth and self.codes == self.spine  # the next partition's first string extends this one
        point.leaves += point.ends > 0 and not point.children and not onward
        point.weighed += point.members * (int(self.sizes[point.depth - 1]) if point.depth else 0)
        above = parent.depth if parent else -1
        edge = self.sizes[above : point.depth - 1] if parent else self.sizes[:0]
        tail = ((point.members - 1) * edge[::-1].cumsum()[::-1]).tolist()
        sums = (point.members, point.children, point.leaves, point.weighed, point.once, point.ends)
        self.rows.append((self._key(point), self._key(parent) if parent else None, point.depth, above, point.least, *sums, point.shared, tail))
        return int(edge.sum())

    def _close(self, depth: int) -> None:
        """Finishes the points below ``depth`` on the path; where it cuts an edge, a branch begins."""
        while self.path[-1].depth > depth:
            point = self.path.pop()
            if self.path[-1].depth < depth:
                self.path.append(_Point(depth, 1, False, int(self.sizes[depth - 1])))
            self.path[-1].take(point, self._finish(point, self.path[-1]))

    def add(self, codes: bytes, sizes: np.ndarray, members: int, least: int) -> None:
        """The next string, its turns' sizes, how many conversations have it, and the smallest of them."""
        length, first = len(codes) // CODE, self.codes is None
        met = self.left if first else common(self.codes, codes)
        if not first:
            self._close(met)
            self.path[-1].children += 1
        shared = max(0, min(self.right, common(codes, self.spine)), self.left if first else 0)
        self.codes, self.sizes = codes, sizes
        top = self.path[-1].depth if self.path else -1
        for depth in (*range(top + 1, min(shared, length) + 1), *([length] if length > max(top, shared) else [])):
            size = int(sizes[depth - 1]) if depth > max(0, met) else 0  # a node counts once, where it is opened
            self.path.append(_Point(depth, int(length > depth >= met), depth <= shared, size))
        end = self.path[-1]
        end.members, end.ends = end.members + members, members
        end.least = least if end.least is None else min(end.least, least)

    def close(self) -> None:
        """All strings have been given."""
        self._close(0)
        self._finish(self.path.pop(), None)


POINT = "key string, parent string, depth long, above long, conv long, members long, children long, leaves long, weighed long, once long, ends long, shared boolean, tail array<long>"
POINT_NAMES = [c.split()[0] for c in POINT.split(", ")]


def _built(frames: Iterator[pd.DataFrame], borders) -> Iterator[pd.DataFrame]:
    tree, at = None, None
    for frame in frames:
        for pid, codes, sizes, members, least in zip(*(frame[c] for c in ("pid", "codes", "sizes", "members", "least"))):
            if pid != at:
                if tree:
                    tree.close()
                    yield pd.DataFrame(tree.rows, columns=POINT_NAMES)
                tree, at = Patricia(*borders.value[pid]), pid
            tree.add(bytes(codes), np.asarray(sizes, np.int64), members, least)
            if len(tree.rows) >= 5_000:
                yield pd.DataFrame(tree.rows, columns=POINT_NAMES)
                tree.rows.clear()
    if tree:
        tree.close()
        yield pd.DataFrame(tree.rows, columns=POINT_NAMES)


def compressed(strings: DataFrame) -> DataFrame:
    """The points of the whole tree, one row each in the form of POINT, for ``conv, codes, sizes`` (codes as hex)."""
    whole = strings.select("conv", F.unhex(F.array_join("codes", "")).alias("codes"), "sizes")
    distinct = whole.groupBy(F.sha2("codes", 256).alias("string")).agg(F.first("codes").alias("codes"), F.first("sizes").alias("sizes"), F.count("*").alias("members"), F.min("conv").alias("least"))
    dealt = stored(distinct.drop("string").repartitionByRange("codes").withColumn("pid", F.spark_partition_id()), "trie-strings")
    ends = [(r["pid"], bytes(r["low"]), bytes(r["high"])) for r in dealt.groupBy("pid").agg(F.min("codes").alias("low"), F.max("codes").alias("high")).orderBy("pid").collect()]  # two strings a partition
    met = [-1, *(common(a[2], b[1]) for a, b in zip(ends, ends[1:])), -1]
    borders = {pid: (met[k], met[k + 1], high[: max(0, met[k + 1]) * CODE]) for k, (pid, _, high) in enumerate(ends)}
    told = strings.sparkSession.sparkContext.broadcast(borders)
    parts = stored(dealt.repartition("pid").sortWithinPartitions("pid", "codes").mapInPandas(functools.partial(_built, borders=told), POINT), "trie-parts")
    sums = [F.sum(c).alias(c) for c in ("members", "children", "leaves", "weighed", "once", "ends")]
    merged = parts.where("shared").groupBy("key").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "above")], F.min("conv").alias("conv"), *sums, F.first("tail").alias("tail"))
    points = stored(parts.where("NOT shared").drop("shared").unionByName(merged), "trie-points")
    discard(dealt, parts)
    return points


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one key's sorted ids as text, one row for each run of a batch."""
    for f in frames:
        if len(f):
            keys, ids = f["key"].to_numpy(), f["conv"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(f)]
            yield pd.DataFrame([(keys[a], ids[a], ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(cuts, cuts[1:])], columns=["key", "first", "ids"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each key's chunks, which come in order; only its state is held."""
    at, state = None, None
    for f in frames:
        done = []
        for key, ids in zip(f["key"], f["ids"]):
            if key != at:
                if state:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["key", "digest"])
    if state:
        yield pd.DataFrame([(at, state.hexdigest())], columns=["key", "digest"])


def member_digests(strings: DataFrame) -> DataFrame:
    """``key, digest``: SHA-256 of the comma-joined sorted ids of the conversations that are one string.

    Ids are sorted over the cluster and joined to chunks there; a digest is one sequence by its definition,
    so the chunks of one string stream through one task, which holds no more than a batch of them."""
    ends = strings.select(F.md5(F.unhex(F.array_join("codes", ""))).alias("key"), "conv")
    chunks = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInPandas(_chunks, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInPandas(_digests, "key string, digest string")


def prefix_trie(
    df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 0, heads: int = 0
) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member) ``, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; conversation and depth name a node.

    Conversations are the rows of an id in the order of their turns, null first; turns of one number are ordered
    by the hash of role and text.  With ``group`` and ``heads`` they are rebuilt as ``grafted`` says.  Null roles
    and texts count as empty; rows without an id take no part; repeated rows are turns of their own; other
    columns are ignored; an empty table gives an empty result.  ``saved_tokens`` sums (members - 1) x UTF-8 bytes of
    a node's last text over its subtree.

    A conversation is one row of 24 bytes a turn, whatever its texts' length; texts are read once and never moved."""
    strings = turn_strings(df, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    if group:
        own = stored(strings, "trie-own")
        strings = stored(grafted(own, group, heads), "trie-rebuilt")
        discard(own)
    else:
        strings = stored(strings, "trie-rebuilt")
    points = compressed(strings)
    digests = stored(member_digests(strings), "trie-ends")
    discard(strings)
    known = points.join(digests, "key", "left").withColumn("saved", F.col("weighed") - F.col("once"))
    inner = spread_join(known.where("parent IS NOT NULL"), points.select(F.col("key").alias("parent"), F.col("conv").alias("up")), "parent")
    nodes = inner.unionByName(known.where("parent IS NULL").withColumn("up", F.lit(None).cast("long")))
    expanded = """concat(
        array(named_struct('depth', depth, 'up', if(size(tail) = 0, up, conv), 'children', children, 'saved', saved, 'digest', digest)),
        transform(tail, (x, i) -> named_struct('depth', above + 1 + i, 'up', if(i = 0, up, conv), 'children', 1L, 'saved', saved + x, 'digest', CAST(NULL AS STRING))))"""
    rows = nodes.selectExpr("conv", "members", "leaves", f"explode({expanded}) AS n")
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("n.depth").alias("depth"), F.col("n.up").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("n.children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("n.saved").alias("saved_tokens"), F.coalesce("n.digest", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
