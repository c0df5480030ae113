"""The wide range of the SimHash operator: groups of texts by the Jaccard similarity of word shingles.

Copies that differ little are found by the operator's own join, the grid of
segment counts over fingerprints at RANGE bits.  At a similarity of 0.8,
though, fingerprints differ in 10 of 64 bits on average, and a grid of that
range has no selective cells; what the join leaves apart is therefore looked
for by prefixes.  All shingles have one order, from rare to frequent by a
table of counts that grows with the input, so that a passage that many
documents share comes last.  If the first shingle that two texts share has
r shingles behind it in each, itself included, they share at most the smaller
r; so texts of n and m shingles can have similarity s only if
``s (n + m) <= (1 + s) min(r)``.  That bound decides which shingles a text is
looked for by, which shorter or equal texts it meets there, and loses no pair.
The order only decides how many candidates there are.

A key's texts are first compared with one of them, which takes as many
comparisons as texts, a few times over with another one.  Only texts of a key that no chain of links has joined
yet then meet each other, under the bound and by bins of size, so every link
that could join two groups is looked at and a group of copies makes no square
of pairs.  Every candidate is decided by the exact intersection of both sets
of shingles; a set is made once and texts are never moved to pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import discard, slices, spread_join, stored
from skerry.llm.components import connected_components
from skerry.llm.simhash import bits_of, linked_pairs

WIDTH, SIMILARITY = 5, 0.8
#: Counters of one part of the shingles' table; the table's least and most (16 MB) parts' doublings; bytes of text for a counter.
PART_BITS, MORE_BITS, COUNTER_BYTES = 16, (0, 6), 800
#: How often a key's texts are compared with one of them before those still apart meet each other.
ROUNDS = 2
#: Ratio of the sizes of a bin in which texts that are still apart meet.
BIN = 1.1
_HASH = functools.partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (A-Z lower-cased); of a shorter text the whole of it."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([_HASH(line)], np.uint64)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum() - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(line.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    return np.unique(np.fromiter(map(_HASH, spans), np.uint64, len(words) - width + 1))


def _tallied(frames: Iterator[pd.DataFrame], width: int, bits: int) -> Iterator[pd.DataFrame]:
    """How often shingles fall on each counter, in parts of the table."""
    table = np.zeros(1 << bits, np.uint32)
    for frame in slices(frames):
        for t in frame["text"]:
            np.add.at(table, _counter(shingles(t, width), bits), np.uint32(1))
    parts = np.minimum(table, 65_535).astype(np.uint16).reshape(-1, 1 << PART_BITS)
    number = TaskContext.get().partitionId() if TaskContext.get() else 0
    yield pd.DataFrame({"part": np.arange(len(parts)), "of": number, "counts": [x.tobytes() for x in parts]})


def _counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of some partitions' parts; counts beyond 16 bits are all frequent."""
    total = np.zeros(1 << PART_BITS, np.uint64)
    for x in rows["counts"]:
        total += np.frombuffer(x, np.uint16)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "of": 0, "counts": [np.minimum(total, 65_535).astype(np.uint16).tobytes()]})


def shingle_table(texts: DataFrame, width: int) -> np.ndarray:
    """Counts over all texts of the shingles that fall on each counter; the number of counters follows the bytes of text.

    Summed in two steps, so that no task sees more parts than the root of the number of partitions."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = PART_BITS + min(MORE_BITS[1], max(MORE_BITS[0], (size // COUNTER_BYTES).bit_length() - PART_BITS))
    kind = "part int, of int, counts binary"
    parts = texts.select("text").mapInPandas(functools.partial(_tallied, width=width, bits=bits), kind)
    step = math.isqrt(texts.rdd.getNumPartitions()) + 1
    first = parts.groupBy("part", F.pmod("of", F.lit(step))).applyInPandas(_added, kind)
    table = np.zeros((1 << (bits - PART_BITS), 1 << PART_BITS), np.uint16)
    for r in first.groupBy("part").applyInPandas(_added, kind).collect():
        table[r["part"]] = np.frombuffer(r["counts"], np.uint16)
    return table.ravel()


def prefix(hashes: np.ndarray, table: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles, of which two texts of that similarity share one; ties by the hash, so that all texts have one order."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((hashes, table[_counter(hashes, len(table).bit_length() - 1)]))
    return hashes[order[: n - math.ceil(similarity * n - 1e-9) + 1]].view(np.int64)


def signs(text: Column, width: int, similarity: float, table) -> Column:
    """A struct of the text's node (the hash of its shingles), fingerprint, number of shingles and prefix; a text without
    shingles has node and fingerprint 0 and no prefix.  ``table`` is a broadcast one."""

    @F.pandas_udf("node long, fp long, n long, keys array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, prints, counts, keys = [], [], [], []
            for t in batch:
                h = shingles(t or "", width)
                nodes.append(_HASH(h.tobytes()) if len(h) else 0)
                prints.append(bits_of(h))
                counts.append(len(h))
                keys.append(prefix(h, table.value, similarity))
            signed = {"node": np.array(nodes, np.uint64).view(np.int64), "fp": np.array(prints, np.uint64).view(np.int64)}
            yield pd.DataFrame(signed | {"n": counts, "keys": keys})

    return made(text.cast("string"))


def _sets(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        yield pd.DataFrame({"node": frame["node"].to_numpy(), "set": [shingles(t, width).view(np.int64) for t in frame["text"]]})


def near_copies(df: DataFrame, *, id_col: str, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows as ``row, own, text, node, fp, u`` with a number ``u`` of their own, and ``node, root`` of all nodes.

    Texts of equal shingles are one node; links join nodes whose shingles have ``similarity`` at least."""
    text = F.col(f"`{text_col}`").cast("string")
    table = df.sparkSession.sparkContext.broadcast(shingle_table(df.select(F.coalesce(text, F.lit("")).alias("text")), width))  # 8 MB at most
    signed = df.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("own"), signs(text, width, similarity, table).alias("s"))
    signed = stored(signed.select("row", "own", "s.*").withColumn("u", F.monotonically_increasing_id()), "near-signed")
    rows = signed.select("row", "own", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).alias("text"), "node", "fp", "u")
    heads = signed.groupBy("node").agg(F.min("u").alias("u")).select("u")  # one row of each node, found without moving its keys
    points = stored(signed.join(heads, "u", "left_semi").select("node", "fp", "n", "keys", "u"), "near-points")
    scratch = [points]

    def held(table: DataFrame, name: str) -> DataFrame:
        scratch.append(stored(table, name))
        return scratch[-1]

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of some pairs ``a, b`` whose sets are similar enough."""
        pairs = held(pairs.distinct(), "near-pairs")
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = rows.select("u", "text").join(points.select("u", "node").join(asked, "node"), "u")
        sets = held(texts.select("node", "text").mapInPandas(functools.partial(_sets, width=width), "node long, set array<long>"), "near-sets")
        for k in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")), k)
        sized = pairs.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
        return held(sized.where((F.col("both") > 0) & (F.col("both") >= F.lit(similarity) * (F.col("all") - F.col("both")))).select("a", "b"), "near-links")

    # each by an index: no text is larger than its partner's share allows, and the bound on what both can share holds
    # (sets of one size that are not the same share one shingle less than they have)
    bound = lambda n, m, r, q: F.lit(similarity) * (n + m) <= F.lit(1 + similarity) * F.least(r, q, n - (n == m).cast("int")) + F.lit(1e-9)
    fit = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def rooted(keyed: DataFrame) -> DataFrame:
        scratch.append(connected_components(links))
        return keyed.join(scratch[-1], "node", "left").select("key", "node", "n", "r", F.coalesce("component", "node").alias("root"))

    near = F.lit(2 * similarity) * F.col("n") <= F.lit(1 + similarity) * F.col("r") + F.lit(1e-9)  # shingles by which a text is found by texts of its size or larger

    # nodes of one fingerprint, and of linked fingerprints, each by its smallest node
    prints = points.where("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")).select("fp", "head.*")
    end = lambda k: prints.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}"), F.col("n").alias(f"n_{k}"))
    close = linked_pairs(prints.select("fp")).join(end("a"), "a").join(end("b"), "b").where(fit("n_a", "n_b")).select(*pair("node_a", "node_b"))
    same = points.where("n > 0").join(end("fp"), "fp").where((F.col("node") != F.col("node_fp")) & fit("n", "n_fp")).select(*pair("node", "node_fp"))
    links = alike(close.unionByName(same))

    # the wider range: a key's texts against the smallest one that is found there, then those that are still apart
    placed = points.select("node", "n", F.posexplode("keys").alias("at", "key")).select("node", "n", "key", (F.col("n") - F.col("at")).alias("r"))
    of_key = Window.partitionBy("key")
    shared = placed.select("*", F.count("*").over(of_key).alias("held"), F.count_if(near).over(of_key).alias("found")).where("held > 1 AND found > 0")
    placed, tried = held(shared.drop("held", "found"), "near-placed"), []
    for turn in range(ROUNDS):  # each time against another one, so that a group falls into few parts
        met = rooted(placed)
        head = F.struct((F.col("n") - F.col("r")).alias("d"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "r", "root")  # one with few rarer shingles is like most
        least = met.groupBy("key").agg(F.min(F.when(near, head)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        least = least.select("key", *[F.col(f"m.{c}").alias(f"{c}_a") for c in ("node", "n", "r", "root")])
        found = met.join(least, "key").where((F.col("root") != F.col("root_a")) & bound(F.col("n"), F.col("n_a"), F.col("r"), F.col("r_a"))).select(*pair("node", "node_a")).distinct()
        for before in tried:
            found = found.join(before, ["a", "b"], "left_anti")
        tried.append(held(found, "near-tried"))
        links = links.unionByName(alike(tried[-1]))
    met = rooted(placed)
    open_ = met.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    apart = held(met.join(open_, "key"), "near-apart")
    bin_of = lambda n: F.floor(F.log(n) / math.log(BIN)).cast("int")
    most = F.least(F.col("n").cast("double"), F.col("r") * ((1 + similarity) / similarity) - F.col("n") + 1e-6)  # the largest partner that is no longer than itself
    bins = F.sequence(bin_of(F.col("n") * similarity) - 1, bin_of(most))
    probes = apart.where(most >= 1).select("key", "node", "n", "r", "root", F.explode(F.when(bin_of(most) >= bin_of(F.col("n") * similarity) - 1, bins)).alias("bin"))
    index = apart.where(near).select("key", bin_of(F.col("n")).alias("bin"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "r", "root")])
    fits = (F.col("n_b") <= F.col("n")) & (F.col("root") != F.col("root_b")) & bound(F.col("n"), F.col("n_b"), F.col("r"), F.col("r_b"))
    rest = probes.join(index, ["key", "bin"]).where(fits).select(*pair("node", "node_b")).distinct()
    for before in tried:
        rest = rest.join(before, ["a", "b"], "left_anti")
    links = links.unionByName(alike(rest))
    roots = connected_components(links)
    named = points.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    named = stored(named, "near-roots")
    discard(*scratch, roots)
    return rows, named


def near_copy_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (of ``width``-word shingles, 16 hex digits) ``,
    component_id``, the smallest id that links of texts with at least ``similarity`` reach, itself included.

    A null text counts as empty, and texts without words are alike.  Ids that are null take part but never
    name a group, unless all of its ids are null.  Repeated rows stay; other columns are ignored; an empty
    table gives an empty result."""
    rows, roots = near_copies(df, id_col=id_col, text_col=text_col, width=width, similarity=similarity)
    least = rows.groupBy("node").agg(F.min("own").alias("own")).join(roots, "node")
    names = least.groupBy("root").agg(F.min("own").alias("component_id"))
    named = stored(spread_join(roots, names, "root").select("node", "component_id"), "near-groups")
    return spread_join(rows.select("own", "fp", "node"), named, "node").select(F.col("own").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id, of several such rows
    that of the smallest text, of equal ones any.  A row without an id stays only where no row of its group
    has one.  Else as ``near_copy_groups``."""
    rows, roots = near_copies(df, id_col=id_col, text_col=text_col, width=width, similarity=similarity)
    first = F.struct(F.col("own").isNull().alias("none"), "own", F.xxhash64("text").alias("h"), "u").alias("first")
    least = rows.select("node", first).groupBy("node").agg(F.min("first").alias("first"))
    chosen = stored(least.join(roots, "node").groupBy("root").agg(F.min("first").alias("first")).select("first.u"), "near-kept")
    return rows.select("row", "u").join(chosen, "u", "left_semi").select("row.*")
