"""Hard negatives by inner products of integer vectors, pruned by an orthogonal PCA rotation.

A rotation keeps inner products and puts most of the vectors' length into
their first components.  Blocks of anchors meet blocks of candidates; each
block accumulates the products of the leading components in steps.  By Cauchy
and Schwarz the rest is at most the product of the residual norms, to which
slack for rounding is added, so every score lies between two known bounds.
Pairs that can no longer reach a wanted place are discarded after each step,
and what survives is decided by integer products of the original vectors.
The rotation and its sample thus change the work, never the result.

Equal vectors of one label are one candidate with its smallest ids.  A first
round finds the nearest rows of each anchor's own label; a second one looks
for the rows of other labels whose score lies in the window of each positive.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import discard, spread_join, stored

EVERY, POSITIVES, NEGATIVES, LEAST = 100, 5, 5, (4, 5)
#: Candidates and anchors of a block, anchors handled at once, pairs verified at once, rows that lend the rotation.
BLOCK_ROWS, BLOCK_ANCHORS, CHUNK, PAIRS, SAMPLE_ROWS = 4_096, 4_096, 64, 50_000, 5_000
STEPS = 4
#: A row whose integer vector has a larger squared length could have scores beyond 64 bits.
LONGEST_SQUARE = 9.0e18


class Rotated:
    """Integer vectors, their rotated form, and the norms of what remains behind each step."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray, off: float):
        d = vectors.shape[1]
        self.whole = vectors
        self.turned = vectors.astype(float) @ basis
        self.cuts = sorted({-(-d * k // STEPS) for k in range(1, STEPS + 1)} - {0})
        square = self.turned**2
        self.residual = [np.sqrt(square[:, c:].sum(1)) * (1 + 4 * d * np.finfo(float).eps) for c in self.cuts]
        self.norm = np.sqrt(square.sum(1))
        self.slack = off + 8 * d**1.5 * np.finfo(float).eps

    def __len__(self) -> int:
        return len(self.whole)


def survivors(anchors: Rotated, rows: slice, others: Rotated, may: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of ``anchors[rows]`` and ``others`` that ``wanted(low, high, may)`` keeps to the end, as anchor and candidate
    numbers and exact scores, and how many products of components were spent.

    ``may`` tells the pairs that count at all; ``wanted`` gets bounds of their scores after each step."""
    live = np.flatnonzero(may.any(0))
    may, done, spent = may[:, live], 0, 0
    partial = np.zeros(may.shape)
    slack = anchors.slack * anchors.norm[rows, None] * others.norm[None, live]
    for k, cut in enumerate(anchors.cuts):
        partial += anchors.turned[rows, done:cut] @ others.turned[live, done:cut].T
        spent += partial.size * (cut - done)
        bound = anchors.residual[k][rows, None] * others.residual[k][None, live] + slack
        may &= wanted(partial - bound, partial + bound, may)
        stay, done = may.any(0), cut
        live, partial, may, slack = live[stay], partial[:, stay], may[:, stay], slack[:, stay]
    a, b = may.nonzero()
    exact = np.zeros(len(a), np.int64)
    for x in range(0, len(a), PAIRS):
        exact[x : x + PAIRS] = np.einsum("ij,ij->i", anchors.whole[rows][a[x : x + PAIRS]], others.whole[live[b[x : x + PAIRS]]])
    return a, live[b], exact, spent


def _kth(low: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k``-th largest of its values that count, or minus infinity."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return -np.partition(np.where(of, -low, np.inf), k - 1, axis=1)[:, k - 1]


def best(low: np.ndarray, high: np.ndarray, may: np.ndarray, count: int) -> np.ndarray:
    """Pairs that may be among the ``count`` best of their anchor."""
    return high >= _kth(low, may, count)[:, None]


def within(low: np.ndarray, high: np.ndarray, may: np.ndarray, tops: np.ndarray, count: int) -> np.ndarray:
    """Pairs that may be among the ``count`` best of a window: from four fifths of one of the anchor's ``tops`` to that
    itself; absent tops are NaN."""
    kept = np.zeros(may.shape, bool)
    for top in tops.T:
        least = top * (LEAST[0] / LEAST[1])
        give = 1e-12 * np.abs(top) + 1  # scores are whole numbers, and this is more than rounding
        sure = may & (low >= (least + give)[:, None]) & (high <= (top - give)[:, None])
        reach = np.fmax(_kth(low, sure, count), least - give)
        kept |= (high >= reach[:, None]) & (low <= (top + give)[:, None])
    return kept


def _blocks(others: pd.DataFrame, anchors: pd.DataFrame, basis) -> Iterator[tuple[Rotated, pd.DataFrame, Rotated, pd.DataFrame]]:
    """Anchors and candidates of one dimension, rotated; anchors in the order of their labels."""
    anchors = anchors.sort_values("label", kind="stable")
    for d in sorted(set(anchors["vec"].str.len()) & set(others["vec"].str.len())):
        own, met = anchors[anchors["vec"].str.len() == d], others[others["vec"].str.len() == d]
        turn = basis.value.get(d, (np.eye(d), 0.0))
        yield *(x for f in (own, met) for x in (Rotated(np.stack([np.asarray(v, np.int64) for v in f["vec"]]), *turn), f)),


def _runs(labels: np.ndarray) -> Iterator[slice]:
    """Slices of at most CHUNK anchors of one label each, which ask for the same candidates."""
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    for a, b in zip(cuts, cuts[1:]):
        yield from (slice(s, min(b, s + CHUNK)) for s in range(a, b, CHUNK))


def _positives(others: pd.DataFrame, anchors: pd.DataFrame, basis, count: int) -> pd.DataFrame:
    out = []
    for a, own, b, met in _blocks(others, anchors, basis):
        label, first, ids = met["label"].to_numpy(), met["ids"].str[0].to_numpy(), met["ids"].to_numpy()
        for part in _runs(own["label"].to_numpy()):
            may = own["label"].to_numpy()[part, None] == label[None, :]
            x, y, score, _ = survivors(a, part, b, may, functools.partial(best, count=count))
            order = np.lexsort((first[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            out += [(q, int(v), ids[k]) for q, v, k in zip(own["q"].to_numpy()[part][x[place < count]], score[place < count], y[place < count])]
    return pd.DataFrame(out, columns=["q", "score", "ids"])


def _negatives(others: pd.DataFrame, anchors: pd.DataFrame, basis, count: int) -> pd.DataFrame:
    out = []
    for a, own, b, met in _blocks(others, anchors, basis):
        label, first, ids = met["label"].to_numpy(), met["ids"].str[0].to_numpy(), met["ids"].to_numpy()
        for s in range(0, len(a), CHUNK):
            part = slice(s, min(len(a), s + CHUNK))
            asked = [np.asarray(t, np.int64) for t in own["tops"].iloc[part]]
            tops = np.full((len(asked), max(map(len, asked))), np.nan)
            for k, t in enumerate(asked):
                tops[k, : len(t)] = t
            may = own["label"].to_numpy()[part, None] != label[None, :]
            x, y, score, _ = survivors(a, part, b, may, functools.partial(within, tops=tops, count=count))
            order = np.lexsort((first[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            ends = np.searchsorted(x, np.arange(len(asked) + 1))
            for k, (q, t) in enumerate(zip(own["q"].iloc[part], asked)):
                mine, places = score[ends[k] : ends[k + 1]], y[ends[k] : ends[k + 1]]
                for top in t:
                    fit = np.flatnonzero((mine <= top) & (mine >= top - top // LEAST[1]))[:count]  # top - top // 5: four fifths, rounded up
                    out += [(q, int(top), int(mine[f]), ids[places[f]]) for f in fit]
    return pd.DataFrame(out, columns=["q", "top", "score", "ids"])


def rotations(groups: DataFrame, sample_rows: int) -> dict[int, tuple[np.ndarray, float]]:
    """For each dimension of a sample the principal axes, and how far they are from orthogonal."""
    few = groups.orderBy(F.xxhash64("q", F.lit(7))).limit(sample_rows).select("vec").toPandas()["vec"]
    made = {}
    for d in sorted(set(few.str.len())):
        x = np.stack([np.asarray(v, float) for v in few[few.str.len() == d]])
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        made[d] = np.ascontiguousarray(axes), float(np.linalg.norm(axes @ axes.T - np.eye(d))) if d else 0.0
    return made


def sound_rows(df: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vid, label, vec, q``: distinct rows with their integer vectors; ``q`` names label and vector."""
    vec, label = F.col("x"), F.col("l")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    square = F.aggregate(vec, F.lit(0.0), lambda s, v: s + (256 * v) * (256 * v))
    moved = F.when(F.col("vid") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vid"), F.col(f"`{label_col}`").cast("long").alias("l"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vid").isNotNull() & label.isNotNull() & vec.isNotNull()).where(finite).where(square < LONGEST_SQUARE)
    rows = rows.select("vid", moved.alias("label"), F.transform(vec, lambda v: F.floor(256 * v).cast("long")).alias("vec"))
    name = F.md5(F.concat_ws(":", F.col("label").cast("string"), F.array_join(F.transform("vec", lambda v: v.cast("string")), ",")).cast("binary"))
    return rows.withColumn("q", name).groupBy("vid", "q").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))


def hard_negatives(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  Components become floor(256 * x), scores are integer
    inner products, and an id divisible by 7 has label (label + 1) % 10.  An anchor's positives are its 5 best other
    rows of its label; each brings the 5 best rows of other labels that score from 80 to 100 of its own score's
    hundredths.  Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those whose
    integer vector's squared length nears 2 ** 63, as their scores are no longs.  Vectors of different lengths never
    meet.  Repeated rows count once; unlike rows of one id are rows of their own, but never positives of
    that id.  Other columns are ignored; an empty table gives an empty result."""
    spark = df.sparkSession
    rows = stored(sound_rows(df, id_col=id_col, vector_col=vector_col, label_col=label_col), "hard-rows")
    few = max(POSITIVES + 1, NEGATIVES)
    order = Window.partitionBy("q").orderBy("vid")  # Spark cuts each partition's rows to the first few before they are dealt out
    ranked = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= few)
    groups = ranked.groupBy("q").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.sort_array(F.collect_list("vid")).alias("ids"))
    groups = stored(groups, "hard-groups")
    anchors = stored(rows.where(F.col("vid") % every == 0).select(F.col("vid").alias("anchor"), "q"), "hard-anchors")
    asked = stored(groups.join(anchors.select("q").distinct(), "q", "left_semi").select("q", "label", "vec"), "hard-asked")
    basis = spark.sparkContext.broadcast(rotations(groups, sample_rows))
    held, many = groups.count(), asked.count()
    beside = max(1, -(-many // BLOCK_ANCHORS))
    # as many candidate blocks as memory asks for; while data are small, as many as keep the cluster busy
    blocks = max(1, -(-held // block_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), every * beside, held))
    slot = (F.col("block") * beside + F.col("side")).cast("long").alias("slot")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("side", every_of(beside)).select(slot, "label", "vec", "ids")

    def met(questions: DataFrame, work, kind: str) -> DataFrame:
        side = questions.withColumn("side", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(beside))).withColumn("block", every_of(blocks))
        side = side.select(slot, *questions.columns)
        return dealt.groupBy("slot").cogroup(side.groupBy("slot")).applyInPandas(work, kind)

    def first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
        """The best ``count`` rows of each key, from the best groups of each block."""
        near = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("ids")[0])
        some = found.withColumn("k", F.row_number().over(near)).where(F.col("k") <= count).select(*keys, "score", F.explode("ids").alias("vid"))
        return some.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vid"))).where(F.col("k") <= count)

    found = met(asked, functools.partial(_positives, basis=basis, count=POSITIVES + 1), "q string, score long, ids array<long>")
    near = first(found, ["q"], POSITIVES + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("k", "score", "vid"))).alias("near"))
    near = stored(near, "hard-positives")
    tops = F.array_distinct(F.filter("near.score", lambda s: s >= 0)).alias("tops")
    windows = asked.join(near.select("q", tops).where(F.size("tops") > 0), "q")
    found = met(windows, functools.partial(_negatives, basis=basis, count=NEGATIVES), "q string, top long, score long, ids array<long>")
    far = first(found, ["q", "top"], NEGATIVES).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("top", "k", "vid", "score"))).alias("far"))
    facts = stored(near.join(far, "q"), "hard-facts")
    discard(rows, groups, asked, near)
    whole = spread_join(anchors, facts, "q")
    own = F.slice(F.filter("near", lambda n: n["vid"] != F.col("anchor")), 1, POSITIVES)
    pairs = whole.select("anchor", "far", F.explode(own).alias("p"))
    return pairs.select("anchor", "p", F.explode(F.filter("far", lambda n: n["top"] == F.col("p.score"))).alias("n")).select(
        F.col("anchor").alias("anchor_id"), F.col("p.vid").alias("positive_id"), F.col("n.k").cast("int").alias("rank"), F.col("n.vid").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
