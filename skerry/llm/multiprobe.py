"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``width`` Gaussian projections of a vector
into cells.  A query visits its own bucket of a table and the buckets with
perturbed cells, in the order of their estimated success (Lv et al.,
"Multi-probe LSH", 2007): the expected order of perturbation sets is laid out
once and then sorted by the query's own distances to its cells' borders.
Candidates of all tables are merged and ranked by their exact distance.

Equal vectors are indexed once, with their smallest ids.  A bucket of many
vectors is dealt to blocks; its queries go to all of them, and each block
answers with its nearest only, so neither a pair of rows nor a whole bucket
is ever in one place.  Every vector is indexed; the sample that sets the
cells' size is bounded by ``sample_rows``.

Few tables with many probes: the index holds each vector once a table, while
a query's probes are only numbers.  A query sends its vector once to each
slot that its probes fall on.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.common import stored

TABLES, HASHES, PROBES, NEAREST = 4, 12, 1200, 10
#: Cell size in units of the sample's distance to its tenth neighbour.
CELL, SAMPLE_ROWS, SALTS, BLOCK_ROWS, SEED = 2.2, 2_000, 64, 1_024, 7


@functools.lru_cache(maxsize=8)
def perturbation_sets(hashes: int, count: int) -> np.ndarray:
    """The ``count`` likeliest sets of steps, as 0/1 rows over the ``2 * hashes`` steps sorted by distance.

    Scores are the expected squares of sorted distances; a set holds no step together with its opposite."""
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
    back = j[::-1]
    far = 1 - back / (m + 1) + back * (back + 1) / (4.0 * (m + 1) * (m + 2))
    score = np.r_[near, far]
    rows = [np.zeros(2 * m, np.int8)]
    heap = [(score[0], (0,))]
    while heap and len(rows) < count:
        s, steps = heapq.heappop(heap)
        if all(2 * m - 1 - k not in steps for k in steps):
            row = np.zeros(2 * m, np.int8)
            row[list(steps)] = 1
            rows.append(row)
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*steps, last + 1)))
    return np.array(rows)


class Hashes:
    """Projections and offsets of all tables, for vectors of one dimension."""

    def __init__(self, dimension: int, cell: float, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED):
        rng = np.random.default_rng([seed, dimension])
        self.tables, self.hashes, self.cell = tables, hashes, cell
        self.direction = rng.standard_normal((dimension, tables * hashes))
        self.offset = rng.random(tables * hashes)
        self.mix = rng.integers(1, 2**63 - 1, hashes, dtype=np.int64) | 1
        self.probes = probes
        self.sets = perturbation_sets(hashes, 3 * probes)

    def places(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.direction / self.cell + self.offset).reshape(len(x), self.tables, self.hashes)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of the last axis; buckets that share a number by chance only add candidates."""
        with np.errstate(over="ignore"):
            k = (cells.astype(np.int64) * self.mix).sum(-1)
            return (k ^ (k >> np.int64(29))) * np.int64(-7046029254386353131)

    def own(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.places(x)))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes) bucket numbers, the likeliest first."""
        place = self.places(x)
        cell = np.floor(place)
        inside = place - cell
        distance = np.concatenate([inside, 1 - inside], -1)  # to the lower border, to the upper one
        step = np.r_[np.full(self.hashes, -1), np.full(self.hashes, 1)]
        order = distance.argsort(-1, kind="stable")
        sorted_ = np.take_along_axis(distance, order, -1) ** 2
        score = sorted_ @ self.sets.T.astype(float)
        best = np.argsort(score, -1, kind="stable")[..., : self.probes]
        with np.errstate(over="ignore"):
            moved = step[order] * self.mix[order % self.hashes]  # each step's change of the mixed sum
            base = (cell.astype(np.int64) * self.mix).sum(-1)
            k = base[..., None] + np.take_along_axis(moved.astype(np.int64) @ self.sets.T.astype(np.int64), best, -1)
            return (k ^ (k >> np.int64(29))) * np.int64(-7046029254386353131)


#: Index entries (a vector in a table) that one task slot holds, about.
SLOT_ENTRIES = 20_000


def vectors_of(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix, for each dimension."""
    lengths = np.fromiter(map(len, column), np.int64, len(column))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.stack([np.asarray(column.iloc[k], float) for k in rows])


def _indexed(frames: Iterator[pd.DataFrame], cell: float, setup: tuple) -> Iterator[pd.DataFrame]:
    for f in frames:
        for rows, x in vectors_of(f["vec"]):
            h = Hashes(x.shape[1], cell, *setup)
            keys = h.own(x) + np.arange(h.tables)[None, :]
            part = f.iloc[rows]
            yield pd.DataFrame({"key": keys.ravel(), "gid": np.repeat(part["gid"].to_numpy(), h.tables), "vec": np.repeat(part["vec"].to_numpy(), h.tables)})


def _probes(frames: Iterator[pd.DataFrame], cell: float, setup: tuple) -> Iterator[pd.DataFrame]:
    for f in frames:
        for rows, x in vectors_of(f["vec"]):
            h = Hashes(x.shape[1], cell, *setup)
            for a in range(0, len(rows), 64):
                keys = h.probed(x[a : a + 64]) + np.arange(h.tables)[None, :, None]
                yield pd.DataFrame({"query": np.repeat(f["query"].to_numpy()[rows[a : a + 64]], keys[0].size), "key": keys.ravel()}).drop_duplicates()


def nearest_in(query: np.ndarray, gid: np.ndarray, x: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest of some rows by exact distance, ties to the smaller id."""
    rows = rows[np.unique(gid[rows], return_index=True)[1]]
    distance = np.sqrt(((x[rows] - query) ** 2).sum(1))
    if len(rows) > 4 * count:
        few = distance <= np.partition(distance, count - 1)[count - 1]
        rows, distance = rows[few], distance[few]
    order = np.lexsort((gid[rows], distance))[:count]
    return gid[rows[order]], distance[order]


def _ranked(index: pd.DataFrame, queries: pd.DataFrame, count: int, by_key: bool) -> pd.DataFrame:
    """One slot: each of its queries' nearest among the entries of the buckets that it visits, or among all."""
    out: list[tuple] = []
    for rows, x in vectors_of(index["vec"]) if len(index) and len(queries) else ():
        gid = index["gid"].to_numpy()[rows]
        if by_key:
            keys = index["key"].to_numpy()[rows]
            order = keys.argsort(kind="stable")
            gid, x, keys = gid[order], x[order], keys[order]
        for q, v, wanted in zip(queries["query"], queries["vec"], queries["keys"]):
            if len(v) != x.shape[1]:
                continue
            hit = np.arange(len(x))
            if by_key:
                low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                n = high - low
                if not n.sum():
                    continue
                hit = np.repeat(low - np.r_[0, n[:-1]].cumsum(), n) + np.arange(n.sum())
            found, distance = nearest_in(np.asarray(v, float), gid, x, hit, count)
            out += zip([q] * len(found), found.tolist(), distance.tolist())
    return pd.DataFrame(out, columns=["query", "gid", "score"])


FOUND = "query long, gid long, score double"


def sampled_scale(groups: DataFrame, rows: int, seed: int = SEED) -> float:
    """Median distance to the tenth neighbour in a sample of ``rows`` vectors, the unit of the cells' size."""
    few = groups.orderBy(F.xxhash64("gid", F.lit(seed))).limit(rows).select("vec").toPandas()
    scales = []
    for _, x in vectors_of(few["vec"]) if len(few) else ():
        if len(x) > 1:
            square = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
            near = np.sort(np.sqrt(square), 1)[:, min(NEAREST, len(x) - 1)]
            scales.append((float(np.median(near)), len(x)))
    scale = max(scales, key=lambda s: s[1])[0] if scales else 1.0
    return scale if scale > 0 else 1.0


def nearest_neighbours(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, nearest: int = NEAREST,
    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, cell: float = CELL, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each query, the nearest first.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.
    Nearness is the Euclidean distance in double precision, ties go to the smaller id.  Vectors that are
    null, zero or hold null or non-finite components, and null ids, take no part; vectors of different
    lengths never meet.  Repeated rows of an id count once; an id with several vectors is one query that
    takes the nearest to any.  A query that finds fewer than ``nearest`` in its buckets is searched in all
    rows exactly.  Other columns are ignored; an empty table gives an empty result.
    """
    setup = (tables, hashes, probes)
    vec = F.col("vec")
    sound = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vid"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec")).where(F.col("vid").isNotNull() & sound)
    first = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, nearest + 1)
    salted = rows.groupBy("vec", F.pmod(F.xxhash64("vid"), F.lit(SALTS)).alias("salt")).agg(first(F.collect_set("vid")).alias("ids"))
    groups = salted.groupBy("vec").agg(first(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("gid", F.col("ids")[0])
    groups = stored(groups, "ann-groups")  # distinct vectors with their smallest ids
    queries = stored(rows.where(F.col("vid") % every == 0).select(F.col("vid").alias("query"), "vec").distinct(), "ann-queries")
    scale = sampled_scale(groups, sample_rows) * cell
    count = groups.count()
    slots = max(1, -(-count * tables // SLOT_ENTRIES))
    index = stored(groups.select("gid", "vec").mapInPandas(functools.partial(_indexed, cell=scale, setup=setup), "key long, gid long, vec array<double>"), "ann-index")
    crowded = index.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    crowded = stored(crowded, "ann-crowded")
    slot = F.pmod(F.xxhash64("key", "block"), F.lit(slots)).cast("int").alias("slot")
    entries = (
        index.join(F.broadcast(crowded), "key", "left")  # fewer rows than entries by BLOCK_ROWS
        .withColumn("block", F.pmod(F.xxhash64("gid"), F.coalesce("blocks", F.lit(1))).cast("int"))
        .select(slot, "key", "gid", "vec")
    )
    visits = (
        queries.mapInPandas(functools.partial(_probes, cell=scale, setup=setup), "query long, key long")
        .join(F.broadcast(crowded), "key", "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select(slot, "query", "key")
        .groupBy("slot", "query")
        .agg(F.collect_set("key").alias("keys"))
        .join(queries, "query")
    )
    found = stored(entries.groupBy("slot").cogroup(visits.groupBy("slot")).applyInPandas(functools.partial(_ranked, count=nearest + 1, by_key=True), FOUND), "ann-found")
    short = queries.join(found.groupBy("query").agg(F.countDistinct("gid").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) <= min(nearest, count - 1)).select("query", "vec")
    short = stored(short, "ann-short")
    if short.limit(1).count():
        blocks = max(1, -(-count // SLOT_ENTRIES))
        dealt = groups.select(F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int").alias("slot"), F.lit(0).cast("long").alias("key"), "gid", "vec")
        asked = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("slot"), "query", F.array().cast("array<long>").alias("keys"), "vec")
        exact = dealt.groupBy("slot").cogroup(asked.groupBy("slot")).applyInPandas(functools.partial(_ranked, count=nearest + 1, by_key=False), FOUND)
        found = found.unionByName(exact)
    best = found.groupBy("query", "gid").agg(F.min("score").alias("score"))
    few = best.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("score", "gid"))).where(F.col("k") <= nearest + 1)
    ranked = few.join(groups.select("gid", "ids"), "gid").select("query", F.explode("ids").alias("vid"), "score").where("vid <> query").groupBy("query", "vid").agg(F.min("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vid"))).where(F.col("rank") <= nearest)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("vid").alias("vec_id"), "score")
