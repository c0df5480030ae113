"""Connected components of a link table by alternating large and small stars.

The method is that of Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014).  All state is a table of links in the shared folder; every
step is an aggregate and a join.  What a centre of many links knows reaches
them by broadcast, so no component meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import by_shuffle, discard, stored

#: Links of a centre that is told to them by broadcast; there are fewer such centres than links by this factor.
MANY = 20_000


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Every node sends its larger (or smaller) neighbours to the smallest node it knows."""
    both = links.select("a", "b") if not large else links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # here a is the centre; small stars look only at smaller neighbours, so links point from the larger end
    both = both if large else both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    large_ones = F.broadcast(least.where(F.col("n") >= MANY).select("a", "m"))
    sent = both.join(large_ones, "a").unionByName(both.join(large_ones.select("a"), "a", "left_anti").join(by_shuffle(least.where(F.col("n") < MANY).select("a", "m")), "a"))
    if large:
        return sent.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return sent.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named by its smallest node."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        for large in (True, False):
            made = _stars(links, large).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            old, links = links, stored(made, "links")
            discard(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    named = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
    made = stored(named, "components")
    discard(links)
    return made
