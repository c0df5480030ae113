"""A paged job feed: which saved pages belong to a read, and the latest state of each ad as a stream."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skerry.sources.scratch import written

MOST_PAGES = 450
#: The form of a saved page.
PAGE = "url string, status int, next_url string, items array<struct<uuid: string, status: string, business_name: string, modified: timestamp>>"
STATES = "uuid string, modified timestamp, sequence long, status string, business_name string, state string"


def read_pages(pages: DataFrame, first: str, most: int = MOST_PAGES) -> DataFrame:
    """The saved pages of one read with their ``place`` from 0: ``first``, and each page that the one before it names.

    A read ends with a page that has no items or names none, that failed (it is the last one here), that was
    not saved, or after ``most`` pages.  Pages are found by doubled steps, so a read of n pages takes log n joins."""
    good = (F.col("status") == 200) & (F.size("items") > 0) & (F.coalesce("next_url", F.lit("")) != "")
    steps = written(pages.where(good).select(F.col("url").alias("at"), F.col("next_url").alias("to")), "feed-steps")
    reached = written(pages.where(F.col("url") == first).select("url", F.lit(0).alias("place")), "feed-read")
    done = 1
    while done < most and steps.limit(1).count():
        further = reached.join(steps, F.col("url") == F.col("at")).select(F.col("to").alias("url"), (F.col("place") + done).alias("place"))
        reached = written(reached.unionByName(further), "feed-read")
        steps = written(steps.alias("a").join(steps.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"), "feed-steps")
        done *= 2
    once = reached.where(F.col("place") < most).groupBy("url").agg(F.min("place").alias("place"))  # a read that comes back to a page ends there
    return pages.join(once, "url")


def read_report(read: DataFrame, first: str, most: int = MOST_PAGES) -> DataFrame:
    """One row about a read: ``state`` (available, or failed without a good first page) ``, pages`` that were read, ``items``, ``note``."""
    good = F.col("status") == 200
    wanted = F.max_by(F.struct("status", "next_url", F.size("items").alias("held"), "place"), "place").alias("last")
    row = read.agg(F.count_if(good).alias("pages"), F.sum(F.when(good, F.size("items"))).alias("items"), wanted, F.collect_set("url").alias("urls"))  # at most ``most``
    broken = F.col("last.status") != 200
    cut = (F.col("last.status") == 200) & (F.col("last.held") > 0) & (F.coalesce("last.next_url", F.lit("")) != "") & (F.col("last.place") + 1 < most)
    reason = F.when(broken, F.col("last.status").cast("string")).when(cut & F.array_contains("urls", F.col("last.next_url")), "it came back to a page").when(cut, "a page was not saved")
    failed = F.col("pages") == 0
    note = F.when(failed, F.concat(F.lit("Feed page failed: "), F.coalesce(reason, F.lit("not saved")))).when(reason.isNotNull(), F.concat(F.lit("Feed read stopped early after "), F.col("pages"), F.lit(" pages: "), reason))
    return row.select(F.when(failed, "failed").otherwise("available").alias("state"), "pages", F.coalesce("items", F.lit(0)).alias("items"), note.alias("note"))


def entries(pages: DataFrame, place: str = "place") -> DataFrame:
    """``uuid, modified, sequence, status, business_name`` of the items of good pages; later pages and later items count as newer."""
    each = pages.where("status = 200").select(F.col(place).alias("_place"), F.posexplode("items").alias("at", "i")).where(F.coalesce("i.uuid", F.lit("")) != "")
    return each.select("i.uuid", "i.modified", (F.col("_place") * 1_000_000 + F.col("at")).cast("long").alias("sequence"), "i.status", "i.business_name")


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as they are saved to a folder as JSON lines with their ``place``, a stream."""
    return spark.readStream.schema(PAGE + ", place int").option("maxFilesPerTrigger", 1).json(folder)


class _Latest(StatefulProcessor):
    """The newest entry of one ad; it is forgotten once it is older than the look-back."""

    def __init__(self, lookback: datetime.timedelta):
        self.lookback = int(lookback.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "modified timestamp, sequence long, status string, business_name string")

    def _due(self, modified: datetime.datetime) -> int:
        return int(pd.Timestamp(modified).timestamp() * 1000) + self.lookback

    def _row(self, uuid: str, entry: tuple, state: str) -> pd.DataFrame:
        return pd.DataFrame([(uuid, *entry, state)], columns=["uuid", "modified", "sequence", "status", "business_name", "state"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.latest.get() if self.latest.exists() else None
        best = kept
        for frame in rows:
            for entry in frame[["modified", "sequence", "status", "business_name"]].itertuples(index=False, name=None):
                if best is None or entry[1] > best[1]:
                    best = entry
        if best is not kept and self._due(best[0]) > timerValues.getCurrentWatermarkInMs():
            if kept is not None:
                self.handle.deleteTimer(self._due(kept[0]))
            self.latest.update((pd.Timestamp(best[0]).to_pydatetime(), int(best[1]), best[2], best[3]))
            self.handle.registerTimer(self._due(best[0]))
            yield self._row(key[0], best, "active" if best[2] == "ACTIVE" else "inactive")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self._due(self.latest.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            gone = tuple(self.latest.get())
            self.latest.clear()
            yield self._row(key[0], gone, "expired")


def latest_jobs(stream: DataFrame, lookback: datetime.timedelta, delay: str = "0 seconds") -> DataFrame:
    """Changes of ads as a stream in update mode: ``STATES`` rows, one whenever an ad's newest entry changes (active or
    inactive) and one when it falls behind the look-back, counted from the newest entry of the feed (expired).

    State is a row an ad and goes with it.  It needs the RocksDB state store."""
    rows = stream.withWatermark("modified", delay)
    return rows.groupBy("uuid").transformWithStateInPandas(statefulProcessor=_Latest(lookback), outputStructType=STATES, outputMode="Update", timeMode="EventTime")


def active_jobs(log: DataFrame, lookback: datetime.timedelta) -> DataFrame:
    """The same in batch: active ads of a whole log whose newest entry is not older than the look-back."""
    newest = log.groupBy("uuid").agg(F.max_by(F.struct("modified", "sequence", "status", "business_name"), "sequence").alias("e")).select("uuid", "e.*")
    end = log.agg(F.max("modified").alias("_end"))
    fresh = newest.join(F.broadcast(end)).where(F.col("modified") > F.col("_end") - F.lit(lookback))  # one row
    return fresh.where("status = 'ACTIVE'").drop("_end")
