"""Small helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in characters.
SLICE_CHARS = 4_000_000
#: Stored tables that are still there, in the order in which they were made.
_STORED: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; only local sessions may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@functools.lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skerry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    _STORED.append(path)
    return made


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside reads and sends texts to Python ``rows`` at a time, or fewer if the session says so, as
    all tasks of a small heap hold such batches at once; the session's settings hold again afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            if not 0 < int(spark.conf.get(name)) <= rows:
                spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored on the way go, as nothing reads them any more."""
    before = len(_STORED)
    made = stored(make(), name)
    _delete(made.sparkSession, _STORED[before:-1])
    del _STORED[before:]
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes the files behind stored tables that nothing reads any more, as what was made of them is stored itself."""
    gone = {t._stored_at for t in tables if hasattr(t, "_stored_at")}
    if gone:
        _delete(tables[0].sparkSession, sorted(gone))
    _STORED[:] = [path for path in _STORED if path not in gone]


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, never broadcast in a join, nor what it is joined with: Spark sizes both by the files that they come
    from, far too low after an explode or for well compressed columns, and would build such a table in the driver."""
    return df.hint("merge")


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with one fact for each key, where one key may hold a third of all rows.

    Keys of over a thousandth of the rows, of which there are fewer than a thousand, get their facts by
    broadcast; the others by a shuffle in which no key is large."""
    least = rows.count() / 1000
    hot = stored(rows.groupBy(key).count().where(F.col("count") > least).select(key), "hot-keys")
    rare = rows.join(F.broadcast(hot), key, "left_anti").join(by_shuffle(facts), key)
    return rare.unionByName(rows.join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key))


def crc_of_id(column: str) -> Column:
    """crc32 of the id as decimal text, which deals rows to folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; splitting bytes knows no other white space."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def slices(frames: Iterator[pd.DataFrame], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """Row ranges of bounded text size, so that a batch of very long texts is not expanded at once."""
    for frame in frames:
        if not len(frame):
            continue
        size = frame[text].str.len().fillna(0).to_numpy(dtype="int64").cumsum()
        part = size // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            yield frame.iloc[a:b]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` as text, as pandas would make floats of integers beside a null, and ``text`` without nulls."""
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def with_id(out: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """``out`` with its ``id`` under its own name and type again."""
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), *[F.col(f"`{c}`") for c in out.columns if c != "id"])


class ChunkCache(dict):
    """Dictionary that is emptied before it would take in more than ``limit`` bytes of keys, roughly."""

    def __init__(self, limit: int = 24_000_000):
        super().__init__()
        self.limit, self.held = limit, 0

    def room(self, incoming: list[str]) -> None:
        size = sum(map(len, incoming)) + 40 * len(incoming)
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        self.held += size
