"""A training corpus from documents: harmful and poor texts go, near copies go, the rest is packed.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns the documents that stay, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import near_copies, packing, pu_quality, toxicity
from skerry.llm.common import discard, finished, read

#: No SQL states a trained classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not hold for toxic, with all their columns.

    Every row is judged by its own text: null and empty texts like a text without known words, repeated
    rows alike.  A probability of just 0.5 stays, so without labels all stay; an empty table stays empty."""
    p = toxicity.toxicity_column(docs, read(spark, sf_dir, "labels"))
    return docs.where(p["p_toxic"] <= toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is likelier good than not; the web text to learn from is all documents.

    Every row is judged by its own text, a null one as empty, repeated rows alike; a score of just 0.5 stays,
    so without trusted documents all stay; an empty table stays empty."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return docs.where(pu_quality.quality_column(docs, trusted, F.lit(True)) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word shingles have a Jaccard similarity of 0.8
    or more, and what such links join.

    The smallest id stays, of its rows in the group that of the smallest text; rows of one id in different
    groups do not touch each other, and a row without an id stays where its group has no other.  Null,
    empty and blank texts are alike; an empty table stays empty."""
    return near_copies.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full windows; null texts count as empty, repeated ids are separate documents."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near copies", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes with it, only the last
    one's input stays."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
