"""The thin queries over the training-data operators, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import byte_bpe, hard_negatives, lattice, license_scan, line_crf, multiprobe, packing, pii, prefix_trie, pu_quality, sharding, simhash, toxicity
from skerry.llm.common import crc_of_id, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.content_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows (crc32 of the id mod 3 is 1) lend neither labels nor text to the fit."""
    learnt = crc_of_id("doc_id") % 3 != 1
    trusted = read(spark, sf_dir, "labels").where(learnt & (F.col("quality") == 1))
    scored = pu_quality.pu_quality(read(spark, sf_dir, "documents"), trusted, learnt)
    return scored.select("doc_id", (~learnt).alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), group=5, heads=9)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


OPERATORS = (op1_toxicity, op2_line_crf, op3_multiprobe, op4_packing, op5_lattice, op6_simhash, op7_sharding, op8_license_scan, op9_pu_quality, op10_byte_bpe, op11_pii, op12_prefix_trie, op13_hard_negatives)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {}

#: The unsigned crc32 of the decimal id, bit by bit.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT),
    lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(crc, b)),
    4294967295::UBIGINT))"""
ORACLE_SQL["op12_prefix_trie"] = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(strlen(role)::VARCHAR || ':' || role || text) AS code, strlen(text) AS size FROM rebuilt),
paths AS (
    SELECT conv_id, depth, size, sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
        sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS up FROM placed
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM heads),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
    SELECT p.node, p.depth, any_value(CASE WHEN p.depth = 1 THEN 'root' ELSE p.up END) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
    FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.node, p.depth),
families AS (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
above AS (  -- each node with every node above it, itself included
    SELECT DISTINCT a.node, a.depth, b.node AS low, b.depth AS low_depth FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
    SELECT a.node, a.depth, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.up IS NULL) AS n_leaves
    FROM above a JOIN nodes n ON n.node = a.low AND n.depth = a.low_depth LEFT JOIN families f ON f.up = n.node GROUP BY a.node, a.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN families f ON f.up = n.node LEFT JOIN nodes p ON p.node = n.up AND p.depth = n.depth - 1
"""
ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
