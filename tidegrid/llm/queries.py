"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, lm_score, media, mixing, piece_codec, quality, secret_scan, simhash, suffix_dedup
from .common import documents


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         CAST([5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source) AS n FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT arg_min(level, n) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(f.level, 1e300) * w) AS target FROM o LEFT JOIN f ON true),
e AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d),
r AS (
  SELECT c.*, e.source_size, e.target, e.epochs,
         min(CASE WHEN upto > e.target - e.epochs * e.source_size THEN h END) OVER (PARTITION BY c.source) AS until_h
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND h < until_h THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(epochs + CASE WHEN target - epochs * source_size > 0 AND h < until_h THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their number, and whether they decode to the text."""
    out = piece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256", "round_trip")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def queries() -> dict:
    return {"op1_mix": op1_mix, "op2_piece_codec": op2_piece_codec, "op3_licenses": op3_licenses, "op4_lm_score": op4_lm_score, "op5_media": op5_media, "op6_exact_dedup": op6_exact_dedup, "op7_secrets": op7_secrets, "op8_suffix_dedup": op8_suffix_dedup, "op9_quality": op9_quality, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op6_exact_dedup": OP6_SQL}
