"""Query op7: all pages through WARC packages and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.archives import archive_round_trip

NAME = "op7_warc_packages"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM g"""
