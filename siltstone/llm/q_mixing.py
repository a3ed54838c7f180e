"""Query op6: how much of each document a mix of all sources takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.mixing import mix_sources

NAME = "op6_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
