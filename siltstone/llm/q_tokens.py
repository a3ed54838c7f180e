"""Query op2: token counts of all documents, before and after redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.token_counts import edited_token_counts

NAME = "op2_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
