"""Query op8: suffix-tree scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.suffix_tree import suffix_tree_scores

NAME = "op8_suffix_tree_scores"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
