"""Query op5: verdicts on all page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.url_filter import judge_urls

NAME = "op5_url_filter"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
