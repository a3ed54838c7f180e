"""Query op1: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.html_extract import extract_main_text

NAME = "op1_html_main_text"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
