"""Query op9: languages of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.language_id import fit_language_model, held_out_column, predict_languages

NAME = "op9_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out_column("doc_id", 3, 1).alias("held_out"))
    return predict_languages(docs, fit_language_model(docs.where("not held_out"), floor=False), carry=("doc_id", "held_out"))
