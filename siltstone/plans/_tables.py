"""The driver's tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a made-up title and url; they come without either."""
    title = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.concat(F.lit("https://example.org/"), title).alias("url"), "text", "source")


ARTICLES = "(SELECT doc_id, source || '/' || doc_id AS title, 'https://example.org/' || source || '/' || doc_id AS url, text, source FROM documents)"


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({STOPS}))"


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: doc_id is paired with the vector of the same number, and a query with that of its item: the tables have no real tie.
VECTOR_QUERIES = "SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
