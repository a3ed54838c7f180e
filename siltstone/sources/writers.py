"""Shards of passages and vectors, exports and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_units(passages: DataFrame, path: str, unit: str = "unit") -> None:
    """Passages by unit; a unit that is written again takes its own place and leaves the others."""
    passages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


def write_embeddings(vectors: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Vectors in files sorted by their key, so that a lookup reads few row groups."""
    vectors.sortWithinPartitions(key).write.mode("append").parquet(path)


def export_articles(articles: DataFrame, path: str) -> None:
    articles.select("doc_id", "title", "url", "text", "source_shard").write.mode("overwrite").parquet(path)


def write_report(table: DataFrame, path: str, kind: str = "json") -> None:
    """A small table as one file of JSON lines or CSV."""
    out = table.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)
