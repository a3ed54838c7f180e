"""Rank fusion, hydration and reranking for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siltstone.functions.text import index_tokens


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 60, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Full outer join of two rankings (query, key, score, rank); one key counts once in a ranking."""
    side = lambda df, name: df.groupBy(query, key).agg(F.max("score").alias(f"{name}_score"), F.min("rank").alias(f"{name}_rank"))
    both = side(dense, "dense").join(side(sparse, "sparse"), [query, key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    fused = both.withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 8))
    order = W.partitionBy(query).orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key)
    return fused.withColumn("fused_rank", F.row_number().over(order).cast("long"))


def hydrate(candidates: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with title and url; a document that is missing gives defaults, not nulls."""
    found = candidates.join(documents.select(key, "title", "url"), key, "left")
    return found.withColumns({"title": F.coalesce("title", F.concat(F.lit("Article "), F.col(key).cast("string"))), "url": F.coalesce("url", F.lit(""))})


def lexical_rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, k: int, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """A deterministic reranker: the share of a query's distinct terms that the text holds; ties keep the fused order."""
    asked = queries.select(query, F.array_distinct(index_tokens(F.col("query"))).alias("terms"))
    scored = candidates.join(asked, query).join(texts.select(key, "text"), key).withColumn("held", F.array_distinct(index_tokens(F.col("text"))))
    share = F.size(F.array_intersect("terms", "held")) / F.greatest(F.lit(1), F.size("terms"))
    order = W.partitionBy(query).orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rerank_score", F.round(share, 6)).withColumn("final_rank", F.row_number().over(order).cast("long")).where(F.col("final_rank") <= k).drop("terms", "held", "text")
