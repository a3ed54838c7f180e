"""Search and answers over a written corpus, as DataFrames: what a service would call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siltstone.operators import bm25, grounding as G, lookup as L, retrieval as R, vectors as V
from siltstone.session import written

MODES = ("dense", "sparse", "hybrid_rrf", "hybrid_rerank")


@dataclass(frozen=True)
class Engine:
    """``documents`` (doc_id, title, url, text) and ``vectors`` (vec_id, embedding), vec_id being a doc_id."""

    documents: DataFrame
    vectors: DataFrame
    candidates: int = 50
    rrf_k: int = 60

    def runs(self, queries: DataFrame, vectors: DataFrame, k: int = 10) -> dict[str, DataFrame]:
        """(query_id, doc_id, rank) of each mode, from queries (query_id, query) and their vectors (query_id, vector).
        Blank queries find nothing by words. Both rankings and their fusion are written, as several modes read them."""
        asked = L.answerable(queries)
        dense = written(V.flat_topk(self.vectors, vectors, self.candidates).withColumnRenamed("vec_id", "doc_id"), "dense")
        sparse = written(bm25.search(self.documents, asked, self.candidates), "sparse")
        fused = written(R.reciprocal_rank_fusion(dense, sparse, self.rrf_k), "fused")
        reranked = R.lexical_rerank(fused.where(F.col("fused_rank") <= self.candidates), asked, self.documents, k)
        ranked = lambda df, rank: df.select("query_id", "doc_id", F.col(rank).alias("rank")).where(F.col("rank") <= k)
        return dict(zip(MODES, (ranked(dense, "rank"), ranked(sparse, "rank"), ranked(fused, "fused_rank"), ranked(reranked, "final_rank")), strict=True))

    def search(self, queries: DataFrame, vectors: DataFrame, mode: str = "hybrid_rerank", k: int = 10) -> DataFrame:
        """(query_id, doc_id, rank, title, url) of one mode."""
        return R.hydrate(self.runs(queries, vectors, k)[mode], self.documents)

    def answer(self, queries: DataFrame, vectors: DataFrame, mode: str = "hybrid_rerank", k: int = 5) -> DataFrame:
        """(query_id, answer, prompt, citations): the extractive answer of the best passage, and the prompt that a
        language model would get. A query without candidates has none."""
        found = self.search(queries, vectors, mode, k).join(self.documents.select("doc_id", "text"), "doc_id")
        best = found.where("rank = 1").select("query_id", G.extractive_answer(F.col("text")).alias("answer"))
        return G.prompts(found).join(best, "query_id", "left").select("query_id", "answer", "prompt", "citations")
