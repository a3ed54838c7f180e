"""BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import bm25, retrieval as R, vectors as V
from siltstone.plans._tables import ARTICLES, VECTOR_QUERIES, articles, benchmark_queries, sql_tokens, table, vector_queries
from siltstone.session import work_path, written


def docs(s, d):
    return table(s, d, "documents")


def bm25_tf(s, d):
    return bm25.term_counts(docs(s, d))


def bm25_doc_length(s, d):
    return bm25.document_lengths(docs(s, d))


def bm25_df_idf(s, d):
    tf = written(bm25.counted(docs(s, d)), "counts")
    return bm25.document_frequencies(tf, bm25.statistics(tf)[0]).withColumn("idf", F.round("idf", 6))


def bm25_weights(s, d):
    return bm25.postings(docs(s, d)).select("term", "doc_id", "tf", "dl", "df", F.round("weight", 6).alias("weight"))


def bm25_search_batch(s, d):
    return bm25.search(docs(s, d), benchmark_queries(s, d), 10)


def l2_normalize(s, d):
    v = V.unit(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.element_at(v, 1), 6).alias("first"))


def flat_ip_topk(s, d):
    return V.flat_topk(table(s, d, "embeddings"), vector_queries(s, d), 10)


def flat_l2_topk(s, d):
    return V.flat_topk(table(s, d, "embeddings"), vector_queries(s, d), 10, "l2")


def centroids(s, d):
    """One centroid a label: its vector of the smallest id, so that SQL can say it."""
    e = table(s, d, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("long").alias("cell"), "vector")


def ivf_assign(s, d):
    return V.assign_cells(table(s, d, "embeddings").select("vec_id", "embedding"), centroids(s, d)).select("vec_id", "cell")


def ivf_search_nprobe(s, d, nprobe=3):
    c = centroids(s, d)
    return V.cells_topk(V.assign_cells(table(s, d, "embeddings").select("vec_id", "embedding"), c), vector_queries(s, d), c, 10, nprobe)


def ivf_recall_vs_flat(s, d):
    flat, ivf = flat_ip_topk(s, d).select("query_id", "vec_id"), ivf_search_nprobe(s, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return flat.join(ivf, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def ivf_kmeans_search(s, d, nlist=16, nprobe=12):
    """Trained cells, written and read again, so that a search reads what was added."""
    path, e = work_path(s, "index"), table(s, d, "embeddings")
    V.save_cells(path, V.train_cells(e, nlist))
    V.add_vectors(s, path, e.where("vec_id % 2 = 0"))
    V.add_vectors(s, path, e)
    vectors, cells = V.load_cells(s, path)
    return V.cells_topk(vectors, vector_queries(s, d), cells, 10, nprobe)


def pq_encode_search(s, d, parts=32, codes=256):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    books = V.train_codebooks(e, parts, codes)
    return V.codes_topk(V.encode(e, books), books, vector_queries(s, d), 10)


def ivf_pq_search(s, d, nlist=16, nprobe=12, parts=32, codes=256):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    cells, books = V.train_cells(e, nlist), V.train_codebooks(e, parts, codes)
    coded = V.encode(e, books).join(V.assign_cells(e, cells).select("vec_id", "cell"), "vec_id")
    return V.cells_topk(coded, vector_queries(s, d), cells, 10, nprobe, vector="codes", books=books)


def _rankings(s, d):
    q = benchmark_queries(s, d)
    asked = q.join(table(s, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    dense = V.flat_topk(table(s, d, "embeddings"), asked, 50).withColumnRenamed("vec_id", "doc_id")
    return q, dense, bm25.search(docs(s, d), q, 50)


def rrf_fuse(s, d):
    _, dense, sparse = _rankings(s, d)
    return R.reciprocal_rank_fusion(dense, sparse).select("query_id", "doc_id", "dense_rank", "sparse_rank", "rrf_score", "fused_rank")


def hybrid_search(s, d):
    _, dense, sparse = _rankings(s, d)
    fused = R.reciprocal_rank_fusion(dense, sparse).where("fused_rank <= 5")
    return R.hydrate(fused, articles(s, d)).select("query_id", "doc_id", "rrf_score", "fused_rank", "title", "url")


def rerank_topk(s, d):
    q, dense, sparse = _rankings(s, d)
    fused = R.reciprocal_rank_fusion(dense, sparse).where("fused_rank <= 50")
    return R.lexical_rerank(fused, q, docs(s, d), 5).select("query_id", "doc_id", "rerank_score", "final_rank")


QUERIES = {f.__name__: f for f in (bm25_tf, bm25_doc_length, bm25_df_idf, bm25_weights, bm25_search_batch, l2_normalize, flat_ip_topk, flat_l2_topk, ivf_assign, ivf_search_nprobe, ivf_recall_vs_flat, ivf_kmeans_search, pq_encode_search, ivf_pq_search, rrf_fuse, hybrid_search, rerank_topk)}

_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL)"
_W = f"""{_TF}, dl AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY doc_id), n AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / greatest(1, count(*)) AS avgdl FROM documents),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, doc_id, tf, dl, df, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, avgdl))) AS weight FROM tf JOIN dl USING (doc_id) JOIN dfs USING (term), n)"""
_SPARSE = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark), scored AS (SELECT query_id, doc_id, round(sum(weight), 6) AS score FROM w JOIN q USING (term) GROUP BY ALL)"


def _top(source: str, key: str, k: int, way: str = "DESC") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, {key}) AS rank FROM ({source})) WHERE rank <= {k}"


_DOT, _L2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i]::DOUBLE * embedding[i]::DOUBLE))", "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE - embedding[i]::DOUBLE) * (v[i]::DOUBLE - embedding[i]::DOUBLE)))"
_FLAT = _top(f"SELECT query_id, vec_id, round({_DOT}, 6) AS score FROM ({VECTOR_QUERIES}) q, embeddings", "vec_id", 10)
_CELLS = f"c AS (SELECT label::BIGINT AS cell, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), cells AS (SELECT vec_id, embedding, cell FROM (SELECT vec_id, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round({_DOT}, 6) DESC, cell) AS r FROM c, embeddings) WHERE r = 1)"
_NEAR = _top(f"SELECT query_id, cell, round({_DOT}, 6) AS score FROM ({VECTOR_QUERIES}) q, (SELECT cell, v AS embedding FROM c)", "cell", 3)
_IVF = _top(f"SELECT query_id, vec_id, round({_DOT}, 6) AS score FROM ({VECTOR_QUERIES}) q JOIN near USING (query_id) JOIN cells USING (cell)", "vec_id", 10)
FUSED = f"""WITH {_W}, {_SPARSE}, sparse AS ({_top('FROM scored', 'doc_id', 50)}),
dense AS ({_top(f"SELECT item_id AS query_id, e.vec_id AS doc_id, round({_DOT}, 6) AS score FROM benchmark b JOIN (SELECT vec_id, embedding AS v FROM embeddings) x ON x.vec_id = item_id, embeddings e", 'doc_id', 50)}),
merged AS (SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 8) AS rrf_score FROM dense d FULL JOIN sparse s USING (query_id, doc_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS fused_rank FROM merged)"""
RERANKED = f"a AS (SELECT item_id AS query_id, list_distinct({sql_tokens('text')}) AS terms FROM benchmark), h AS (SELECT doc_id, list_distinct({sql_tokens('text')}) AS held FROM documents), r AS (SELECT query_id, doc_id, fused_rank, round(len(list_intersect(terms, held)) / greatest(1, len(terms)), 6) AS rerank_score FROM fused JOIN a USING (query_id) JOIN h USING (doc_id) WHERE fused_rank <= 50), reranked AS (SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS final_rank FROM r)"
SQL = {
    "bm25_tf": f"WITH {_TF} FROM tf",
    "bm25_doc_length": f"WITH {_TF} SELECT doc_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY doc_id",
    "bm25_df_idf": f"WITH {_TF} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM documents)",
    "bm25_weights": f"WITH {_W} SELECT term, doc_id, tf, dl, df, round(weight, 6) AS weight FROM w WHERE weight > 0",
    "bm25_search_batch": f"WITH {_W}, {_SPARSE} {_top('FROM scored', 'doc_id', 10)}",
    "l2_normalize": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) ** 2)), 6) AS norm2, round(embedding[1]::DOUBLE / n, 6) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
    "flat_ip_topk": _FLAT,
    "flat_l2_topk": _top(f"SELECT query_id, vec_id, round({_L2}, 6) AS score FROM ({VECTOR_QUERIES}) q, embeddings", "vec_id", 10, "ASC"),
    "ivf_assign": f"WITH {_CELLS} SELECT vec_id, cell FROM cells",
    "ivf_search_nprobe": f"WITH {_CELLS}, near AS (SELECT query_id, cell FROM ({_NEAR})) {_IVF}",
    "ivf_recall_vs_flat": f"WITH {_CELLS}, near AS (SELECT query_id, cell FROM ({_NEAR})), f AS ({_FLAT}), i AS ({_IVF}) SELECT f.query_id, round(count(i.vec_id) / count(*), 4) AS recall FROM f LEFT JOIN i ON f.query_id = i.query_id AND f.vec_id = i.vec_id GROUP BY f.query_id",
    "rrf_fuse": f"{FUSED} SELECT query_id, doc_id, dense_rank, sparse_rank, rrf_score, fused_rank FROM fused",
    "hybrid_search": f"{FUSED} SELECT query_id, doc_id, rrf_score, fused_rank, coalesce(title, 'Article ' || doc_id) AS title, coalesce(url, '') AS url FROM fused LEFT JOIN {ARTICLES} USING (doc_id) WHERE fused_rank <= 5",
    "rerank_topk": f"{FUSED}, {RERANKED} SELECT query_id, doc_id, rerank_score, final_rank FROM reranked WHERE final_rank <= 5",
}
