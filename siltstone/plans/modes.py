"""Retrieval metrics by mode."""

from __future__ import annotations

from siltstone.engine import Engine
from siltstone.operators import runs as R
from siltstone.plans._tables import articles, benchmark_queries, table
from siltstone.plans.passages import EVIDENCE, METRICS, evidence
from siltstone.plans.search import FUSED, RERANKED


def metrics_by_mode(s, d):
    queries, e = benchmark_queries(s, d), table(s, d, "embeddings")
    asked = queries.join(e, queries["query_id"] == e["vec_id"]).select("query_id", e["embedding"].alias("vector"))
    return R.mode_metrics(Engine(articles(s, d), e).runs(queries, asked), evidence(s, d))


QUERIES = {"metrics_by_mode": metrics_by_mode}
_NAMES = ["mrr", *(f"{m}_{k}" for k in (1, 5, 10) for m in ("hit_rate", "recall", "ndcg"))]
_RUNS = " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, doc_id, {rank} AS rank FROM {source} WHERE {rank} <= 10" for m, source, rank in (("dense", "dense", "rank"), ("sparse", "sparse", "rank"), ("hybrid_rrf", "fused", "fused_rank"), ("hybrid_rerank", "reranked", "final_rank")))
SQL = {
    "metrics_by_mode": f"{FUSED}, {RERANKED}, runs AS ({_RUNS}), truth AS ({EVIDENCE}), modes AS (SELECT unnest(['dense', 'sparse', 'hybrid_rrf', 'hybrid_rerank']) AS mode), "
    "f AS (SELECT m.mode, t.query_id, r.rank, row_number() OVER (PARTITION BY m.mode, t.query_id ORDER BY t.doc_id) AS place FROM truth t CROSS JOIN modes m LEFT JOIN runs r ON r.mode = m.mode AND r.query_id = t.query_id AND r.doc_id = t.doc_id), "
    f"per AS (SELECT mode, query_id, coalesce(round(1.0 / min(rank), 6), 0.0)::DOUBLE AS mrr, {METRICS} FROM f GROUP BY ALL) SELECT mode, count(*) AS queries, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _NAMES) + " FROM per GROUP BY mode"
}
