"""Chunks, storage, evaluation, grounding, streaming."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from siltstone.functions import text as T
from siltstone.operators import bm25, chunking as C, evaluation as E, grounding as G, runs as RU, storage as S
from siltstone.operators.evidence import containing
from siltstone.plans._tables import ARTICLES, articles, benchmark_queries, table
from siltstone.plans.search import SQL as SEARCH
from siltstone.session import work_path
from siltstone.streaming.ingest import ingest, rolling_latency


def chunk_documents(s, d):
    """All passages; an article that fails is counted by its error and gives no passage."""
    return C.chunk_documents(articles(s, d)).where("error is null").drop("error")


def rechunk(s, d):
    return C.rechunk(chunk_documents(s, d), C.ChunkRules(target=128, overlap=20, least=20)).where("error is null").drop("error")


def chunk_id_codec(s, d):
    made = table(s, d, "documents").select("doc_id", (F.col("n_chars") % 65536).alias("seq")).withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.col("seq")))
    doc, seq = T.chunk_parts(F.col("chunk_id"))
    return made.select("doc_id", "seq", "chunk_id", doc.alias("doc_back"), seq.alias("seq_back"))


def _versions(s, d):
    old = table(s, d, "documents").select("doc_id", "source", F.lit(0).alias("v"))
    return old, table(s, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"), F.lit(1).alias("v"))


def upsert_last_wins(s, d):
    return S.upsert_last_wins(*_versions(s, d), "doc_id", F.col("v"))


def insert_ignore_first_wins(s, d):
    doc, lab = _versions(s, d)
    return S.insert_ignore(lab, doc, "doc_id", F.col("source"))


def dedupe_docs(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.min("turn").alias("turn"))


def resume_anti_join(s, d):
    return S.pending(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


def table_counts(s, d):
    counts = [table(s, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "pages", "labels", "benchmark")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def evidence(s, d):
    """Documents that hold an item's text, whatever its length."""
    found = containing(table(s, d, "documents").select("doc_id", "text"), benchmark_queries(s, d), "doc_id", "text", "query_id", "query")
    return found.withColumn("rel", F.lit(1.0))


def evidence_map(s, d):
    return evidence(s, d)


def retrieval_metrics(s, d):
    return E.retrieval_metrics(bm25.search(table(s, d, "documents"), benchmark_queries(s, d), 10), evidence(s, d))


def _turns(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("reply_role")).where("role = 'user' and reply_role = 'assistant'")


def exact_match(s, d):
    return _turns(s, d).select("conv_id", "turn", E.exact_match(F.col("reply"), F.array("text")).alias("em"), F.length(T.normal_answer(F.col("text"))).cast("long").alias("n"))


def token_f1(s, d):
    return _turns(s, d).select("conv_id", "turn", E.token_f1(F.col("reply"), F.col("text")).alias("f1"))


def latency_stats(s, d):
    return E.latency_stats(table(s, d, "events"), "event_type", "value")


def stage_hours(s, d):
    return rolling_latency(table(s, d, "events"))


def pareto_frontier(s, d):
    """Hours by mean value and number of events: those that more events than every cheaper hour had."""
    hours = rolling_latency(table(s, d, "events")).groupBy("start").agg(F.sum("n").alias("n"), F.round(F.avg("mean"), 6).alias("cost"))
    before = F.max("n").over(W.orderBy("cost", "start").rowsBetween(W.unboundedPreceding, -1))
    return hours.withColumn("before", before).where("before is null or n > before").select("start", "n", "cost")


def prompt_sanitize(s, d):
    return table(s, d, "pages").select("page_id", F.length(T.safe_prompt_text(F.concat(F.lit("</document>"), F.col("html"), F.lit("<CONTEXT x>")))).cast("long").alias("n"))


def extractive_answer(s, d):
    return table(s, d, "documents").select("doc_id", G.extractive_answer(F.col("text")).alias("answer"))


def citation_list(s, d):
    ranked = bm25.search(table(s, d, "documents"), benchmark_queries(s, d), 3).join(articles(s, d), "doc_id")
    return G.prompts(ranked).select("query_id", F.size("citations").cast("long").alias("n"), F.transform("citations", lambda c: c["doc_id"]).alias("doc_ids"), F.length("prompt").cast("long").alias("prompt_chars"))


def stream_ingest_available_now(s, d):
    root = work_path(s, "stream")
    articles(s, d).select("doc_id", "title", "url", "text").write.parquet(f"{root}/in")
    ingest(s, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/out").drop("batch")


QUERIES = {f.__name__: f for f in (chunk_documents, rechunk, chunk_id_codec, upsert_last_wins, insert_ignore_first_wins, dedupe_docs, resume_anti_join, table_counts, evidence_map, retrieval_metrics, exact_match, token_f1, latency_stats, stage_hours, pareto_frontier, prompt_sanitize, extractive_answer, citation_list, stream_ingest_available_now)}

EVIDENCE = "SELECT item_id AS query_id, doc_id, 1.0::DOUBLE AS rel FROM benchmark b, documents d WHERE contains(d.text, b.text)"
_TURNS = "(SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
# RE2 has no look-behind: a mark is put where a sentence ends, and the text is split at it.
_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 10)"
_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL"
METRICS = ", ".join(f"max(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate_{k}, round(sum(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 6) AS recall_{k}, round(least(1.0, coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1.0) END), 0) / sum(CASE WHEN place <= {k} THEN 1 / log2(place + 1.0) END)), 6) AS ndcg_{k}" for k in (1, 5, 10))
SQL = {
    "chunk_id_codec": "SELECT doc_id, n_chars % 65536 AS seq, (doc_id << 16) | (n_chars % 65536) AS chunk_id, doc_id AS doc_back, n_chars % 65536 AS seq_back FROM documents",
    "upsert_last_wins": "SELECT doc_id, coalesce('q' || quality, source) AS source, (quality IS NOT NULL)::INT AS v FROM documents FULL JOIN labels USING (doc_id)",
    "insert_ignore_first_wins": "SELECT doc_id, coalesce('q' || quality, source) AS source, (quality IS NOT NULL)::INT AS v FROM documents FULL JOIN labels USING (doc_id)",
    "dedupe_docs": "SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations GROUP BY conv_id",
    "resume_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "labels", "benchmark")),
    "evidence_map": EVIDENCE,
    "retrieval_metrics": f"WITH truth AS ({EVIDENCE}), runs AS ({SEARCH['bm25_search_batch']}), f AS (SELECT t.query_id, rank, row_number() OVER (PARTITION BY t.query_id ORDER BY t.doc_id) AS place FROM truth t LEFT JOIN runs r ON r.query_id = t.query_id AND r.doc_id = t.doc_id) SELECT query_id, coalesce(round(1.0 / min(rank), 6), 0.0)::DOUBLE AS mrr, {METRICS} FROM f GROUP BY query_id",
    "exact_match": f"SELECT conv_id, turn, {_NORM.format('reply')} = {_NORM.format('text')} AS em, length({_NORM.format('text')})::BIGINT AS n FROM {_TURNS} WHERE role = 'user' AND reply_role = 'assistant'",
    "latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in (50, 90, 95, 99)) + ", min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "stage_hours": _HOURS,
    "pareto_frontier": f"WITH h AS (SELECT start, sum(n)::BIGINT AS n, round(avg(mean), 6) AS cost FROM ({_HOURS}) GROUP BY start) SELECT start, n, cost FROM (SELECT *, max(n) OVER (ORDER BY cost, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h) WHERE before IS NULL OR n > before",
    "token_f1": f"WITH t AS (SELECT conv_id, turn, list_filter(string_split({_NORM.format('reply')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') AS g FROM {_TURNS} WHERE role = 'user' AND reply_role = 'assistant'), c AS (SELECT *, (SELECT coalesce(sum(least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w)))), 0) FROM (SELECT unnest(list_distinct(p)) AS w)) AS c FROM t) SELECT conv_id, turn, (CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(2.0::DOUBLE * c / (len(p) + len(g)), 4) END)::DOUBLE AS f1 FROM c",
    "extractive_answer": f"SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:2], ' ') ELSE substring(text, 1, 200) END || ' [1]' AS answer FROM (SELECT doc_id, text, {_SENTENCES} AS l FROM documents)",
    "citation_list": f"WITH r AS ({SEARCH['bm25_search_batch']}), t AS (SELECT query_id, doc_id, rank, text FROM r JOIN documents USING (doc_id) WHERE rank <= 3) SELECT query_id, count(*) AS n, list(doc_id ORDER BY rank) AS doc_ids, (length('<context>') + length('</context>') + 1 + sum(length('<document index=\"' || rank || '\">') + 1 + length(regexp_replace(text, '</?(?:context|document)[^>]*>', '', 'gi')) + length('</document>') + 2))::BIGINT AS prompt_chars FROM t GROUP BY query_id",
    "prompt_sanitize": r"SELECT page_id, length(regexp_replace('</document>' || html || '<CONTEXT x>', '</?(?:context|document)[^>]*>', '', 'gi'))::BIGINT AS n FROM pages",
}
