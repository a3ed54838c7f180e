"""BM25 as tables. A document is tokenised once and its terms are counted in its row, so that only the counts of
documents by term are shuffled; a search keeps asked terms only, before anything moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siltstone.functions.text import index_tokens
from siltstone.session import map_texts, pieces, written

BROADCAST_TERMS = 500_000


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(key, term, tf, dl): each document's terms, and of each run of documents one row without key and term that has
    the number of documents in tf and of tokens in dl. One row of ``docs`` is one document; nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    wanted = None if terms is None else pa.array(sorted(set(terms)), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            lists = b["tokens"]
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy(zero_copy_only=False)
            if wanted is not None:
                asked = pc.is_in(coded.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)
                row, code = (x[asked[code]] for x in (row, code)) if len(code) else (row, code)
            pair, n = np.unique(row * max(1, len(coded.dictionary)) + code, return_counts=True)
            row, code = np.divmod(pair, max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(row)), coded.dictionary.take(pa.array(code)), pa.array(n.astype(np.int64)), pa.array(size[row])], names=[key, "term", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b[key].type), pa.nulls(1, pa.string()), pa.array([len(size)], pa.int64()), pa.array([int(size.sum())], pa.int64())], names=[key, "term", "tf", "dl"])

    return map_texts(docs.select(key, index_tokens(F.col(text)).alias("tokens")), run, f"{key} {kind}, term string, tf long, dl long")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return counted(docs, key, text).where("term is not null").select(key, "term", "tf")


def document_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl) of the documents that have a term."""
    return docs.select(key, F.size(index_tokens(F.col(text))).cast("long").alias("dl")).where("dl > 0")


def statistics(tf: DataFrame) -> tuple[int, int]:
    """Documents and tokens, from the rows of ``counted`` that have no term."""
    n, total = tf.where("term is null").agg(F.sum("tf"), F.sum("dl")).first()
    return n or 0, total or 0


def document_frequencies(tf: DataFrame, n: int) -> DataFrame:
    df = F.col("df")
    return tf.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((n - df + 0.5) / (df + 0.5) + 1))


def weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(F.lit(1.0), avgdl)))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, terms: list[str] | None = None) -> DataFrame:
    """(term, key, tf, dl, df, weight); with ``terms`` only of these, with the statistics of all."""
    tf = written(counted(docs, key, text, terms), "counts")
    n, total = statistics(tf)
    df = written(document_frequencies(tf, n), "frequencies")
    df = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    w = weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(total / max(1, n)), k1, b)
    return tf.where("term is not null").join(df, "term").select("term", key, "tf", "dl", "df", w.alias("weight")).where("weight > 0")


def save_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, buckets: int = 64) -> None:
    """Write the postings, by buckets of terms, so that a search reads those of its terms."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    postings(docs, key, text, k1, b).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def asked_terms(queries: DataFrame, query: str = "query_id", query_text: str = "query") -> DataFrame:
    return queries.select(query, F.explode(F.array_distinct(index_tokens(F.col(query_text)))).alias("term"))


def _best(found: DataFrame, query: str, key: str, k: int) -> DataFrame:
    scored = found.groupBy(query, key).agg(F.round(F.sum("weight"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key)).cast("long")).where(F.col("rank") <= k)


def search_index(index: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "query_id", query_text: str = "query", buckets: int = 64) -> DataFrame:
    """The same as ``search`` over a written index; only the asked terms' buckets are read."""
    asked = asked_terms(queries, query, query_text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    held = [r[0] for r in asked.select("bucket").distinct().collect()]
    return _best(index.where(F.col("bucket").isin(held)).join(F.broadcast(asked), ["bucket", "term"]), query, key, k)


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, key, score, rank): each query's ``k`` best documents over its distinct terms; ties by key.

    A blank query, or one of stop words, finds nothing. The queries' terms come to the driver, up to BROADCAST_TERMS
    of them; beyond that all terms are counted and joined.
    """
    asked = asked_terms(queries, query, query_text)
    terms = [r[0] for r in asked.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
    few = len(terms) <= BROADCAST_TERMS
    found = postings(docs, key, text, terms=terms if few else None).select("term", key, "weight")
    return _best(found.join(F.broadcast(asked) if few else asked, "term"), query, key, k)
