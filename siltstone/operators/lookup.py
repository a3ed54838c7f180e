"""Reads of stored passages: by document, hydration from several stores, request checks and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def passages_of(passages: DataFrame, documents: DataFrame, wanted: DataFrame, doc: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """The passages of the wanted documents with their document's columns, each numbered in its document's order."""
    few = passages.join(wanted.select(doc).distinct(), doc, "left_semi").join(documents, doc, "left")
    return few.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(order)).cast("long"))


def hydrate_from(candidates: DataFrame, stores: list[DataFrame], defaults: dict[str, Column], key: str) -> DataFrame:
    """Candidates with columns from the first store that has the key, each column by itself, else the default. A store
    has one row of a key."""
    out = candidates
    for i, store in enumerate(stores):
        out = out.join(store.select(key, *(F.col(c).alias(f"{c}#{i}") for c in defaults if c in store.columns)), key, "left")
    found = {c: F.coalesce(*(F.col(f"`{c}#{i}`") for i, s in enumerate(stores) if c in s.columns), default) for c, default in defaults.items()}
    return out.select(*candidates.columns, *(v.alias(c) for c, v in found.items()))


def answerable(queries: DataFrame, text: str = "query", most: int = 1000) -> DataFrame:
    """Queries that are not blank and not too long; the others have no result."""
    return queries.where((F.trim(F.col(text)) != "") & (F.length(text) <= most))


def insufficient_context(candidates: DataFrame, queries: DataFrame, gate: float = 0.05, query: str = "query_id", score: str = "rerank_score") -> DataFrame:
    """(query, best, insufficient): whether no candidate's score reaches the gate; so it is without candidates."""
    best = candidates.groupBy(query).agg(F.max(score).alias("best"))
    return queries.select(query).join(best, query, "left").withColumn("insufficient", F.coalesce(F.col("best") < gate, F.lit(True)))


def says_insufficient(answer: Column) -> Column:
    """Whether an answer says itself that the passages do not tell."""
    low = F.lower(answer)
    # The phrases of such answers.
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), ("insufficient to answer", "context does not provide"), F.lit(False))


def sigmoid(logit: Column) -> Column:
    return F.round(1 / (1 + F.exp(-logit)), 6)


def log_queries(logs: DataFrame, path: str) -> None:
    """Append answered queries; each gets an id of its own and the time."""
    logs.withColumns({"query_id": F.expr("uuid()"), "created_at": F.current_timestamp()}).write.mode("append").parquet(path)
