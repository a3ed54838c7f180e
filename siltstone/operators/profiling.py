"""Corpus and passage profiles, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltstone.functions.text import near_fingerprint, token_estimate


def share(condition, digits: int = 4):
    return F.round(100.0 * F.count_if(condition) / F.count("*"), digits)


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls, pct), all columns counted in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))).alias("r")
    return one.select("n", rows).select("r.column_name", "r.nulls", F.round(100.0 * F.col("r.nulls") / F.greatest(F.lit(1), "n"), 4).alias("pct"))


def duplicates(df: DataFrame, text: str = "text", least: int = 50) -> DataFrame:
    """(exact, near): surplus copies by the whole text, and by the fingerprint of its start. Counted in two steps,
    so that copies meet as partial counts."""
    long = df.where(F.length(text) >= least)
    exact, near = surplus(long, F.md5(F.col(text).cast("binary"))), surplus(long, near_fingerprint(F.col(text)))
    return exact.select(F.lit("exact").alias("kind"), "n").union(near.select(F.lit("near").alias("kind"), "n"))


def surplus(df: DataFrame, key: Column) -> DataFrame:
    """(n): rows over one of each key; null keys do not count."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("k is not null").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def passage_quality(passages: DataFrame, text: str = "text", path: str = "section_path", lead: str = "user") -> DataFrame:
    """One row: passages, mean tokens, and shares that end a sentence, begin one, and lie in the section ``lead``."""
    t = F.col(text)
    return passages.agg(F.count("*").alias("n"), F.round(F.avg(token_estimate(t)), 4).alias("mean_tokens"), share(t.rlike(r"[.!?\"')\]]$")).alias("ends_well"), share(t.rlike(r"^[\p{Lu}\"'(\[]")).alias("starts_well"), share(F.col(path).endswith(lead)).alias("overview"))


def adjacent_overlap(passages: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text", words: int = 30, of: int = 25) -> DataFrame:
    """(doc, seq, overlap): distinct last words of each passage among the first of the next, as a share of ``of``."""
    ws = F.split(F.col(text), r"\s+")
    head, tail = F.slice(ws, 1, words), F.slice(ws, F.greatest(F.lit(1), F.size(ws) - words + 1), F.lit(words))
    c = passages.select(doc, seq, tail.alias("tail"), F.lead(head).over(W.partitionBy(doc).orderBy(seq)).alias("next"))
    return c.where("next is not null").select(doc, seq, F.least(F.lit(1.0), F.size(F.array_intersect("tail", "next")) / of).alias("overlap"))


def depths(df: DataFrame, path: str, separator: str = ">") -> DataFrame:
    """(depth, n, pct): how many parts the paths have. Depths are few."""
    counts = df.groupBy(F.size(F.split(path, f"\\Q{separator}\\E")).cast("long").alias("depth")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("depth", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))
