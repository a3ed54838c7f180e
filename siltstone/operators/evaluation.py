"""Retrieval and answer metrics."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from siltstone.functions.text import normal_answer
from siltstone.session import pieces

COUNTS = ArrayType(StructType([StructField(c, IntegerType()) for c in "npg"]))


def retrieval_metrics(runs: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Per query of ``truth`` (query, key, rel): hit rate, set recall and nDCG at each cutoff, and MRR over ``runs`` (query, key, rank)."""
    found = truth.join(runs.select(query, key, "rank"), [query, key], "left")
    ideal = W.partitionBy(query).orderBy(F.desc("rel"), key)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    best = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("place") + 1.0)
    ranked = found.withColumn("place", F.row_number().over(ideal))
    per = [F.coalesce(F.round(1.0 / F.min("rank"), 6), F.lit(0.0)).alias("mrr")]
    for k in cutoffs:
        at = F.col("rank") <= k
        per += [
            F.max(F.when(at, 1.0).otherwise(0.0)).alias(f"hit_rate_{k}"),
            F.round(F.sum(F.when(at, 1.0).otherwise(0.0)) / F.count("*"), 6).alias(f"recall_{k}"),
            F.round(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(at, gain)), F.lit(0.0)) / F.sum(F.when(F.col("place") <= k, best))), 6).alias(f"ndcg_{k}"),
        ]
    return ranked.groupBy(query).agg(*per)


def exact_match(prediction: Column, golds: Column) -> Column:
    p = normal_answer(prediction)
    return F.exists(golds, lambda g: normal_answer(g) == p)


@F.arrow_udf(COUNTS)
def _common(words: pa.Array, golds: pa.Array) -> pa.Array:
    """Of each gold's words: the size of the multiset intersection with ``words``, and both sizes."""
    out = []
    for b in pieces([pa.RecordBatch.from_arrays([words, golds], names=["p", "g"])], 1 << 20):
        for p, golds_of in zip(b["p"], b["g"], strict=True):
            p = p.as_py()
            times = Counter(p)
            out.append([{"n": sum(min(n, times[w]) for w, n in Counter(g).items() if w in times), "p": len(p), "g": len(g)} for g in golds_of.as_py()])
    return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in "npg"])))


def answer_words(c: Column) -> Column:
    return F.filter(F.split(normal_answer(c), " "), lambda w: w != "")


def token_prf(prediction: Column, golds: Column) -> Column:
    """(f1, precision, recall) of normalised tokens as multisets, of the first gold answer with the greatest F1."""
    counts = _common(answer_words(prediction), F.transform(F.coalesce(golds, F.array().cast("array<string>")), answer_words))

    def one(c: Column) -> Column:
        n, p, g = c["n"], c["p"], c["g"]
        part = lambda x: F.when(n > 0, x).otherwise(0.0)
        return F.struct(part(2.0 * n / (p + g)).alias("f1"), part(n / p).alias("precision"), part(n / g).alias("recall"))

    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    best = F.aggregate(F.transform(counts, one), zero, lambda a, x: F.when(x["f1"] > a["f1"], x).otherwise(a))
    return F.transform(F.array(best), lambda r: F.struct(*(F.round(r[c], 4).alias(c) for c in ("f1", "precision", "recall"))))[0]


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two normalised answers; of two empty ones 1."""
    p, g = answer_words(prediction), answer_words(gold)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(token_prf(prediction, F.array(gold))["f1"])


def citation_precision(cited: Column, truth: Column) -> Column:
    """The share of citations that are evidence, repeats counted; without any, 1 where there is no evidence."""
    hits = F.size(F.filter(cited, lambda c: F.array_contains(truth, c)))
    return F.when(F.size(cited) == 0, F.when(F.size(truth) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(cited))


def correct_abstention(insufficient: Column, truth: Column) -> Column:
    return insufficient != (F.size(truth) > 0)


def latency_stats(logs: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    points = [F.round(F.percentile(v, F.lit(p / 100)), 4).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return logs.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), *points, F.min(v).alias("low"), F.max(v).alias("high"))
