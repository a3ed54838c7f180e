"""Tables of benchmark and ablation runs: speedup, best settings, service metrics, means by mode."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from siltstone.operators.evaluation import retrieval_metrics
from siltstone.session import written


def scaling(runs: DataFrame, workers: str = "workers", elapsed: str = "elapsed") -> DataFrame:
    """``runs`` with speedup and efficiency against the run of one worker, else the first. Runs are few."""
    base = runs.agg(F.coalesce(F.min(F.when(F.col(workers) == 1, F.col(elapsed))), F.min_by(elapsed, workers)).alias("base"))
    speedup = F.col("base") / F.greatest(F.lit(0.01), F.col(elapsed))
    return runs.crossJoin(F.broadcast(base)).withColumns({"speedup": F.round(speedup, 2), "efficiency_pct": F.round(speedup / F.col(workers) * 100, 1)}).drop("base")


def best_by(runs: DataFrame, group: str, name: str, good: str, size: str, order: str) -> DataFrame:
    """By group: the run of the greatest ``good`` and of the smallest ``size``, and the first and last by ``order``."""
    least = lambda c: F.min_by(name, F.struct(c, name))
    return runs.groupBy(group).agg(least(-F.col(good)).alias("best"), F.max(good).alias("best_value"), least(F.col(size)).alias("smallest"), F.min_by(name, F.struct(order, name)).alias("first"), F.max_by(name, F.struct(order, name)).alias("last"))


def service_metrics(logs: DataFrame, kind: str, value: str, time: str, key: str, last: int = 1000) -> DataFrame:
    """One row: requests by kind as a map, and percentiles over the ``last`` requests of all."""
    recent = logs.orderBy(F.desc(time), F.desc(key)).limit(last)
    points = [F.round(F.percentile(value, F.lit(p / 100)), 2).alias(f"p{p}") for p in (50, 95, 99)]
    return recent.agg(F.count("*").alias("recent"), *points).crossJoin(logs.agg(F.count("*").alias("total")))


def stage_means(logs: DataFrame, kind: str, value: str) -> DataFrame:
    return logs.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"))


def rolling_mean(logs: DataFrame, group: str, value: str, time: str, key: str, last: int = 1000) -> DataFrame:
    """Each request with the mean over the ``last`` of its group up to it."""
    w = W.partitionBy(group).orderBy(time, key).rowsBetween(1 - last, 0)
    return logs.select(key, group, F.round(F.avg(value).over(w), 4).alias("mean"), F.count("*").over(w).alias("n"))


def mode_metrics(runs: dict[str, DataFrame], truth: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Means of the retrieval metrics by mode over the grounded queries, those of ``truth``; a query without a run is 0.
    The truth is written once for all modes."""
    truth = written(truth, "truth")
    each = [retrieval_metrics(r, truth, cutoffs, key, query).withColumn("mode", F.lit(m)) for m, r in runs.items()]
    names = ["mrr", *(f"{m}_{k}" for k in cutoffs for m in ("hit_rate", "recall", "ndcg"))]
    return reduce(DataFrame.union, each).groupBy("mode").agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 4).alias(c) for c in names))


@dataclass(frozen=True)
class Experiment:
    dimension: str
    name: str
    index: str = "ivf_flat"
    nlist: int = 256
    nprobe: int = 16
    chunk_tokens: int = 256
    mode: str = "hybrid_rrf"
    rerank: bool = True
    workers: int = 1


def experiments(dimension: str | None = None) -> list[Experiment]:
    """The grid: one dimension varies at a time. The settings of each."""
    grid = [
        *(Experiment("index_type", x, index=x) for x in ("flat", "ivf_flat", "ivf_pq")),
        *(Experiment("nprobe", f"nprobe_{n}", nprobe=n) for n in (1, 4, 8, 16, 32, 64, 128)),
        *(Experiment("chunk_size", f"chunk_{n}", chunk_tokens=n) for n in (128, 256, 512)),
        *(Experiment("retrieval_mode", x, mode=x) for x in ("dense", "sparse", "hybrid_rrf", "hybrid_rerank")),
        *(Experiment("reranking", f"rerank_{x}".lower(), rerank=x) for x in (True, False)),
        *(Experiment("worker_count", f"workers_{n}", workers=n) for n in (1, 2, 4, 8, 16)),
    ]
    return [e for e in grid if dimension in (None, e.dimension)]


def pending_experiments(grid: list[Experiment], done: set[str]) -> list[Experiment]:
    return [e for e in grid if e.name not in done]
