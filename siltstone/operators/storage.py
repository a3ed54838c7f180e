"""Idempotent writes as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert_last_wins(current: DataFrame, new: DataFrame, key: str, version: Column) -> DataFrame:
    """All keys of both, each with the row of the greatest version."""
    rows = current.unionByName(new).withColumn("__v", version)
    rest = [c for c in current.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__v").alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def insert_ignore(current: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """``current``, and of each new key the first row in ``order``."""
    rest = [c for c in new.columns if c != key]
    fresh = new.join(current.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return current.unionByName(fresh.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)))


def pending(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units that are not done yet."""
    return units.join(done.select(key), key, "left_anti")
