"""All queries over the driver's tables, group by group, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import modes, passages, records, search, text_profile

GROUPS = (text_profile, search, passages, records, modes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.SQL.items()}
