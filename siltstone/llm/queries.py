"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import q_archives, q_html, q_jaccard, q_language, q_leaks, q_mixing, q_quality, q_suffix, q_tokens, q_urls

MODULES = (q_html, q_tokens, q_leaks, q_jaccard, q_urls, q_mixing, q_archives, q_suffix, q_language, q_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if hasattr(m, "ORACLE")}
