"""Citations, prompts and extractive answers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import safe_prompt_text


def snippet(text: Column, chars: int = 150) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def extractive_answer(text: Column) -> Column:
    """The first two sentences of more than ten characters and a citation, or the first 200 characters."""
    parts = F.slice(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 10), 1, 2)
    return F.concat(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.substring(text, 1, 200)), F.lit(" [1]"))


def insufficient(best: Column, gate: float = 0.05) -> Column:
    return F.coalesce(best < gate, F.lit(True))


def prompts(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, prompt, citations) from ranked candidates (query, rank, doc_id, title, url, text)."""
    passage = F.concat(F.lit('<document index="'), F.col("rank"), F.lit('">\n'), safe_prompt_text(F.col("text")), F.lit("\n</document>"))
    cited = F.struct(F.col("rank").alias("citation_index"), "doc_id", "title", "url", snippet(F.col("text")).alias("snippet"))
    rows = ranked.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", passage.alias("p")))).alias("ps"), F.sort_array(F.collect_list(cited)).alias("citations"))
    return rows.select(query, F.concat(F.lit("<context>\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n</context>")).alias("prompt"), "citations")
