"""Query op10: repetition quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.repetition import RepetitionRules, repetition_quality

NAME = "op10_repetition_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(rules: RepetitionRules = RepetitionRules()) -> str:
    lengths = sorted({n for n, _ in rules.limits} | {rules.window})
    most = lengths[-1]
    gram = lambda n: f"CASE WHEN q + {n - 1} <= m THEN hash(concat_ws(chr(1), w{''.join(f', w{i}' for i in range(1, n))})) END"
    marked = "".join(
        f""", g{n} AS (SELECT k, q, w, q + {n - 1} <= m AND count(*) OVER (PARTITION BY k, {gram(n)}) > 1 AS twice FROM ahead),
        c{n} AS (SELECT k, count(*) AS words, sum(length(w)) AS chars FROM (SELECT k, w, max(twice::INT) OVER (PARTITION BY k ORDER BY q ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM g{n}) WHERE inside = 1 GROUP BY k)"""
        for n in lengths
    )
    joins = "".join(f" LEFT JOIN c{n} USING (k)" for n in lengths)
    base = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.window_percent} * n_words)"
    ok = " AND ".join([f"dup_line_chars <= {rules.line_limit} * line_chars", *(f"dup_chars_{n} <= {x} * word_chars" for n, x in rules.limits)])
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    ahead AS (SELECT *, {", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, most))} FROM (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS q, len(ws) AS m FROM d) WINDOW o AS (PARTITION BY k ORDER BY q)),
    lines AS (SELECT k, i, line, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS again FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    l AS (SELECT k, count(*) FILTER (again) AS n_dup, coalesce(sum(length(line)) FILTER (again), 0) AS dup_chars, sum(length(line)) AS all_chars FROM lines GROUP BY k)
    {marked},
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c{rules.window}.words, 0)::BIGINT AS n_repeat_words,
      coalesce(dup_chars, 0)::BIGINT AS dup_line_chars, coalesce(all_chars, 0)::BIGINT AS line_chars, {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n, _ in rules.limits)}
      FROM d LEFT JOIN l USING (k){joins})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND {ok} AS kept, dup_line_chars, {", ".join(f"dup_chars_{n}" for n, _ in rules.limits)} FROM m"""


ORACLE = sql()
