"""Normalisation, flags and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import profiling as P
from siltstone.plans._tables import ARTICLES, articles, table


def normalize_flags(s, d):
    t = T.trimmed(F.col("text"))
    return articles(s, d).select("doc_id", (t == "").alias("is_empty"), (F.length(t) < 50).alias("is_short"), (T.trimmed(F.col("title")) == "").alias("empty_title"), F.col("url").rlike(T.URL).alias("url_ok"), F.length(t).cast("long").alias("char_length"))


def doc_id_parse(s, d):
    return articles(s, d).select("doc_id", T.parsed_id(F.concat(F.lit(" wiki_"), F.col("doc_id").cast("string")), F.lit(-1).cast("long")).alias("parsed"), T.parsed_id(F.col("source"), F.lit(-1).cast("long")).alias("source_no"))


def valid_articles(s, d):
    return articles(s, d).where((T.trimmed(F.col("title")) != "") & (F.length(T.trimmed(F.col("text"))) >= 50) & F.col("url").startswith("http")).select("doc_id", "title", "url")


def token_estimate(s, d):
    return articles(s, d).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


def length_distribution(s, d):
    n = F.length("text")
    points = [F.percentile(n, F.lit(p / 100)).cast("long").alias(f"p{p}") for p in (25, 50, 75, 90, 99)]
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 1).alias("mean"), *points, F.min(n).cast("long").alias("low"), F.max(n).cast("long").alias("high"))


def short_doc_counts(s, d):
    n = F.length("text")
    return table(s, d, "documents").agg(F.count("*").alias("n"), *(F.count_if(n < k).alias(f"under_{k}") for k in (50, 100, 250)), *(P.share(n < k).alias(f"pct_{k}") for k in (50, 100, 250)))


def duplicate_counts(s, d):
    return P.duplicates(table(s, d, "documents"))


def id_uniqueness(s, d):
    # two steps, so that no task holds all distinct ids
    per = table(s, d, "documents").groupBy("doc_id").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count_if(F.col("doc_id").isNotNull()).alias("ids"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(F.col("c") - 1)).alias("dups"))


def null_profile(s, d):
    return P.null_profile(table(s, d, "documents"))


def markup_flags(s, d):
    return table(s, d, "pages").select("page_id", *(F.col("html").rlike(p).alias(k) for k, p in T.MARKUP.items()))


def markup_verdict(s, d):
    return table(s, d, "pages").agg(*(P.share(F.col("html").rlike(p)).alias(k) for k, p in T.MARKUP.items())).withColumn("is_wikitext", (F.col("has_heading") > 30) | (F.col("has_template") > 30))


def url_validity(s, d):
    return table(s, d, "pages").agg(F.count("*").alias("n"), F.count_if(F.col("url").rlike(T.URL)).alias("ok"))


def integrity_flags(s, d):
    head = F.substring("text", 1, 1000)
    letters, n = F.regexp_count(head, F.lit(r"\p{L}")), F.greatest(F.lit(1), F.length(head))
    return table(s, d, "documents").select("doc_id", F.contains("text", F.lit("�")).alias("has_replacement"), F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("has_control"), (letters / n < 0.3).alias("few_letters"))


def near_fingerprints(s, d):
    return table(s, d, "documents").select("doc_id", T.near_fingerprint(F.col("text")).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (normalize_flags, doc_id_parse, valid_articles, token_estimate, length_distribution, short_doc_counts, duplicate_counts, id_uniqueness, null_profile, markup_flags, markup_verdict, url_validity, integrity_flags, near_fingerprints)}

_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_PRINT = "CASE WHEN length(regexp_replace(lower(substring(text, 1, 250)), '[^a-z0-9]', '', 'g')) >= 40 THEN md5(regexp_replace(lower(substring(text, 1, 250)), '[^a-z0-9]', '', 'g')) END"
_FLAGS = ", ".join(f"regexp_matches(html, '{p}') AS {k}" for k, p in T.MARKUP.items())
_SHARES = ", ".join(f"round(100.0 * count(*) FILTER (regexp_matches(html, '{p}')) / count(*), 4) AS {k}" for k, p in T.MARKUP.items())
SQL = {
    "normalize_flags": rf"SELECT doc_id, t = '' AS is_empty, length(t) < 50 AS is_short, trim(title) = '' AS empty_title, regexp_matches(url, '{T.URL}') AS url_ok, length(t)::BIGINT AS char_length FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {ARTICLES})",
    "doc_id_parse": "SELECT doc_id, doc_id AS parsed, regexp_replace(source, '[^0-9]', '', 'g')::BIGINT AS source_no FROM documents",
    "valid_articles": rf"SELECT doc_id, title, url FROM {ARTICLES} WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50",
    "token_estimate": f"SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, floor(n * 1.33::DOUBLE)) END::BIGINT AS tokens FROM (SELECT doc_id, {_WORDS} AS n FROM documents)",
    "length_distribution": "SELECT lang, count(*) AS n, round(avg(length(text)), 1) AS mean, " + ", ".join(f"floor(quantile_cont(length(text), {p / 100}))::BIGINT AS p{p}" for p in (25, 50, 75, 90, 99)) + ", min(length(text))::BIGINT AS low, max(length(text))::BIGINT AS high FROM documents GROUP BY lang",
    "short_doc_counts": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (length(text) < {k}) AS under_{k}, round(100.0 * count(*) FILTER (length(text) < {k}) / count(*), 4) AS pct_{k}" for k in (50, 100, 250)) + " FROM documents",
    "duplicate_counts": f"SELECT 'exact' AS kind, count(text) - count(DISTINCT text) AS n FROM documents WHERE length(text) >= 50 UNION ALL SELECT 'near', count(f) - count(DISTINCT f) FROM (SELECT {_PRINT} AS f FROM documents WHERE length(text) >= 50)",
    "id_uniqueness": "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS dups FROM documents",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, round(100.0 * count(*) FILTER ({c} IS NULL) / greatest(1, count(*)), 4) AS pct FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "markup_flags": f"SELECT page_id, {_FLAGS} FROM pages",
    "markup_verdict": f"SELECT *, has_heading > 30 OR has_template > 30 AS is_wikitext FROM (SELECT {_SHARES} FROM pages)",
    "url_validity": f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '{T.URL}')) AS ok FROM pages",
    "integrity_flags": r"SELECT doc_id, contains(text, chr(65533)) AS has_replacement, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS has_control, length(regexp_replace(h, '[^\p{L}]', '', 'g')) / greatest(1, length(h)) < 0.3 AS few_letters FROM (SELECT *, substring(text, 1, 1000) AS h FROM documents)",
    "near_fingerprints": f"SELECT doc_id, {_PRINT} AS fingerprint FROM documents",
}
