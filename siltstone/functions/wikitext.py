"""Wikitext cleaning as ordered replacements, in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns in order of application.
STEPS = (
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)<ref[^/>]*/>", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"(?i)\[\[(?:File|Image):.*?\]\]", ""),
    (r"(?i)\[\[Category:[^\]]+\]\]", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[(?:[^\]|]*\|([^\]]*)|([^\]]+))\]\]", "$1$2"),
    (r"\[https?://[^\s\]]+(?:\s+([^\]]+))?\]", "$1"),
    (r"<[^>]+>", " "),
    (r"'{2,5}", ""),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?U)^\s+|\s+$", ""),
)


def cleaned(c: Column) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), STEPS, F.coalesce(c, F.lit("")))
