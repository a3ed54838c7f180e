"""Column functions on text: trimming, tokens, normal forms, flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English stop words that the lexical index leaves out.
STOP_WORDS = tuple(
    "a above after again all an and are as at be been before being below between both but by can could did do does during each every few for from further had "
    "has have he her here him his how i if in into is it its may me might more most my no nor not of off on once only or other our out over own same shall she "
    "should so some such than that the their them then there they this through to too under very was we were what when where which who whom why will with would you your".split()
)
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
# What counts as markup.
MARKUP = {
    "has_html": r"(?i)<(?:div|span|p|a|table|tr|td|th|ul|ol|li|b|i|strong|em|br|hr)\b[^>]*>",
    "has_template": r"(?s)\{\{.*?\}\}",
    "has_table": r"(?s)\{\|.*?\|\}",
    "has_heading": r"(?m)^={2,5}\s*.*?\s*={2,5}",
    "has_link": r"\[\[.*?\]\]",
    "has_ref": r"(?i)<ref\b[^>]*>",
}


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def index_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that are no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def token_estimate(c: Column) -> Column:
    n = F.size(words(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.33))))


def normal_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def near_fingerprint(c: Column, chars: int = 250, least: int = 40) -> Column:
    kept = F.regexp_replace(F.lower(F.substring(c, 1, chars)), "[^a-z0-9]", "")
    return F.when(F.length(kept) >= least, F.md5(kept.cast("binary")))


def parsed_id(c: Column, fallback: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.coalesce(F.when(digits != "", digits.try_cast("long")), fallback)


def chunk_id(doc: Column, seq: Column) -> Column:
    return F.shiftleft(doc.cast("long"), 16).bitwiseOR(seq.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long")))


def chunk_parts(c: Column) -> tuple[Column, Column]:
    return F.shiftright(c, 16), c.bitwiseAND(F.lit(0xFFFF).cast("long"))


def safe_prompt_text(c: Column) -> Column:
    """Without the delimiters that a prompt uses around its passages."""
    return F.regexp_replace(c, r"(?i)</?(?:context|document)[^>]*>", "")
