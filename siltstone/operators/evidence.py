"""Which passages hold a text or answer a question, by automata over all asked strings: one scan of the passages, no
join on words, and strings of any length, one character included.

The asked strings are a question set; they come to the driver and go out in automata of CHARS characters each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.text import normal_answer
from siltstone.session import map_texts, pieces

CHARS = 2_000_000


def _automata(df: DataFrame, key: str, text: str) -> Iterator[tuple[object, list]]:
    """(automaton over distinct strings, keys of the empty string)."""
    made, chars, blank = ahocorasick.Automaton(), 0, []
    for r in df.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        if not r[1]:
            blank.append(r[0])
        elif r[1] in made:
            made.get(r[1])[1].append(r[0])
        else:
            made.add_word(r[1], (len(r[1]), [r[0]]))
            chars += len(r[1])
        if chars >= CHARS:
            made.make_automaton()
            yield made, blank
            made, chars, blank = ahocorasick.Automaton(), 0, []
    if chars:
        made.make_automaton()
    if chars or blank:
        yield made, blank


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word bounds."""
    before = start > 0 and _word(text[start - 1])
    after = end < len(text) and _word(text[end])
    return before != _word(text[start]) and after != _word(text[end - 1])


def containing(passages: DataFrame, asked: DataFrame, key: str, text: str, query: str, query_text: str, words: bool = False) -> DataFrame:
    """(query, key): passages whose text contains a query's string; with ``words`` only between word bounds. A null
    contains nothing and is contained nowhere; the empty string is in every text."""
    sc = passages.sparkSession.sparkContext
    shared = [sc.broadcast(x) for x in _automata(asked, query, query_text)]
    kinds = asked.schema[query].dataType.simpleString(), passages.schema[key].dataType.simpleString()
    kind = to_arrow_type(asked.schema[query].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[tuple] = []
            for k, t in zip(b[key].to_pylist(), b[text].to_pylist(), strict=True):
                for s in shared if t is not None else ():
                    automaton, blank = s.value
                    held = set(blank)
                    if len(automaton):
                        for end, (n, queries) in automaton.iter(t):
                            if not words or bounded(t, end + 1 - n, end + 1):
                                held.update(queries)
                    out += [(q, k) for q in held]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], kind), pa.array([k for _, k in out], b[key].type)], names=[query, key])

    return map_texts(passages.select(key, text), run, f"{query} {kinds[0]}, {key} {kinds[1]}")


def unioned_answers(answers: Column, aliases: Column) -> Column:
    """Answers, then aliases, trimmed, without blanks, the first of those that differ in case only."""
    trimmed = F.transform(F.concat(F.coalesce(answers, F.array().cast("array<string>")), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.trim(x))
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))
    lower = F.transform(kept, lambda x: F.lower(x))
    return F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def short_answer(answers: Column, least: int = 3) -> Column:
    """Whether an answer's normal form is short or a number, and so may be found by chance."""
    return F.exists(F.filter(F.transform(answers, normal_answer), lambda a: a != ""), lambda a: (F.length(a) < least) | a.rlike(r"^\p{Nd}+$"))


def map_evidence(samples: DataFrame, passages: DataFrame, key: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """(query, key, rel) from samples (query, answers, titles) and passages (key, title, text): 2 where a normalised
    answer is in the text between word bounds and a normalised entity title is the title or in it, 1 for an answer,
    0.5 for a title of two characters or more. Samples without answers, or with blank ones, have no evidence."""
    normal = passages.select(key, normal_answer(F.col("text")).alias("text"), normal_answer(F.col("title")).alias("title"))
    asked = samples.where(F.size(F.filter("answers", lambda a: F.trim(a) != "")) > 0)
    strings = lambda c: asked.select(query, F.explode(F.array_distinct(F.transform(c, normal_answer))).alias("s"))
    spans = containing(normal, strings("answers").where("s <> ''"), key, "text", query, "s", words=True)
    titles = strings("titles").where("s <> ''")
    named = containing(normal, titles.where("length(s) >= 2"), key, "title", query, "s")
    short = titles.where("length(s) < 2")
    named = named.union(normal.join(F.broadcast(short), F.col("title") == F.col("s")).select(query, key))
    marked = spans.distinct().withColumn("span", F.lit(1)).unionByName(named.distinct().withColumn("named", F.lit(1)), allowMissingColumns=True)
    found = marked.groupBy(query, key).agg(F.max("span").alias("span"), F.max("named").alias("named"))
    return found.select(query, key, F.when(F.col("span") + F.col("named") == 2, 2.0).when(F.col("span") == 1, 1.0).otherwise(0.5).alias("rel"))


def mapping_diagnostics(samples: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """One row: queries, grounded ones, positives and how many a grounded query has, short answers, matches by kind."""
    per = evidence.groupBy(query).agg(F.count("*").alias("n"), F.count_if(F.col("rel") != 1.0).alias("by_title"), F.count_if(F.col("rel") >= 1.0).alias("by_span"))
    rows = samples.select(query, short_answer(F.col("answers")).alias("short")).join(per, query, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    grounded = F.count("n")
    return rows.agg(F.count("*").alias("total_queries"), grounded.alias("grounded_queries"), (F.count("*") - grounded).alias("ungrounded_queries"), total("n").alias("total_positives"), F.round(F.coalesce(F.sum("n") / grounded, F.lit(0.0)), 4).alias("avg_positives"), F.count_if("short").alias("short_warnings"), total("by_title").alias("title_matches"), total("by_span").alias("span_matches"))
