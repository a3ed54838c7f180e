"""Full-text search: all of a query's stems must be in the text; the rank is by the density of covers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from siltstone.functions.english import STOPS, WORD, lexemes, stem
from siltstone.session import bounded, map_texts, pieces

WEIGHT = 0.1  # of a word of ordinary weight
TSV = "array<struct<lexeme:string,places:array<int>>>"
QUERIES = 100_000
#: Words whose place among the lexemes a task remembers.
KNOWN = 300_000


def _tsv(texts: pa.Array, terms: list[str] | None, known: dict[str, int]) -> pa.Array:
    """The lexemes of each text by name, with their places; with ``terms``, sorted and distinct, only those.
    ``known`` has the number of each word's lexeme, -1 where it has none, and is kept between calls."""
    names = terms if terms is not None else []
    number = {t: i for i, t in enumerate(names)}
    if len(known) > KNOWN:
        known.clear()
    if terms is None:
        known.clear()
    lists, ends, place = [], [0], []
    for t in texts:
        words = WORD.findall((t.as_py() or "").lower())
        for w in set(words).difference(known):
            s = None if w in STOPS else stem(w)
            if terms is None and s is not None and s not in number:
                number[s] = len(names)
                names.append(s)
            known[w] = -1 if s is None else number.get(s, -1)
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(code >= 0)
        lists.append(code[at])
        place.append((at + 1).astype(np.int32))
        ends.append(ends[-1] + len(at))
    names = np.array(names, dtype=object)
    by_name = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    code, place = rank[np.concatenate(lists or [np.zeros(0, np.int64)])], np.concatenate(place or [np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    order = np.lexsort((place, code, row))
    row, code, place = row[order], code[order], place[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(place))
    lexeme = pa.array(names[by_name], pa.string()).take(pa.array(code[first]))
    bounds = np.searchsorted(row[first], np.arange(len(lists) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([lexeme, places], ["lexeme", "places"]))


def with_lexemes(df: DataFrame, text: str = "text", name: str = "text_tsv", terms: Iterable[str] | None = None) -> DataFrame:
    """``df`` with its text's lexemes, a column made when rows are written, so that a search need not read texts. With
    ``terms`` only these lexemes, for a search whose queries are known; places are counted over all words either way."""
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(None if terms is None else sorted(set(terms)))
    known: dict[str, int] = {}

    @F.arrow_udf(TSV)
    def made(texts: pa.Array) -> pa.Array:
        cut = pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 1 << 20)
        return pa.concat_arrays([_tsv(b["t"], shared.value, known) for b in cut] or [_tsv(texts, shared.value, known)])

    return df.withColumn(name, made(F.col(text)))


def query_lexemes(queries: DataFrame, query_text: str = "query") -> set[str]:
    """All lexemes of a question set, which comes to the driver, up to QUERIES."""
    rows = queries.select(query_text).limit(QUERIES + 1).collect()
    if len(rows) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries in one search")
    return {t for (text,) in rows for t in lexemes(text)}


def cover_rank(places: dict[str, list[int]], terms: set[str]) -> float:
    """The sum over minimal covers of the terms, each discounted by the other words in it."""
    marks = sorted((p, t) for t in terms for p in places[t])
    held, rank, start = Counter(), 0.0, 0
    for end, (q, t) in enumerate(marks):
        held[t] += 1
        if len(held) < len(terms):
            continue
        while held[marks[start][1]] > 1:
            held[marks[start][1]] -= 1
            start += 1
        rank += WEIGHT / (1 + (q - marks[start][0]) - (end - start))
        del held[marks[start][1]]
        start += 1
    return rank


def fulltext_search(passages: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", tsv: str = "text_tsv", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, key, score, rank) over passages with lexemes: each query's ``k`` best, ties by key. A query without
    lexemes finds nothing. The question set comes to the driver, up to QUERIES; more are a mistake here."""
    asked: dict[str, list] = defaultdict(list)
    need: dict[object, set[str]] = {}
    rows = queries.select(query, query_text).limit(QUERIES + 1).collect()
    if len(rows) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries in one search")
    for q, text in rows:
        need[q] = set(lexemes(text))
    times = Counter(t for terms in need.values() for t in terms)
    for q, terms in need.items():  # a query is looked up by the lexeme that the fewest queries have
        if terms:
            asked[min(terms, key=lambda t: (times[t], t))].append(q)
    shared = passages.sparkSession.sparkContext.broadcast((dict(asked), need, sorted(times)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, need, terms = shared.value
        wanted = pa.array(terms, pa.string())
        for b in pieces(batches, 1 << 20):
            out, keys = [], b[key].to_pylist()
            flat, row = b[tsv].flatten(), np.repeat(np.arange(b.num_rows), pc.fill_null(b[tsv].value_lengths(), 0).to_numpy(zero_copy_only=False))
            held = pc.indices_nonzero(pc.is_in(flat.field("lexeme"), value_set=wanted))
            row, some = row[held.to_numpy()], flat.take(held)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i, one in enumerate(keys):
                mine = some.slice(ends[i], ends[i + 1] - ends[i])
                at = {t: j for j, t in enumerate(mine.field("lexeme").to_pylist())}
                for q in (q for t in at if t in asked for q in asked[t]):
                    if need[q] <= at.keys():
                        places = {t: mine.field("places")[at[t]].as_py() for t in need[q]}
                        out.append((q, one, round(cover_rank(places, need[q]), 6)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), b[key].type, pa.float64()))], names=[query, key, "score"])

    found = map_texts(passages.select(key, tsv), run, f"{query} long, {key} {passages.schema[key].dataType.simpleString()}, score double")
    order = W.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
