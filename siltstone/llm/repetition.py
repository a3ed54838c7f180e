"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole Arrow batches, find the words that lie
in n-grams that a text holds twice or more; the characters of these words, as a share of all
characters in words, must stay under a limit for each length, and so must the characters in repeated
lines. No shuffle, no state between rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm._io import free_name, map_texts
from siltstone.llm._text import SPACE, U, Words, byte_values, grams, mix, pieces, span_hashes

EXACT = byte_values(fold=False)
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """``limits``: n-gram length and the share of characters that may lie in repeated n-grams of it;
    ``line_limit``: the same for repeated lines. They stand a little above what documents labelled good reach (0.28 up to
    9 words, 0.18 for 10, 0.16 for lines). ``window``, ``window_percent`` and ``min_words`` make the base rule."""

    limits: tuple[tuple[int, float], ...] = ((2, 0.40), (3, 0.36), (4, 0.34), (5, 0.32), (6, 0.31), (7, 0.30), (9, 0.30), (10, 0.22))
    line_limit: float = 0.22
    window: int = 8
    window_percent: int = 30
    min_words: int = 20


def repeated_starts(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the positions ``among`` whose key occurs there more than once."""
    if len(among) < 2:
        return among[:0]
    own = keys[among]
    bits = min(26, int(len(own)).bit_length() + 3)
    slot = (own >> U(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = maybe[np.argsort(own[maybe], kind="stable")]
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return among[np.sort(order[twice])]


def measure(texts: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    w = Words(texts)
    n_texts = len(w.counts)
    heads = (w.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(heads, dtype=np.int64)])
    chars = points[w.end] - points[w.start]
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[w.first])
    out = {"n_words": w.counts, "word_chars": total(chars), "n_symbols": np.diff(np.concatenate([[0], np.cumsum(SYMBOL[w.data], dtype=np.int64)])[w.bounds])}

    salted = w.hashes(EXACT)
    of = w.text_of()
    left = w.first[1:][of] - np.arange(len(of))
    per_text = mix(np.arange(1, n_texts + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
    found, shares = np.arange(len(salted)), {}
    for n in sorted({n for n, _ in rules.limits} | {rules.window}):
        rolled = grams(salted, n)
        found = found[left[found] >= n]  # an n-gram can be repeated only where its head is
        found = repeated_starts(rolled ^ per_text[of[: len(rolled)]], found)
        marks = np.zeros(len(salted) + 1, np.int32)
        marks[found] += 1
        np.subtract.at(marks, found + n, 1)
        inside = np.cumsum(marks[:-1]) > 0
        shares[n] = total(inside * chars)
        if n == rules.window:
            out["n_repeat_words"] = total(inside)

    breaks = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([w.bounds[1:], breaks]), kind="stable")
    line_of = np.searchsorted(w.bounds, starts, "right") - 1
    held = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_of = starts[held], ends[held], line_of[held]
    keys = mix(span_hashes(w.data, starts, ends, EXACT)) ^ per_text[line_of]
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    length = points[ends] - points[starts]
    sums = lambda values: np.bincount(line_of, values, n_texts).astype(np.int64)
    out["n_dup_lines"] = sums(again.astype(float))
    out["dup_line_chars"], line_chars = sums((again * length).astype(float)), sums(length.astype(float))

    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.window_percent * out["n_words"])
    ok = out["dup_line_chars"] <= rules.line_limit * line_chars
    for n, limit in rules.limits:
        out[f"dup_chars_{n}"] = shares[n]
        ok &= shares[n] <= limit * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ok
    return out


def repetition_quality(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures and the verdict for each row, beside the columns ``carry``.

    A null or empty text has no words: it fails the base rule. Ties and repeated rows are judged
    alike, each row by itself; an empty table gives no rows. Columns other than ``carry`` and
    ``text`` are not read, so extra columns and their names do not matter.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["dup_line_chars", *(f"dup_chars_{n}" for n, _ in rules.limits)]
    held = free_name("text", list(carry))
    src = docs.select(*(F.col(c) for c in carry), F.col(text).alias(held))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{c} long" for c in longs), "base_failed boolean", "kept boolean", *(f"{c} long" for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, held):
            m = measure(part[held], rules)
            columns = [part[c] for c in carry] + [pa.array(m[c], pa.int64()) for c in longs] + [pa.array(m[c]) for c in ("base_failed", "kept")] + [pa.array(m[c], pa.int64()) for c in extra]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *longs, "base_failed", "kept", *extra])

    return map_texts(src, run, schema)


def drop_repetitive(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows that repetition_quality keeps, all columns, whatever their names. A null, empty or wordless text goes,
    equal texts go or stay together, texts of any length are measured whole, an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            yield part.filter(pa.array(measure(part[text], rules)["kept"]))

    return map_texts(docs, run, docs.schema)
