"""Articles to passages: sections, sentences, and packed windows of sentences with overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import chunk_id
from siltstone.functions.wikitext import STEPS
from siltstone.session import map_texts, pieces

# Abbreviations that end no sentence, and sections that are left out.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Gen Rep Sen Gov St Mt U.S U.K e.g i.e vs approx vol dept univ etc al".split()
LEFT_OUT = {"references", "external links", "see also", "further reading", "notes"}
SENTENCE = regex.compile(r"(?<!\b(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.)(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
HEADING = re.compile(r"^(?:(={2,5})\s*(.+?)\s*\1|(#{2,5})\s+(.+?))\s*$", re.M)
CLEAN = tuple((regex.compile(p.replace("(?U)", "")), new.replace("$1$2", r"\1\2").replace("$1", r"\1")) for p, new in STEPS)


@dataclass(frozen=True)
class ChunkRules:
    target: int = 256
    overlap: int = 40
    least: int = 40


def count_tokens(text: str) -> int:
    n = len(text.split())
    return max(1, int(n * 1.33)) if text else 0


def clean(text: str) -> str:
    for pattern, new in CLEAN:
        text = pattern.sub(new, text)
    return text


def sections(title: str, text: str) -> Iterator[tuple[str, str]]:
    """(path, text) of each section with text left after cleaning; the lead has the path ``title > Overview``."""
    marks = [*HEADING.finditer(text)]
    stack: list[tuple[int, str]] = []
    path, start, keep = f"{title} > Overview", 0, True
    for m in [*marks, None]:
        body = clean(text[start : m.start() if m else len(text)]) if keep else ""
        if body:
            yield path, body
        if m:
            level, name = len(m[1] or m[3]), (m[2] or m[4]).strip()
            keep, start = name.lower() not in LEFT_OUT, m.end()
            if keep:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, name))
                path = " > ".join([title, *(n for _, n in stack)])


def pack(parts: list[tuple[str, int]], limit: int, joint: int = 0) -> list[tuple[str, int]]:
    """Join parts in order while they fit."""
    out: list[tuple[str, int]] = []
    for text, n in parts:
        if out and out[-1][1] + n + joint <= limit:
            out[-1] = f"{out[-1][0]} {text}", out[-1][1] + n + joint
        else:
            out.append((text, n))
    return out


def sentences(text: str, rules: ChunkRules, count: Callable[[str], int]) -> list[tuple[str, int]]:
    out = []
    for s in filter(None, (x.strip() for x in SENTENCE.split(text))):
        n = count(s)
        if n <= rules.target:
            out.append((s, n))
            continue
        clauses = re.split(r"(?<=[;,])\s+", s)
        if len(clauses) > 1:
            out += pack([(c, count(c)) for c in clauses], rules.target, 1)
        else:
            words, step = s.split(), max(1, rules.target - rules.overlap)
            out += [(w, count(w)) for w in (" ".join(words[i : i + rules.target]) for i in range(0, len(words), step))]
    return out


def windows(parts: list[tuple[str, int]], rules: ChunkRules) -> Iterator[tuple[str, int]]:
    """Sentences up to the target; each next window begins with the last sentences of the one before, at least one."""
    held: list[tuple[str, int]] = []
    size = 0
    for s in parts:
        if held and size + s[1] > rules.target:
            yield " ".join(t for t, _ in held), size
            tail: list[tuple[str, int]] = []
            carried = 0
            for t in reversed(held):
                if tail and (carried >= rules.overlap or carried + t[1] > rules.overlap):
                    break
                tail.insert(0, t)
                carried += t[1]
            held, size = tail, carried
        held.append(s)
        size += s[1]
    if held:
        yield " ".join(t for t, _ in held), size


def chunk_article(title: str, text: str, rules: ChunkRules = ChunkRules(), count: Callable[[str], int] = count_tokens) -> list[tuple[str, str, int]]:
    """(section path, passage, tokens). A small last fragment joins the passage before if the two fit 1.25 targets."""
    out: list[tuple[str, str, int]] = []
    for path, body in sections(title, text):
        for passage, n in windows(sentences(body, rules, count), rules):
            if n < rules.least and out and out[-1][2] + n <= int(1.25 * rules.target):
                last = out[-1]
                out[-1] = last[0], f"{last[1]} {passage}", last[2] + n
            else:
                whole = f"{title} - {path}\n{passage}"
                out.append((path, whole, count(whole)))
    return out


def chunk_documents(articles: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """(chunk_id, doc_id, title, url, section_path, text, token_count, seq) from (doc_id, title, url, text); blank
    articles give nothing, and an article that fails gives a row with ``error`` and no passage."""
    names = ["doc_id", "title", "url", "seq", "section_path", "text", "token_count", "error"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            rows = []
            for doc, title, url, text in zip(*(b[c].to_pylist() for c in ("doc_id", "title", "url", "text")), strict=True):
                try:
                    if text and text.strip():
                        rows += [(doc, title, url, i, path, t, n, None) for i, (path, t, n) in enumerate(chunk_article(title or "", text, rules))]
                except Exception as e:  # one article must not end the batch
                    rows.append((doc, title, url, None, None, None, None, repr(e)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    made = map_texts(articles.select("doc_id", "title", "url", "text"), run, "doc_id long, title string, url string, seq int, section_path string, text string, token_count int, error string")
    return made.select(chunk_id(F.col("doc_id"), F.col("seq")).alias("chunk_id"), *names)


def body(text: Column) -> Column:
    """A passage without its header line."""
    return F.regexp_replace(text, r"^[^\n]*\n", "")


def rechunk(chunks: DataFrame, rules: ChunkRules) -> DataFrame:
    """Passages put together again by document and cut anew."""
    parts = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", body(F.col("text")).alias("body")))).alias("p"), F.min("title").alias("title"), F.min("url").alias("url"))
    return chunk_documents(parts.withColumn("text", F.array_join(F.transform("p", lambda x: x["body"]), "\n\n")), rules)
