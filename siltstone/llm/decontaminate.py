"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. A document's windows have the size of a
benchmark item each; one of the wanted similarity holds a least number of the item's shingles, so windows that hold
fewer of every item's are never rolled. The others are fingerprinted incrementally: the votes of their bits are
differences of running sums. A multi-index over the items' fingerprints, eight tables of a byte each, gives all
items of a window's size within the Hamming radius, which is wider for items of few shingles. Candidates are
verified: the Jaccard similarity of the shingles, weighted by their counts, over the whole window decides. A
radius cannot promise all of a similarity, so windows that hold enough of an item's shingles but lie outside the
radius are verified as well; ``hamming`` tells how far a match lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm._io import map_texts
from siltstone.llm._text import SPACE_PUNCT, U, Words, grams, members, mix, pieces, sieve_of

SHINGLE, THRESHOLD, BLOCKS = 5, 0.8, 8
#: Radius for items of up to so many shingles; votes of few shingles scatter more.
RADII = ((8, 28), (24, 24), (1 << 62, 20))
#: Words whose running votes are held at once.
ROLL = 1 << 15


class ItemIndex:
    """A block of benchmark items: shingles with the items and offsets that hold them, fingerprints, multi-index."""

    def __init__(self, ids: list[list], texts: list[str], shingle: int = SHINGLE, radii: tuple[tuple[int, int], ...] = RADII):
        w = Words(pa.array(texts, pa.string()), SPACE_PUNCT)
        hashes = w.hashes()
        self.ids, self.size, self.shingle = ids, w.counts.astype(np.int64), shingle
        keys, item, self.grams, prints = [], [], [], []
        for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            g = min(shingle, b - a)
            own = self.tagged(grams(hashes[a:b], g), g) if g else np.zeros(0, U)
            self.grams.append(np.unique(own, return_counts=True))
            keys.append(self.grams[-1][0])
            item.append(np.full(len(keys[-1]), k))
            prints.append(packed(votes(own).sum(axis=0, keepdims=True))[0])
        keys, self.item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item))
        order = np.argsort(keys, kind="stable")
        self.item = self.item[order]
        self.keys, self.at = np.unique(keys[order].astype(U), return_index=True)
        self.at = np.append(self.at, len(order))
        self.sieve = sieve_of(self.keys)
        self.lengths = sorted({int(min(shingle, n)) for n in self.size if n})
        self.prints = np.array(prints, U)
        total = np.maximum(self.size - shingle + 1, 1)
        self.radius = np.array([next(r for most, r in radii if n <= most) for n in total], np.int64)
        bits = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256))
        self.tables = [(bits[:, ((self.prints >> U(8 * b)) & U(255)).astype(np.int64)] <= self.radius // BLOCKS) for b in range(BLOCKS)]

    @staticmethod
    def tagged(rolled: np.ndarray, g: int) -> np.ndarray:
        return mix(rolled + U(g))

    def fingerprints(self, rolled: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """SimHash of the windows of ``n`` shingles that begin at ``start`` (ascending), by running sums of votes."""
        out, i = np.zeros(len(start), U), 0
        while i < len(start):
            base = int(start[i])
            j = max(i + 1, int(np.searchsorted(start, base + ROLL)))
            near = start[i:j] - base
            sums = np.zeros((int(near[-1]) + n + 1, 64), np.int32)
            np.cumsum(votes(rolled[base : base + len(sums) - 1]), axis=0, out=sums[1:])
            out[i:j] = packed(sums[near + n] - sums[near])
            i = j
        return out

    def within(self, prints: np.ndarray, size: int, whole: bool) -> Iterator[tuple[int, int]]:
        """(window, item) for all items within their radius: one of 8 bytes differs in radius // 8 bits at most. Items
        are of the window's size, or, where it is a whole text, larger."""
        fits = self.size >= size if whole else self.size == size
        for at in range(0, len(prints), 256):
            own = prints[at : at + 256]
            some = np.zeros((len(own), len(self.prints)), bool)
            for b, table in enumerate(self.tables):
                some |= table[((own >> U(8 * b)) & U(255)).astype(np.int64)]
            i, k = np.nonzero(some & fits)
            near = np.bitwise_count(self.prints[k] ^ own[i]) <= self.radius[k]
            yield from zip((i[near] + at).tolist(), k[near].tolist(), strict=True)

    def similarity(self, g: np.ndarray, times: np.ndarray, k: int) -> float:
        u, c = self.grams[k]
        both = np.union1d(g, u)
        x, y = np.zeros(len(both)), np.zeros(len(both))
        x[np.searchsorted(both, g)], y[np.searchsorted(both, u)] = times, c
        return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())

    def search(self, texts: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """(text, item) -> best similarity, its Hamming distance and first word, number of windows that match: all of the item's size count."""
        w = Words(texts, SPACE_PUNCT)
        hashes, first = w.hashes(), w.first
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for g in self.lengths:
            rolled = self.tagged(grams(hashes, g), g)
            hit, at = members(self.keys, rolled, self.sieve)
            text = np.searchsorted(first, hit, "right") - 1
            inside = hit + g <= first[text + 1]
            hit, at, text = hit[inside], at[inside], text[inside]
            times = self.at[at + 1] - self.at[at]
            of = np.repeat(np.arange(len(hit)), times)
            post = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + self.at[at][of]
            item = self.item[post]
            fits = np.minimum(self.shingle, self.size[item]) == g
            held = np.stack([text[of][fits], item[fits], hit[of][fits]], axis=1)
            held = held[np.lexsort(held.T[::-1])]
            if not len(held):
                continue
            edges = np.append(np.flatnonzero(np.append(True, (np.diff(held[:, :2], axis=0) != 0).any(axis=1))), len(held))
            t, k = held[edges[:-1], 0], held[edges[:-1], 1]
            sizes = np.minimum(self.size[k], first[t + 1] - first[t])
            leasts = threshold / (1 + threshold) * (sizes + self.size[k] - 2 * g + 2) - 1e-9  # of common shingles
            placed: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            for i in np.flatnonzero(np.diff(edges) >= leasts).tolist():
                a, b, t, k, size = edges[i], edges[i + 1], *held[edges[i], :2].tolist(), int(sizes[i])
                at = held[a:b, 2]
                start = np.arange(max(first[t], at[0] - size + g), min(first[t + 1] - size, at[-1]) + 1)
                inside = np.searchsorted(at, start + size - g, "right") - np.searchsorted(at, start)
                start = start[inside >= leasts[i]]
                if len(start):
                    placed.setdefault((t, size), []).append((k, start))
            for (t, size), of_items in placed.items():
                start, n = np.unique(np.concatenate([s for _, s in of_items])), size - g + 1
                prints = self.fingerprints(rolled, start, n)
                pairs = set(self.within(prints, size, size == first[t + 1] - first[t]))
                pairs.update((int(i), k) for k, s in of_items for i in np.searchsorted(start, s))
                last, u, c = -1, None, None
                for i, k in sorted(pairs):
                    if i != last:
                        last, (u, c) = i, np.unique(rolled[start[i] : start[i] + n], return_counts=True)
                    if min(self.shingle, self.size[k]) == g and (s := self.similarity(u, c, k)) >= threshold:
                        best = found.get((t, k))
                        here = (s, int(np.bitwise_count(self.prints[k] ^ prints[i])), int(start[i] - first[t]))
                        found[t, k] = (*max(here, best[:3], key=lambda x: (x[0], -x[1], -x[2])), best[3] + 1) if best else (*here, 1)
        return found


def votes(hashes: np.ndarray) -> np.ndarray:
    """What each hash votes for each of 64 bits: 1 or -1."""
    return (2 * np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0].astype(U)


def item_blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[ItemIndex]:
    """The distinct texts of the benchmark, each with the ids of its items, in blocks of about ``block_chars``."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    ids, texts, chars = [], [], 0
    for r in rows.groupBy("t").agg(F.sort_array(F.collect_list("i")).alias("i"), F.count_if(F.col("i").isNull()).alias("none")).toLocalIterator():
        ids.append([None] * r["none"] + r["i"])
        texts.append(r["t"])
        chars += len(r["t"])
        if chars >= block_chars:
            yield ItemIndex(ids, texts)
            ids, texts, chars = [], [], 0
    if ids:
        yield ItemIndex(ids, texts)


class Benchmark:
    """All blocks as broadcasts. One scan of the texts meets all of them: with several blocks a task holds about
    ``held`` bytes of its texts and walks the blocks, of which it has one in memory."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, item: str, text: str, block_chars: int, held: int = 64 << 20):
        self.shared, self.held = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark, item, text, block_chars)], held

    def search(self, batches: Iterator[pa.RecordBatch], column: str, threshold: float) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Runs of rows with their matches, (row, ids of the item, similarity, distance, first word, windows)."""
        few = len(self.shared) <= 1
        waiting: list[tuple[pa.RecordBatch, list]] = []
        size = 0
        for part in pieces(batches, column):
            waiting.append((part, []))
            size += part.nbytes
            if few or size >= self.held:
                yield from self._walk(waiting, column, threshold, few)
                waiting, size = [], 0
        yield from self._walk(waiting, column, threshold, few)

    def _walk(self, waiting: list, column: str, threshold: float, few: bool) -> list:
        for shared in self.shared if waiting else ():
            index = shared.value if few or shared._path is None else shared.load_from_path(shared._path)
            for part, found in waiting:
                found += [(t, index.ids[k], *v) for (t, k), v in sorted(index.search(part[column], threshold).items())]
        return waiting


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_windows): one row for each document row and
    item row with a window of similarity ``threshold`` or more.

    A null, empty or wordless text or item matches nothing; an empty table, of documents or items, gives no rows.
    A text shorter than an item is one window. Items of fewer than five words count as one shingle. Repeated
    rows give a result each, and do not change others' results; of a pair's equally similar windows the one with the
    nearest fingerprint, then the first, is told. Texts and items of any length are searched whole; columns but the
    named ones are not read.
    """
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind, item_kind = src.schema["doc_id"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    bench = Benchmark(docs.sparkSession, benchmark, item, item_text, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in bench.search(batches, "text", threshold):
            rows = [(t, i, *rest) for t, ids, *rest in found for i in ids]
            if rows:
                t, i, s, h, at, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(t)), pa.array(i), pa.array(s), pa.array(h, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_windows"])

    return map_texts(src, run, f"doc_id {kind}, item_id {item_kind}, similarity double, hamming int, first_word long, n_windows long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that no item matches, all columns, whatever their names; the same rules as find_leaks,
    without a shuffle. Rows with a null, empty or wordless text stay; an empty benchmark takes nothing out."""
    bench = Benchmark(docs.sparkSession, benchmark, item, item_text, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in bench.search(batches, text, threshold):
            keep = np.ones(part.num_rows, bool)
            keep[[x[0] for x in found]] = False
            yield part.filter(pa.array(keep))

    return map_texts(docs, run, docs.schema)
