"""Numpy kernels over whole Arrow text columns: word bounds, word hashes, shingles.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Both rules act on single
ASCII bytes, so they hold for UTF-8 as it is. Hashes are 64-bit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_SEGMENT = 1 << 20
_pow: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.copy()
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def byte_values(fold: bool = True) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def blanks(punctuation: bool = False) -> np.ndarray:
    """Which bytes part words: white space, and with ``punctuation`` all ASCII that is neither letter nor digit."""
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    if punctuation:
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


FOLDED, SPACE, SPACE_PUNCT = byte_values(), blanks(), blanks(True)


def _powers(n: int) -> list[np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        n = max(n, _SEGMENT + 1)
        _pow[:] = []
        for base in (_STEP, _BACK):
            p = np.full(n, base, U)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = _SEGMENT) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; a longer text makes a run of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch[column].fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end; Spark reuses the worker, which would else keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and each text's bounds; null is empty."""
    texts = pc.cast(texts.fill_null(""), pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``first`` (index of each text's first word, and the total)."""

    def __init__(self, texts: pa.Array, space: np.ndarray = SPACE):
        self.data, self.bounds = flatten(texts)
        filled = ~space[self.data]
        begins, ends = filled.copy(), filled.copy()
        begins[1:] &= ~filled[:-1]
        ends[:-1] &= ~filled[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        begins[inner] = filled[inner]
        ends[inner - 1] = filled[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, values: np.ndarray = FOLDED) -> np.ndarray:
        return mix(span_hashes(self.data, self.start, self.end, values))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A polynomial hash of each ascending span, in segments so that memory stays bounded."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + _SEGMENT, "right")))
        size = int(end[j - 1]) - base
        forth, back = _powers(size + 1)
        sums = np.zeros(size + 1, U)
        np.cumsum(values[data[base : base + size]] * forth[:size], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * back[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15)
        i = j
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive words, bounds of texts ignored; len(words) - n + 1 of them."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, U)
    for k in range(n):
        out *= U(0x9E6C63D0876A9A47)
        out += words[k : k + m]
    return mix(out)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, ascending; with fewer words, the whole sequence as one."""
    hashes = words.hashes()
    rolled, out = grams(hashes, n), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(hashes[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def members(sorted_keys: np.ndarray, x: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``x`` of values among ``sorted_keys``, and their indexes there."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(sieve[(x & U(len(sieve) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_keys, x[hit]), len(sorted_keys) - 1)
    same = sorted_keys[at] == x[hit]
    return hit[same], at[same]


def sieve_of(keys: np.ndarray) -> np.ndarray:
    """A table of low bits of ``keys``; most values that are not keys fail on it."""
    bits = max(10, min(24, int(len(keys)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[(keys & U((1 << bits) - 1)).astype(np.int64)] = True
    return table
