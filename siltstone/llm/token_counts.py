"""Edit-aware token counts.

A document is kept as a segment tree over its pre-tokens: leaves are runs of pre-tokens, inner nodes sum
characters and tokens. An edit replaces a range of characters. Only the leaves it touches change: the
text from a few pre-tokens before the edit is cut again until a cut falls on an old bound behind the
edit, the new pre-tokens are encoded, and the sums on the path to the root are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siltstone.llm._text import pieces

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that goes with the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How many pre-tokens before an edit can depend on it: the pattern looks at most two characters past a bound.
CONTEXT = 3
LEAF = 64
#: Personal data, with what replaces it: a mail address, a long number. A search begins only where a run of
#: possible characters does, and gives none of it back, so that text without blanks takes linear time.
REDACTIONS = ((r"(?<![^\s@<>])[^\s@<>]++@[^\s@<>]+\.[^\s@<>]+", "[mail]"), (r"\d[\d() .-]{6,}\d", "[number]"))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token counts of pre-tokens, remembered up to ``room`` of them."""

    def __init__(self, path: str, room: int = 400_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # pre-tokens are cut here: the encoder's own cutting overflows its stack on a million blanks
        self.encode, self.encode_one = made.encode_ordinary, made._encode_single_piece
        self.cut, self.known, self.room = regex.compile(PATTERN), {}, room

    @classmethod
    def at(cls, path: str) -> Encoder:
        return _encoders.get(path) or _encoders.setdefault(path, cls(path))

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in parts]
        except KeyError:
            if len(known) > self.room:
                known.clear()
            for p in set(parts):
                if p not in known:
                    n = len(self.encode_one(p))
                    if len(p) < 256:
                        known[p] = n
            return [known[p] if p in known else len(self.encode_one(p)) for p in parts]


class TokenTree:
    """A text's pre-tokens in leaves of up to 2 x LEAF, and a binary tree of their characters and tokens.

    A leaf that an edit makes longer is split, and one that it empties goes; the sums of the inner nodes are
    then added up anew, from those of the leaves and without encoding anything.
    """

    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        parts = encoder.cut.findall(text)
        counts = encoder.counts(parts)
        self.encoded = len(parts)
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        starts = np.arange(0, len(parts), LEAF)
        add = lambda values: np.add.reduceat(np.array(values, np.int64), starts) if parts else np.zeros(1, np.int64)
        self._grow(add([len(p) for p in parts]), add(counts))

    def _grow(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.base), np.int64)
        self.sums[:, self.base : self.base + len(self.leaves)] = chars, tokens
        level = self.base
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last leaf for the end), and its first character's place."""
        node, before, chars = 1, 0, self.sums[0]
        place = min(place, max(0, int(chars[1]) - 1))
        while node < self.base:
            left = int(chars[2 * node])
            if place < before + left:
                node = 2 * node
            else:
                before, node = before + left, 2 * node + 1
        return min(node - self.base, len(self.leaves) - 1), before

    def _replace(self, first: int, last: int, parts: list[str]) -> None:
        """Put ``parts`` in the place of the leaves first to last."""
        made = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] if len(parts) > 2 * LEAF else [parts] * bool(parts)
        if not made and last - first + 1 == len(self.leaves):
            made = [[]]
        sums = np.array([[sum(map(len, x)) for x in made], [sum(self.encoder.counts(x)) for x in made]], np.int64)
        self.leaves[first : last + 1] = made
        if len(made) == last - first + 1:
            for leaf, (c, t) in enumerate(sums.T.tolist(), first):
                node = self.base + leaf
                self.sums[:, node] = c, t
                while node > 1:
                    node //= 2
                    self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
        else:
            old = self.sums[:, self.base :]
            count = len(self.leaves) - len(made) + last - first + 1
            self._grow(*np.concatenate([old[:, :first], sums, old[:, last + 1 : count]], axis=1))

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters [start, end)."""
        first, before = self.find(start)
        last = max(first, self.find(end)[0])
        head = self.leaves[first]
        at, k = before, 0
        while k < len(head) and at + len(head[k]) <= start:
            at += len(head[k])
            k += 1
        while k < CONTEXT and first > 0:
            first -= 1
            head = self.leaves[first]
            before -= sum(map(len, head))
            k += len(head)
        kept = [p for leaf in self.leaves[first : last + 1] for p in leaf][: max(0, k - CONTEXT)]
        start_cut = before + sum(map(len, kept))
        while True:
            # old text from the first pre-token that may change; twice as many leaves until the cuts meet behind the edit
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf][len(kept) :]
            text = "".join(old)
            changed = text[: start - start_cut] + new + text[end - start_cut :]
            shift = len(new) - (end - start)
            bounds, place = {}, start_cut
            for i, p in enumerate(old):
                if place >= end:
                    bounds[place + shift - start_cut] = i
                place += len(p)
            fresh, tail = [], None
            whole = last + 1 == len(self.leaves)
            for m in self.encoder.cut.finditer(changed):
                if (i := bounds.get(m.start())) is not None and m.start() >= start - start_cut + len(new):
                    tail = i
                    break
                fresh.append(m.group())
            if tail is not None or whole:
                break
            last = min(len(self.leaves) - 1, 2 * last - first + 1)
        self.encoded += len(fresh)
        self._replace(first, last, kept + fresh + (old[tail:] if tail is not None else []))


def redaction_edits(text: str, rules: Iterable[tuple[regex.Pattern, str]]) -> list[tuple[int, int, str]]:
    """Edits that do not overlap, last first, so that places stay good while they are made."""
    found = sorted((m.start(), m.end(), new) for pattern, new in rules for m in pattern.finditer(text))
    out, free = [], 0
    for a, b, new in found:
        if a >= free:
            out.append((a, b, new))
            free = b
    return out[::-1]


def edited_token_counts(docs: DataFrame, ranks: str = RANKS, redactions: tuple[tuple[str, str], ...] = REDACTIONS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded) for each row: tokens of the
    text, its pre-tokens, edits that redact it, tokens after them, and pre-tokens encoded for the edits.

    A null or empty text has no tokens. Repeated rows are counted each; an empty table gives no rows;
    other columns are not read. Of edits that overlap the one that begins first is made, of two that begin
    together the shorter. Texts without blanks and of any length take time in proportion to their length.
    ``ranks`` is read where the tasks run.
    """
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    names = ["n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rules = Encoder.at(ranks), [(regex.compile(p), new) for p, new in redactions]
        for part in pieces(batches, "text"):
            rows = []
            for t in part["text"].to_pylist():
                tree = TokenTree(t or "", encoder)
                before, n, edits = tree.total, tree.encoded, redaction_edits(t or "", rules)
                for a, b, new in edits:
                    tree.edit(a, b, new)
                rows.append((before, n, len(edits), tree.total, tree.encoded - n))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=["doc_id", *names])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))
