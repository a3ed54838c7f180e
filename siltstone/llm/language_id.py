"""Language ID by unigram pieces with all segmentations summed.

The pieces are those of a public tokenizer's vocabulary, which is never trained; what is learned is
each language's probability of each piece, by expectation-maximisation over all segmentations of the
words of all labelled texts, on the executors. A text's likelihood in a language is the product over its
words of the forward algorithm's sum over all ways to cut the word into pieces, however long it is. Words
repeat, so the sum is made once for each distinct word of a run of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm._io import discard, free_name, map_texts, materialize, nth_values
from siltstone.llm._text import U, byte_values, give_back, members, mix, pieces, sieve_of, span_hashes

LONGEST, CUT, SCALE = 16, 64, 2.5
EXACT = byte_values(fold=False)
LETTER = r"\p{L}"
_known: dict[str, Any] = {}
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of up to LONGEST bytes, a leading blank for a word's start; all single bytes are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if 0 < len(piece) <= LONGEST and b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


class Pieces:
    """Finds vocabulary pieces in words, by the hashes of all their prefixes."""

    def __init__(self, vocabulary: list[bytes]):
        at = {piece: i for i, piece in enumerate(vocabulary)}
        heads = sorted({piece[:n] for piece in vocabulary for n in range(1, len(piece) + 1)})
        data = np.frombuffer(b"".join(heads), np.uint8)
        self.length = np.array([len(piece) for piece in vocabulary])
        ends = np.cumsum([len(h) for h in heads])
        keys = mix(span_hashes(data, np.append(0, ends[:-1]), ends, EXACT))
        order = np.argsort(keys)
        self.n, self.keys, self.sieve = len(vocabulary), keys[order], sieve_of(keys)
        self.ids = np.array([at.get(h, -1) for h in heads])[order]

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
        """Nodes are the byte bounds of all words, one after another. First and last node of each word, and
        groups of arcs with equal place of their end in the word, ascending, and equal length: each node
        ends one arc of a group at most. A group: end, length, nodes where arcs begin, pieces. Words of up to 255 bytes."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        room = (size - 1)[word] - (np.arange(len(data)) - first[word])  # bytes after this one in its word
        place = (np.arange(len(data)) - first[word]).astype(np.uint8)
        top, groups = first + np.arange(len(words)), []
        at = np.arange(len(data))
        for n in range(1, LONGEST + 1):
            at = at[room[at] >= n - 1]
            if not len(at):
                break
            hit, k = members(self.keys, mix(span_hashes(data, at, at + n, EXACT)), self.sieve)
            at, piece = at[hit], self.ids[k]
            whole = piece >= 0
            begin, piece, depth = at[whole], piece[whole], place[at[whole]]
            order = np.argsort(depth, kind="stable")
            begin, piece = (begin + word[begin])[order], piece[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
            groups += [(d + n, n, begin[x:y], piece[x:y]) for d, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
        groups.sort(key=lambda g: g[:2])
        return top, top + size, groups

    def scaled(self, p: np.ndarray) -> np.ndarray:
        """Probabilities times e^SCALE a byte, so that products of a word's pieces stay near 1."""
        return p * np.exp(SCALE * self.length)[:, None]

    def forward(self, words: list[bytes], p: np.ndarray, lattice=None) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums at all nodes, scaled, and each word's log probability; p: piece x language."""
        top, bottom, groups = lattice or self.lattice(words)
        p = self.scaled(p)
        alpha = np.zeros((int(bottom[-1]) + 1 if len(bottom) else 0, p.shape[1]))
        alpha[top] = 1
        for _, n, begin, piece in groups:
            alpha[begin + n] += alpha[begin] * p[piece]
        return alpha, np.log(np.maximum(alpha[bottom], 1e-300)) - SCALE * (bottom - top)[:, None]

    def log_sums(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Each word's log probability, all segmentations summed. Words are taken CUT bytes at a time, each next run of
        them with the forward sums at the bounds before it that a piece can begin at, brought back to about 1."""
        out = np.zeros((len(words), p.shape[1]))
        scaled, overlap, live, carried = self.scaled(p), 0, np.arange(len(words)), None
        done = 0
        while len(live):
            top, bottom, groups = self.lattice([words[i][done - overlap : done + CUT] for i in live])
            alpha = np.zeros((int(bottom[-1]) + 1, p.shape[1]))
            if carried is None:
                alpha[top] = 1
            else:
                for j in range(overlap + 1):
                    alpha[top + j] = carried[:, j]
            for end, n, begin, piece in groups:
                if end > overlap:
                    alpha[begin + n] += alpha[begin] * scaled[piece]
            done += CUT
            size = np.array([len(words[i]) for i in live])
            ends = size <= done
            out[live[ends]] += np.log(np.maximum(alpha[bottom[ends]], 1e-300)) - SCALE * size[ends, None]
            overlap = LONGEST - 1
            carried = np.stack([alpha[bottom[~ends] - overlap + j] for j in range(overlap + 1)], axis=1)
            most = np.maximum(carried.max(axis=1), 1e-300)
            carried, live = carried / most[:, None], live[~ends]
            out[live] += np.log(most)
        return out

    def expected(self, words: list[bytes], times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations; times: word x language."""
        lattice = top, bottom, groups = self.lattice(words)
        alpha, _ = self.forward(words, p, lattice)
        p = self.scaled(p)
        beta = np.zeros_like(alpha)
        beta[bottom] = times / np.maximum(alpha[bottom], 1e-300)
        out = np.zeros((self.n, p.shape[1]))
        for _, n, begin, piece in reversed(groups):
            flow = beta[begin + n] * p[piece]
            beta[begin] += flow
            flow *= alpha[begin]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, flow[:, k], self.n) if len(piece) > 1000 else 0
            if len(piece) <= 1000:
                np.add.at(out, piece, flow)
        return out


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in lower case with a blank before each, each word's index there, and each text's first word."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")).cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    words, index, first = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
    return [b" " + w for w in words], index, first - first[0]


class LanguageModel:
    def __init__(self, vocabulary: list[bytes], languages: list[str]):
        self.pieces, self.languages, self.name = Pieces(vocabulary), languages, uuid.uuid4().hex
        self.p = np.full((self.pieces.n, len(languages)), 1.0 / self.pieces.n)
        self.floor = -np.inf

    def fit(self, words: list[bytes], times: np.ndarray, rounds: int, prior: float, block: int = 20_000) -> None:
        """Rounds of expectation-maximisation; ``block`` words at a time bound the memory of their segmentations.
        Expected counts, unlike scores, are made of words over CUT bytes run by run."""
        runs = [(w[k : k + CUT], i) for i, w in enumerate(words) for k in range(0, len(w), CUT)]
        words, times = [w for w, _ in runs], times[[i for _, i in runs]]
        for _ in range(rounds):
            counts = sum(self.pieces.expected(words[i : i + block], times[i : i + block], self.p) for i in range(0, len(words), block)) + prior
            self.p = counts / counts.sum(axis=0)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Each word's log probability by language; those of short words met before in this process are remembered."""
        if _known.get("model") != self.name or len(_known["at"]) + len(words) > _known["room"]:
            room = max(len(words), min(400_000, 16_000_000 // len(self.languages)))
            _known.update(model=self.name, room=room, at={}, logs=np.zeros((room, len(self.languages))))
        at, logs = _known["at"], _known["logs"]
        new = [w for w in words if len(w) <= CUT and w not in at]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            logs[len(at) : len(at) + len(some)] = self.pieces.log_sums(some, self.p)
            at.update(zip(some, range(len(at), len(at) + len(some)), strict=True))
        out = logs[[at.get(w, 0) for w in words]]
        if long := [i for i, w in enumerate(words) if len(w) > CUT]:
            out[long] = self.pieces.log_sums([words[i] for i in long], self.p)
        return out

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, text x language, and the bytes of each text's words."""
        words, index, first = split_words(texts)
        n = len(first) - 1
        logs = self.word_scores(words)
        logs[[i for i, w in enumerate(words) if w == b" "]] = 0
        text, size = np.repeat(np.arange(n), np.diff(first)), np.array([len(w) for w in words], np.int64)
        return np.stack([np.bincount(text, logs[index, k], n) for k in range(len(self.languages))], axis=1), np.bincount(text, size[index], n)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest language's index (the first of equal ones), its posterior under equal priors, and its log
        likelihood a byte."""
        sums, size = self.sums(texts)
        post = np.exp(sums - sums.max(axis=1, keepdims=True))
        return sums.argmax(axis=1), (post / post.sum(axis=1, keepdims=True)).max(axis=1), sums.max(axis=1) / np.maximum(size, 1)


def held_out_column(doc: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string")), F.lit(folds)) == fold, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, ns: (lang, n) pairs) over all of ``rows`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            for lang in set(part["lang"].to_pylist()):
                words, index, _ = split_words(part["text"].filter(pc.equal(part["lang"], lang)))
                times = np.bincount(index, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(times)], names=["lang", "word", "n"])

    table = map_texts(rows.select("text", "lang"), count, "lang string, word binary, n long").where("length(word) > 1")
    return table.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("ns"))


def expected_counts(words: DataFrame, model: LanguageModel, block: int = 20_000) -> np.ndarray:
    """Expected counts of pieces by language over all of ``words`` (word, ns), summed on the executors; ``block`` words at
    a time bound the memory of their segmentations. Words over CUT bytes are taken run by run."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {lang: k for k, lang in enumerate(m.languages)}
        total = np.zeros((m.pieces.n, len(m.languages)))
        for b in batches:
            runs, times = [], []
            for w, ns in zip(b["word"].to_pylist(), b["ns"].to_pylist(), strict=True):
                row = np.zeros(len(m.languages))
                for x in ns:
                    row[at[x["lang"]]] = x["n"]
                for k in range(0, len(w), CUT):
                    runs.append(w[k : k + CUT])
                    times.append(row)
            for i in range(0, len(runs), block):
                total += m.pieces.expected(runs[i : i + block], np.array(times[i : i + block]), m.p)
        give_back()
        some = np.flatnonzero(total.any(axis=1))
        for k in range(len(m.languages)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), k, np.int64)), pa.array(total[some, k])], names=["piece", "k", "x"])

    out = np.zeros(model.p.shape)
    t = map_texts(words, run, "piece long, k long, x double").groupBy("piece", "k").agg(F.sum("x").alias("x")).toArrow()
    out[t["piece"].to_numpy(), t["k"].to_numpy()] = t["x"].to_numpy()
    return out


def fit_language_model(labelled: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 3, prior: float = 0.02, margin: float = 0.75, floor: bool = True) -> LanguageModel:
    """Fit on all distinct (text, lang) rows with text and lang, told apart by a hash of the text. The words are a table;
    each round sums their expected counts on the executors, and only pieces by language come to the driver. ``margin``:
    how far under the least likely hundredth of the labelled texts with a letter, in log likelihood a byte, a text is in no
    learned language; without ``floor`` that, which takes a pass over the texts, is not found."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", F.lit(17)).alias("place"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    model = LanguageModel(read_vocabulary(vocabulary), languages)
    words = materialize(word_counts(rows.dropDuplicates(["lang", "place"])), "words")
    if not languages or words.isEmpty():
        discard(words)
        return model
    for _ in range(rounds):
        counts = expected_counts(words, model) + prior
        model.p = counts / counts.sum(axis=0)
    discard(words)
    if floor:
        shared = labelled.sparkSession.sparkContext.broadcast(model)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "text"):
                yield pa.RecordBatch.from_arrays([part["lang"], part["place"], pa.array(shared.value.predict(part["text"])[2])], names=["lang", "place", "rate"])

        rated = map_texts(rows.where(F.col("text").rlike(LETTER)), rate, "lang string, place long, rate double")
        rates = materialize(rated.groupBy("lang", "place").agg(F.max("rate").alias("rate")).select("rate"), "rates")
        size = rates.count()
        if size:
            place = (size - 1) * 0.01
            low, high = nth_values(rates, [int(place), min(size - 1, int(place) + 1)])
            model.floor = low + (high - low) * (place - int(place)) - margin
        discard(rates)
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, and so is all where no language was
    learned. Of equally likely languages the first by name counts. Repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    text = free_name("text", list(carry))
    letter = free_name("letter", [text, *carry])
    src = docs.select(*carry, F.col("text").alias(text), F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias(letter))
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carry), "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, "und"], pa.string())
        for part in pieces(batches, text):
            known = part[letter].to_numpy(zero_copy_only=False)
            if model.languages:
                best, score, _ = model.predict(part[text])
            else:
                best, score, known = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            best, score = np.where(known, best, len(model.languages)), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in carry), names.take(pa.array(best)), pa.array(score)], names=[*carry, "lang_pred", "score"])

    return map_texts(src, run, schema)


def drop_unknown_languages(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """The rows whose text has a letter and a language, all columns: a posterior of ``least_score`` or more, and a log
    likelihood a byte over the model's floor, so that text in no learned language goes.

    A null or empty text, or one without a letter, goes. Where no language was learned every lettered row stays.
    Repeated rows are judged alike, of equally likely languages the first counts, an empty table stays empty, and
    columns of any name are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.where(F.col("text").rlike(LETTER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            _, score, rate = shared.value.predict(part["text"])
            yield part.filter(pa.array((score >= least_score) & (rate >= shared.value.floor)))

    return map_texts(lettered, run, docs.schema) if model.languages else lettered
