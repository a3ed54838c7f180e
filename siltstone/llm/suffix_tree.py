"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words that occur at least ``least_count`` times in the training
tokens and whose next words diverge from those of the shorter context. A state keeps the next words
that diverge, discounted; the mass left over goes to the shorter state, and from the empty context to
smoothed counts over all training tokens. A token is scored from the longest state that is a suffix
of what precedes it.

The tree grows with the corpus, so it stays in a table. In logarithms a text's score is a sum over the
runs of words in it: a word brings its base, a kept run what its state adds to the shorter one's
chance of its last word, and a state what it takes from all words that follow. All are values of 64-bit
hashes of runs and reach the texts by one join; sieves of bounded size keep back most runs without a
value, and the ``hot`` words and ``hot`` longer runs with most occurrences are broadcast to save rows.

Runs are counted by range of hash. A task sorts its runs and packs those of a range into one row of binary
columns; whoever gets a range sorts it, so Spark moves a few large rows, not one for each run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm._io import discard, materialize
from siltstone.llm._text import U, Words, members, mix, pieces, sieve_of

END = np.array([0x5DEECE66D1CE4E5B], U)
#: Bits of the largest sieve; with more keys than that it only lets more rows pass.
SIEVE_BITS = 27
#: Bytes of text for each range of hashes; a range's runs are in memory at once.
PART_BYTES = 2 << 20
NAMES = ["rid", "doc_id", "held_out", "h", "n", "known", "base", "more"]


@dataclass(frozen=True)
class TreeRules:
    depth: int = 2
    least_count: int = 4
    lift: float = 1.5
    gain: float = 6.0
    state_gain: float = 10.0
    discount: float = 0.75
    hot: int = 1 << 18


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run of words from those of the run without its last and without its first word."""
    return mix(context * U(0x9E6C63D0876A9A47) + suffix)


class Sieve:
    """Two bits for each hash of a table, collected as 64-bit words; what lacks one is not in the table."""

    def __init__(self, hashes: DataFrame):
        bits = min(SIEVE_BITS, max(10, int(hashes.count()).bit_length() + 4))
        x = F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("x")
        x = hashes.select(x).select(F.col("x").bitwiseAND((1 << bits) - 1).alias("x"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))
        rows = x.groupBy(F.shiftrightunsigned("x", 6).alias("i")).agg(F.bit_or(one).alias("b")).toArrow()
        self.words = np.zeros(1 << (bits - 6), U)
        self.words[rows["i"].to_numpy()] = rows["b"].to_numpy().view(U)
        self.mask = U((1 << bits) - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        return (self.words[((x & self.mask) >> U(6)).astype(np.int64)] >> (x & U(63)) & U(1)).astype(bool)

    def passes(self, h: np.ndarray) -> np.ndarray:
        out = self.has(h)
        at = np.flatnonzero(out)
        out[at] = self.has(h[at] >> U(32))
        return out


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' hashes, each text's end among them, and the number of tokens before each in its text."""
    n = len(w.counts)
    h = np.empty(len(w.start) + n, U)
    h[np.arange(len(w.start)) + w.text_of()] = w.hashes()
    h[w.first[1:] + np.arange(n)] = END[0]
    lengths = w.counts + 1
    return h, np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def longer(g: np.ndarray) -> np.ndarray:
    """For each token the run that ends there, one word longer than in ``g``; bounds of texts ignored."""
    out = np.zeros(len(g), U)
    out[1:] = joined(g[:-1], g[1:])
    return out


def held_out_column(doc: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string")), F.lit(folds)) == fold, F.lit(False))


def packed(h: np.ndarray, parts: int, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """The ranges, ``parts`` in all, that ascending hashes fall in, and for each one the bytes of its slice of every column."""
    ids = (h >> U(32)) * U(parts) >> U(32)
    bounds = np.append(starts(ids), len(h))
    bytes_of = lambda x: pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return _i64(ids[bounds[:-1]]), [bytes_of(x) for x in columns]


def unpacked(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many of them each row has."""
    whole = pc.cast(pa.concat_arrays(column.chunks), pa.large_binary())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(dtype), np.diff(bounds) // np.dtype(dtype).itemsize


def starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _train(docs: DataFrame, rules: TreeRules, parts: int) -> tuple[DataFrame, int, int]:
    """The model (h, n, c, more), the training tokens and distinct words. ``c`` is null but for words."""
    sc = docs.sparkSession.sparkContext
    train = docs.where("not held_out").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 8 << 20):
            h, c = np.unique(np.concatenate([Words(part["text"]).hashes(), np.repeat(END, part.num_rows)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_i64(h), pa.array(c.astype(np.int64))], names=["h", "c"])

    words = materialize(train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    kinds, tokens = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    model = words.select("h", F.col("c").alias("n"), "c", F.lit(0.0).alias("more"))
    runs = words.where(F.col("c") >= rules.least_count).select("h", "c", ((F.col("c") + 0.5) / F.lit(tokens + 0.5 * (kinds + 1))).alias("p"))
    used = [words]
    for depth in range(1, rules.depth + 1):
        # a run is frequent only if it is without its last and without its first word
        shared = sc.broadcast(Sieve(runs.select("h")))

        def follow(batches: Iterator[pa.RecordBatch], shared=shared, depth=depth) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "text", 8 << 20):
                g, place = tokens_of(Words(part["text"]))
                for _ in range(1, depth):
                    g = longer(g)
                ok = shared.value.passes(g)
                at = np.flatnonzero(ok[1:] & ok[:-1] & (place[1:] >= depth)) + 1
                h = joined(g[at - 1], g[at])
                order = np.argsort(h)
                h = h[order]
                first = starts(h)
                at, c = at[order[first]], np.diff(np.append(first, len(h)))
                ids, columns = packed(h[first], parts, g[at - 1], g[at], c.astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["part", "ctx", "sfx", "c"])

        def frequent(rows: pa.Table) -> pa.Table:
            ctx, sfx, c = (unpacked(rows[k], t)[0] for k, t in (("ctx", U), ("sfx", U), ("c", np.int32)))
            h = joined(ctx, sfx)
            order = np.argsort(h)
            h = h[order]
            first = starts(h)
            c = np.add.reduceat(c[order].astype(np.int64), first)
            ok = c >= rules.least_count
            at = order[first[ok]]
            return pa.table([_i64(h[first[ok]]), _i64(ctx[at]), _i64(sfx[at]), pa.array(c[ok])], names=["h", "ctx", "sfx", "c"])

        pairs = train.mapInArrow(follow, "part long, ctx binary, sfx binary, c binary").groupBy("part")
        pairs = materialize(pairs.applyInArrow(frequent, "h long, ctx long, sfx long, c long"), "runs")
        tested = pairs.join(runs.select(F.col("h").alias("ctx"), F.col("c").alias("total")), "ctx").join(runs.select(F.col("h").alias("sfx"), F.col("p").alias("shorter")), "sfx")
        e = F.col("total") * F.col("shorter")
        gain = F.col("c") * F.log(F.col("c") / e)
        kept = (F.col("c") >= F.lit(rules.lift) * e) & (gain >= rules.gain)
        tested = materialize(tested.withColumn("gain", gain).withColumn("share", F.when(kept, (F.col("c") - rules.discount) / F.col("total"))), "tested")
        of = tested.where("share is not null").groupBy("ctx").agg(F.sum("gain").alias("gain"), F.any_value("total").alias("n"), F.sum("share").alias("s"))
        states = materialize(of.where(F.col("gain") >= rules.state_gain).select("ctx", "n", (1.0 - F.col("s")).alias("rest")), "states")
        left = F.col("rest") * F.col("shorter")
        chance = F.when(F.col("rest").isNull(), F.col("shorter")).otherwise(F.coalesce("share", F.lit(0.0)) + left)
        more = F.when(F.col("rest").isNotNull() & F.col("share").isNotNull(), F.log10(chance / left))
        runs = materialize(tested.join(states.select("ctx", "rest"), "ctx", "left").select("h", "c", chance.alias("p"), more.alias("more")), "runs")
        none = F.lit(None).cast("long").alias("c")
        model = model.union(runs.where("more is not null").select("h", F.col("c").alias("n"), none, "more")).union(states.select(F.col("ctx").alias("h"), "n", none, F.log10("rest").alias("more")))
        discard(pairs, tested)
        used += [states, runs]
    model = materialize(model.groupBy("h").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sum("more").alias("more")), "model")
    discard(*used)
    return model, tokens, kinds


def _most(model: DataFrame, limit: int) -> pa.Table:
    """Those rows of the model with most occurrences, ``limit`` at most."""
    level = F.floor(F.log2("n") * 4)
    over, least = 0, None
    for r in sorted(model.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["l"]):
        over += r["k"]
        if over > limit:
            break
        least = r["l"]
    return model.where(level >= (least if least is not None else 1 << 30)).select("h", "c", "more").toArrow()


class Hot:
    """The values of the hot words and runs, and the sieve of all longer runs."""

    def __init__(self, words: pa.Table, runs: pa.Table, tokens: int, kinds: int, sieve: Sieve):
        h = np.concatenate([t["h"].to_numpy().view(U) for t in (words, runs)])
        order = np.argsort(h)
        base = np.log10((np.append(words["c"].to_numpy(), np.zeros(len(runs))) + 0.5) / (tokens + 0.5 * (kinds + 1)))
        self.keys, self.base = h[order], base[order]
        self.more = np.concatenate([t["more"].to_numpy() for t in (words, runs)])[order]
        self.near, self.sieve = sieve_of(self.keys), sieve


def suffix_tree_scores(documents: DataFrame, rules: TreeRules = TreeRules(), folds: int = 5, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``documents``.

    A null or empty text is its end token alone. A row whose doc_id is null is not held out. Repeated
    rows are counted and scored each. Counts that tie at the bound of the hot values are all in or all out, which
    changes no score. Texts of any length are scored whole. Without training rows every token has base probability 1. An
    empty table gives no rows; columns but doc_id and text are not read.
    """
    docs = documents.select("doc_id", "text", held_out_column("doc_id", folds, fold).alias("held_out"))
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    model, tokens, kinds = _train(docs, rules, parts)
    longest = model.where("c is null")
    shared = docs.sparkSession.sparkContext.broadcast(Hot(_most(model.where("c is not null"), rules.hot), _most(longest, rules.hot), tokens, kinds, Sieve(longest.select("h"))))
    kind, depth = docs.schema["doc_id"].dataType.simpleString(), rules.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for part in pieces(batches, "text"):
            w = Words(part["text"])
            g, place = tokens_of(w)
            n, lengths = part.num_rows, w.counts + 1
            text = np.repeat(np.arange(n), lengths)
            base, more, rest = np.zeros(len(g)), np.zeros(len(g)), []
            for d in range(depth + 1):
                hit, at = members(hot.keys, g, hot.near)
                inside = place[hit] >= d
                hit, at = hit[inside], at[inside]
                more[hit] += hot.more[at]
                others = (place >= d) if d == 0 else (place >= d) & hot.sieve.passes(g)
                others[hit] = False
                if d == 0:
                    base[hit] = hot.base[at]
                    known = np.bincount(text[hit], minlength=n)
                others = np.flatnonzero(others)
                rest.append((text[others], g[others], np.full(len(others), d == 0)))
                g = longer(g)
            sums = lambda x: pa.array(np.bincount(text, x, n))
            yield pa.RecordBatch.from_arrays([part["rid"], part["doc_id"], part["held_out"], pa.nulls(n, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)), sums(base), sums(more)], names=NAMES)
            of, h, word = (np.concatenate(x) for x in zip(*rest, strict=True))
            if len(h):
                # by text, then by most of the hash: what still stands apart is a row more, and sums are the same
                order = np.argsort(of.astype(U) << U(48) | h >> U(16))
                of, h, word = of[order], h[order], word[order]
                first = starts(h, of)
                times = np.diff(np.append(first, len(h)))
                m = len(first)
                yield pa.RecordBatch.from_arrays([part["rid"].take(pa.array(of[first])), pa.nulls(m, part["doc_id"].type), pa.nulls(m, pa.bool_()), _i64(h[first]), pa.array(times.astype(np.int64)), pa.array(word[first].astype(np.int64)), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=NAMES)

    rows = docs.withColumn("rid", F.monotonically_increasing_id())
    scored = materialize(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, h long, n long, known long, base double, more double"), "scored")
    word = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(tokens + 0.5 * (kinds + 1)))
    others = scored.where("h is not null").select("rid", "h", "n", "known").join(model.select("h", "c", F.col("more").alias("adds")), "h", "left")
    others = others.groupBy("rid").agg(F.sum(F.when(F.col("known") == 1, F.col("n") * word).otherwise(0.0)).alias("rare_base"), F.sum(F.when((F.col("known") == 1) & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.coalesce("adds", F.lit(0.0))).alias("rare_more"))
    out = scored.where("h is null").join(others, "rid", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more") + F.coalesce("rare_more", F.lit(0.0))).alias("score"))
