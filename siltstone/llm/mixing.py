"""Mix sources to target weights by blocks.

Each source's words, its documents one after another, make a stream that is cut into blocks of a fixed
length. The mix is a sequence of slots over output shards: each shard draws how many of its slots come
from each source, by a multinomial over what the sources still owe, so that the whole mix meets every
target. A source's i-th slot takes the block that a pseudorandom permutation of its block indexes gives
for i, a new permutation after each pass. Slots and blocks meet in a join by index; only a source's last
slot, and the stream's last block, are shorter.

Shards are drawn in two steps: the driver draws groups of shards, about the square root of their number, and
the executors draw each group's shards and list their slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siltstone.llm._io import map_texts, materialize
from siltstone.llm._text import Words, pieces

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRules:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block: int = 128
    seed: int = 20240
    shard_slots: int = 4096
    broadcast_sources: int = 100_000


def targets(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of the total by weight; what is over ``most`` times a source's size goes to the others, by weight."""
    out, open_, left = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s], Fraction(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


@dataclass
class SourcePlan:
    """One source's passes over its blocks: ``whole`` full passes and ``part`` slots more, the last of ``tail`` words."""

    size: int
    words: int
    block: int
    seed: tuple[int, ...]

    def __post_init__(self):
        self.blocks = -(-self.size // self.block)
        self.whole, rest = divmod(self.words, self.size) if self.size else (0, 0)
        self.steps = [self.step(e) for e in range(self.whole + 1)]
        self.part, self.tail = 0, 0
        if rest:
            a, c = self.steps[self.whole]
            short = self.size - (self.blocks - 1) * self.block
            at = (self.blocks - 1 - c) * pow(a, -1, self.blocks) % self.blocks if self.blocks > 1 else 0
            if rest <= at * self.block:
                self.part = -(-rest // self.block)
                self.tail = rest - (self.part - 1) * self.block
            elif rest <= at * self.block + short:
                self.part, self.tail = at + 1, rest - at * self.block
            else:
                more = rest - short
                self.part = -(-more // self.block) + 1
                self.tail = more - (self.part - 2) * self.block
        self.slots = self.whole * self.blocks + self.part

    def step(self, epoch: int) -> tuple[int, int]:
        """Of the permutation i -> (a i + c) mod blocks; a is small enough for 64-bit products."""
        n = max(1, self.blocks)
        rng = np.random.default_rng([*self.seed, epoch])
        top = max(2, min(n, (1 << 62) // n))
        a = int(rng.integers(1, top))
        while math.gcd(a, n) != 1:
            a = a % (top - 1) + 1
        return a, int(rng.integers(0, n))


def draws(owed: np.ndarray, lengths: Iterator[int], seed: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each length so many slots by source: a multinomial over the slots still owed, no source over what it owes."""
    left = np.array(owed, np.int64)
    for shard, n in enumerate(lengths):
        draw = np.minimum(np.random.default_rng([*seed, shard]).multinomial(n, left / left.sum()), left)
        while short := n - int(draw.sum()):
            draw += np.minimum(np.random.default_rng([*seed, shard, short]).multinomial(short, (left - draw) / (left - draw).sum()), left - draw)
        left -= draw
        yield draw


def lengths(total: int, each: int) -> Iterator[int]:
    """``total`` in parts of ``each``, the last as much as is left."""
    for start in range(0, total, each):
        yield min(each, total - start)


def draw_groups(slots: list[int], rules: MixRules) -> list[tuple[int, int, list[int], list[int]]]:
    """(group, its first shard, each source's first slot there, each source's number of slots)."""
    shards = -(-sum(slots) // rules.shard_slots)
    each = max(1, math.isqrt(shards))
    out, start = [], np.array(slots, np.int64) * 0
    for k, draw in enumerate(draws(np.array(slots), lengths(sum(slots), each * rules.shard_slots), (rules.seed, 1))):
        out.append((k, k * each, start.tolist(), draw.tolist()))
        start = start + draw
    return out


def _pick(values: Column, index: Column) -> Column:
    return F.element_at(values, (index + 1).cast("int"))


class Mix:
    """The plan of a mix and its tables.

    ``documents``: doc_id, source, sid, size, source_size, target, at (place in the source's stream).
    ``slots``: shard, sid, slot, block, take (words of the block). ``spans``: sid, at, block, lo, hi.
    """

    def __init__(self, docs: DataFrame, rules: MixRules = MixRules(), with_text: bool = False):
        self.rules, spark = rules, docs.sparkSession
        self.rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("rid"))
        if with_text:  # rows are read again by rid, which a second run of a plan may deal anew
            self.rows = materialize(self.rows, "rows")
        sized = self.rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"), "rid")
        sized = materialize(sized, "sizes")
        groups = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
        self.names = sorted((s for s in groups if s is not None), key=str) + [None] * (None in groups)
        sizes = [groups[s] for s in self.names]
        wanted = targets(sizes, [rules.weights[i % len(rules.weights)] for i in range(len(self.names))], rules.most)
        self.plans = [SourcePlan(s, min(rules.most * s, round(w)), rules.block, (rules.seed, i)) for i, (s, w) in enumerate(zip(sizes, wanted, strict=True))]
        rows = [(s, i, p.size, float(w), max(1, p.blocks), p.slots, p.tail, [a for a, _ in p.steps], [c for _, c in p.steps]) for i, (s, w, p) in enumerate(zip(self.names, wanted, self.plans, strict=True))]
        plan = spark.createDataFrame(rows, f"source {docs.schema['source'].dataType.simpleString()}, sid int, source_size long, target double, blocks long, slots long, tail long, a array<long>, c array<long>")
        self.plan = F.broadcast(plan) if len(rows) <= rules.broadcast_sources else plan
        self.documents = self._placed(sized)
        self.slots = self._slots(spark)
        block = F.lit(rules.block)
        spans = self.documents.where("size > 0").select("sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
        self.spans = spans.select("sid", "at", "block", F.greatest(F.col("at") - F.col("block") * block, F.lit(0)).alias("lo"), F.least(F.col("at") + F.col("size") - F.col("block") * block, block).alias("hi"))

    def _placed(self, sized: DataFrame) -> DataFrame:
        """``sized`` with each row's place in its source's stream. Rows are dealt by ranges of source and hash, repeated
        rows too, so that no task holds a source or an id; running sums in a range, and offsets of ranges."""
        named = sized.join(self.plan.select(F.col("source").alias("of"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = named.repartitionByRange("sid", "h", "rid").sortWithinPartitions("sid", "h", "rid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, last, filled = TaskContext.get().partitionId(), None, 0
            for b in batches:
                if not b.num_rows:
                    continue
                sid, size = b["sid"].to_numpy(), b["size"].to_numpy()
                ends = np.cumsum(size) + (filled if sid[0] == last else 0)
                heads = np.flatnonzero(np.diff(sid)) + 1
                before = np.zeros(len(sid), np.int64)
                before[heads] = ends[heads - 1]
                at = ends - size - np.maximum.accumulate(before)
                last, filled = sid[-1], int(at[-1] + size[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.full(len(sid), part, np.int32))], names=[*b.schema.names, "at", "part"])

        schema = named.withColumns({"at": F.lit(0).cast("long"), "part": F.lit(0)}).schema
        local = materialize(dealt.mapInArrow(run, schema), "local")
        filled = local.groupBy("sid", "part").agg(F.sum("size").alias("filled"))
        offsets = filled.select("sid", "part", (F.sum("filled").over(W.partitionBy("sid").orderBy("part")) - F.col("filled")).alias("offset"))
        offsets = materialize(offsets, "offsets")
        offsets = F.broadcast(offsets) if offsets.count() <= 10 * self.rules.broadcast_sources else offsets
        return materialize(local.join(offsets, ["sid", "part"]).withColumn("at", F.col("at") + F.col("offset")).drop("part", "offset", "h"), "placed")

    def _slots(self, spark: SparkSession) -> DataFrame:
        rules, groups = self.rules, draw_groups([p.slots for p in self.plans], self.rules)
        drawn = spark.createDataFrame(groups or [], "grp long, shard long, start array<long>, number array<long>").repartition(max(1, len(groups)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for r in b.to_pylist()):
                start, owed = (np.array(r[k], np.int64) for k in ("start", "number"))
                for k, draw in enumerate(draws(owed, lengths(int(owed.sum()), rules.shard_slots), (rules.seed, 2, r["grp"]))):
                    sid = np.repeat(np.arange(len(draw)), draw)
                    slot = np.arange(len(sid)) - np.repeat(np.cumsum(draw) - draw, draw) + start[sid]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), r["shard"] + k)), pa.array(sid.astype(np.int32)), pa.array(slot)], names=["shard", "sid", "slot"])
                    start = start + draw

        each = drawn.mapInArrow(run, "shard long, sid int, slot long").join(self.plan.select("sid", "blocks", "slots", "tail", "a", "c"), "sid")
        turn, place = F.floor(F.col("slot") / F.col("blocks")), F.col("slot") % F.col("blocks")
        last = (F.col("slot") == F.col("slots") - 1) & (F.col("tail") > 0)
        return each.select("shard", "sid", "slot", ((_pick(F.col("a"), turn) * place + _pick(F.col("c"), turn)) % F.col("blocks")).alias("block"), F.when(last, F.col("tail")).otherwise(F.lit(rules.block)).alias("take"))

    def blocks(self) -> DataFrame:
        """The mix itself: (shard, slot, source, doc_ids, n_words, text) for each slot. The words of a block come from
        its documents in stream order, white space inside a document's words as it was."""
        block = self.rules.block
        texts = self.rows.select("rid", "text").join(self.documents.where("size > 0").select("rid", "doc_id", "sid", "at"), "rid").select("doc_id", "sid", "at", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "text"):
                w = Words(part["text"])
                at = part["at"].to_numpy()
                row = w.text_of()
                place = at[row] + np.arange(len(row)) - w.first[:-1][row]
                heads = np.flatnonzero((place % block == 0) | np.append(True, row[1:] != row[:-1])) if len(row) else row
                tails = np.append(heads[1:], len(row)) - 1 if len(row) else row
                of, data = pa.array(row[heads]), w.data.tobytes()
                said = [data[a:b].decode() for a, b in zip(w.start[heads].tolist(), w.end[tails].tolist(), strict=True)]
                lo = place[heads] % block
                yield pa.RecordBatch.from_arrays([part["sid"].take(of), pa.array(place[heads] // block), pa.array(lo), pa.array(lo + tails - heads + 1), part["doc_id"].take(of), pa.array(said, pa.string())], names=["sid", "block", "lo", "hi", "doc_id", "text"])

        held = map_texts(texts, run, f"sid int, block long, lo long, hi long, doc_id {self.documents.schema['doc_id'].dataType.simpleString()}, text string")
        whole = held.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "doc_id", "text"))).alias("p"))
        placed = whole.join(self.slots, ["sid", "block"]).join(self.plan.select("sid", "source"), "sid")
        cut = lambda x: F.array_join(F.slice(F.regexp_extract_all(x["text"], F.lit(WORD), F.lit(0)), F.lit(1), (F.col("take") - x["lo"]).cast("int")), " ")
        said = F.transform("p", lambda x: F.when(x["hi"] > F.col("take"), cut(x)).otherwise(x["text"]))
        placed = placed.withColumn("p", F.filter("p", lambda x: x["lo"] < F.col("take"))).withColumn("text", F.array_join(said, "\n"))
        return placed.select("shard", "slot", "source", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.least(F.element_at("p", -1)["hi"], "take").alias("n_words"), "text")

    def taken(self) -> DataFrame:
        """documents with ``taken``: the words of each that the mix holds, repeats counted."""
        uses = self.slots.groupBy("sid", "block", "take").agg(F.count("*").alias("times"))
        held = self.spans.join(uses, ["sid", "block"]).where("lo < take").groupBy("sid", "at").agg(F.sum(F.col("times") * (F.least("hi", "take") - F.col("lo"))).cast("long").alias("t"))
        nothing = F.lit(0).cast("long")
        out = self.documents.withColumn("key", F.when(F.col("size") > 0, F.col("at"))).join(held.withColumnRenamed("at", "key"), ["sid", "key"], "left")
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("t", nothing).alias("taken"))


def mix_sources(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source).

    A null, empty or wordless text has size 0 and gives nothing; a null source is a source of its own,
    the last. Repeated rows and null ids each hold their own place in the stream; places go by a hash of id
    and text, and between equal rows by their order in the input. Texts of any length are used whole. An
    empty table gives no rows; other columns are not read. The number of sources must suit the driver, which
    plans them one by one; documents, slots and shards do not come to it.
    """
    return Mix(docs, rules).taken()


def mix_blocks(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The packed blocks of the mix of ``docs``: (shard, slot, source, doc_ids, n_words, text); the same rules as mix_sources."""
    return Mix(docs, rules, with_text=True).blocks()
