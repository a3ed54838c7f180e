"""Exact Jaccard join of shingle sets, size-aware, with connected components.

Sets of up to ``boundary`` shingles enumerate subsets of the sizes that a link can require; larger
sets list the head of their shingles, rarest first, in inverted lists. The boundary is where
enumerating costs as much as the lists are expected to. Lists are scanned for links in two steps, so
that no group of near copies is expanded into all pairs: first each member against the list's hub,
the member with the fewest rarer shingles; then, exactly, only pairs whose ends the first step has
left in different components. Copies are one set from the start. Before whole sets travel, bitmaps of
four to eight bits a shingle bound each pair's difference from below and rule out what cannot link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.llm._graph import components
from siltstone.llm._io import discard, free_name, map_texts, materialize
from siltstone.llm._text import U, Words, members, mix, pieces, shingle_sets, sieve_of

PERCENT = 85  # similarity; set sizes and overlaps below follow from it
SPLIT, BLOCK = 4096, 1024


def least_size(n: int, percent: int) -> int:
    """The smallest set that can link to one of n."""
    return -(-percent * n // 100)


def needed(a: int, b: int, percent: int) -> int:
    """The smallest overlap of linked sets of a and b: overlap * 100 >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    sizes = range(least_size(n, percent), n * 100 // percent + 1)
    return sorted({o for b in sizes if (o := needed(n, b, percent)) <= min(n, b)} - ({n} if n * 100 // percent == n == least_size(n, percent) else set()))


def enumeration_cost(n: int, percent: int) -> int:
    return sum(comb(n, o) for o in subset_sizes(n, percent))


def pick_boundary(partners: float, percent: int, most: int = 256) -> int:
    """The largest size up to which enumerating stays under the expected cost of the lists."""
    n = 0
    while (cost := enumeration_cost(n + 1, percent)) <= min(most, (n + 2 - least_size(n + 1, percent)) * (1 + partners)):
        n += 1
        if cost == 0 and n > 64:
            break
    return n


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(s))).astype(U).view(np.int64))


def bitmap(s: np.ndarray, most: int = 17) -> bytes:
    """Occupied slots of a table of a power of two bits, at least four times the set's size (up to 2**most)."""
    table = np.zeros(1 << max(6, min(most, len(s).bit_length() + 2)), bool)
    table[(s & U(len(table) - 1)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little").tobytes()


def may_match(bits: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int, chunk: int = 1 << 14) -> np.ndarray:
    """For pairs of places in ``bits`` (bitmaps of sets of ``n`` shingles): false only where they differ in more places
    than a link allows. The wider bitmap of a pair is folded to the narrower's width; what an eighth of that already rules
    out is not compared in full."""
    out = np.zeros(len(p), bool)
    width = np.array([len(x) for x in bits], np.int64)
    common = -(-percent * (n[p] + n[q]) // (100 + percent))
    least = np.minimum(width[p], width[q])
    for w in np.unique(least).tolist():
        same = np.flatnonzero(least == w)
        rows = np.unique(np.concatenate([p[same], q[same]]))
        table = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[r], U).reshape(-1, w // 8)) for r in rows])
        short = np.bitwise_or.reduce(table.reshape(len(rows), -1, max(1, w // 64)), axis=1)
        for i in range(0, len(same), chunk):
            at = same[i : i + chunk]
            for t in (short, table):
                x, y = t[np.searchsorted(rows, p[at])], t[np.searchsorted(rows, q[at])]
                shared = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
                own = [np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x, y)]
                at = at[(own[0] - shared <= n[p[at]] - common[at]) & (own[1] - shared <= n[q[at]] - common[at])]
            out[at] = True
    return out


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U, copy=False).view(np.int64))


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: a document's id, text hash, fingerprint, set size and bitmap; kind 1: a shingle and about how many documents
    of the run hold it. Shingles met once in a run stand for sixteen such and come with one in sixteen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets = shingle_sets(Words(part["text"]), words)
            n = len(sets)
            prints = pa.array([fingerprint(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), part["doc_id"], part["t"], prints, pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], names=["kind", "doc_id", "t", "h", "n", "bits"])
            h, times = np.unique(np.concatenate(sets), return_counts=True)
            salt = U((len(h) * 2654435761 + int(times.sum())) & (2**63 - 1))
            single = (times == 1) & ((mix(h ^ salt) & U(15)) == 0)
            h, times = np.concatenate([h[times > 1], h[single]]), np.concatenate([times[times > 1], np.full(single.sum(), 16)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), pa.nulls(len(h), part["doc_id"].type), pa.nulls(len(h), pa.int64()), i64(h), pa.array(times.astype(np.int64)), pa.nulls(len(h), pa.binary())], names=["kind", "doc_id", "t", "h", "n", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, run, f"kind byte, doc_id {kind}, t long, h long, n long, bits binary")


class Order:
    """Frequent shingles, ascending by hash, with rank by frequency; the others count as rare, by hash."""

    def __init__(self, h: np.ndarray, weight: np.ndarray):
        at = np.argsort(h)
        self.keys, self.weight = h[at], weight[at]
        self.rank = np.empty(len(h), np.int64)
        self.rank[np.lexsort((self.keys, self.weight))] = np.arange(len(h))
        self.sieve = sieve_of(self.keys)


def _frequent(counts: DataFrame, least: int, most: int) -> tuple[Order, float]:
    """Shingles of ``least`` documents or more; where they are over ``most``, the bound doubles until they are not."""
    levels = {r["l"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("l")).agg(F.count("*").alias("c")).collect()}
    while sum(c for l, c in levels.items() if l >= np.log2(least)) > most:
        least *= 2
    rows = counts.where(F.col("n") >= least).toPandas()
    total = max(1, counts.agg(F.sum("n")).first()[0] or 1)
    w = rows["n"].to_numpy(np.float64)
    return Order(rows["h"].to_numpy(np.int64).view(U), w), float((w * w).sum() / total)


def _postings(docs: DataFrame, order, words: int, boundary: int, percent: int) -> DataFrame:
    """(key, salt, split, pos, n, h): the sets' entries in the lists; one per set and run of rows."""
    small_from = least_size(boundary + 1, percent)

    def of_set(s: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, none = len(s), np.zeros(0, np.int64)
        if n <= boundary:
            for o in subset_sizes(n, percent):
                picks = np.array(list(combinations(range(n), o)), np.int64).reshape(-1, o)
                keys = mix(mix(s)[picks].sum(axis=1, dtype=U) ^ U(0xE7037ED1A0B428DB + o))
                yield keys, np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        if n > boundary or n >= small_from and n * 100 // percent > boundary:
            p = n - least_size(n, percent) + 1
            if not len(heavy):
                head, split = s[:p], np.ones(p, np.int64)
            else:
                o = order.value
                at = np.searchsorted(o.keys, s[heavy])
                at = at[np.argsort(o.rank[at])]
                rare = np.delete(s, heavy)[:p]
                at = at[: p - len(rare)]
                head = np.concatenate([rare, o.keys[at]])
                split = np.concatenate([np.ones(len(rare), np.int64), 1 + (o.weight[at] / SPLIT).astype(np.int64)])
            yield head, np.arange(len(head)), split
        yield s[:0], none, none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        seen: set[int] = set()
        for part in pieces(batches, "text"):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            sets = [s for s in shingle_sets(Words(part["text"]), words) if len(s)]
            if len(seen) > 500_000:
                seen.clear()
            ends = np.cumsum([0, *map(len, sets)])
            hits, _ = members(o.keys, np.concatenate([np.zeros(0, U), *sets]), o.sieve)
            bounds = np.searchsorted(hits, ends)
            for i, s in enumerate(sets):
                h = fingerprint(s)
                if h in seen:
                    continue
                seen.add(h)
                for key, pos, split in of_set(s, hits[bounds[i] : bounds[i + 1]] - ends[i]):
                    for to, x in zip(out, (key, pos, split, np.full(len(key), len(s)), np.full(len(key), h)), strict=True):
                        to.append(x)
            if out[0]:
                key, pos, split, n, h = map(np.concatenate, out)
                salt = (mix(h.view(U)) % split.astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([i64(key), pa.array(salt), pa.array(split > 1), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h)], names=["key", "salt", "split", "pos", "n", "h"])

    return map_texts(docs, run, "key long, salt int, split boolean, pos int, n int, h long")


def _scan_lists(postings: DataFrame) -> DataFrame:
    """The lists with two sets or more: each entry with its list's hub, the first by (pos, h). Streams
    sorted partitions; keeps one entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open list's hub, and whether it has been emitted
        names = ["key", "salt", "split", "pos", "n", "h"]
        shown = False
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch[k].to_numpy(zero_copy_only=False) for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            m = len(c["key"])
            new = np.ones(m, bool)
            new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["salt"][1:] != c["salt"][:-1])
            fresh = new.copy()
            fresh[1:] |= c["h"][1:] != c["h"][:-1]
            hub = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            fresh &= (c["h"] != c["h"][hub]) | new
            listed = np.bincount(hub[fresh], minlength=m)
            take = fresh & ((listed[hub] > 1) | c["split"])
            last = hub[-1]
            if held is not None and shown:
                take[0] = False
            shown = bool(take[last]) or (last == 0 and held is not None and shown)
            held = {k: c[k][last : last + 1] for k in names}
            at = np.flatnonzero(take)
            own = hub[at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k][at]) for k in names), *(pa.array(c[k][own]) for k in ("pos", "n", "h"))], names=[*names, "hub_pos", "hub_n", "hub"])

    ready = postings.repartition("key", "salt").sortWithinPartitions("key", "salt", "pos", "h")
    return ready.mapInArrow(run, "key long, salt int, split boolean, pos int, n int, h long, hub_pos int, hub_n int, hub long")


def _may_link(percent: int, a: Column, b: Column, i: Column, j: Column) -> Column:
    """What sizes and the places of a first shared shingle allow."""
    most = F.least(a - i, b - j).cast("long")
    return (100 + percent) * most >= percent * (a + b).cast("long")


def _sieved(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmaps (h, n, bits) do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            k = c.num_rows
            bits = np.concatenate([c[x].to_numpy(zero_copy_only=False) for x in ("x", "y")])
            n = np.concatenate([c[x].to_numpy() for x in ("n", "m")])
            yield c.select(["a", "b"]).filter(pa.array(may_match(bits, n, np.arange(k), np.arange(k, 2 * k), percent)))

    left, right = (bitmaps.select(F.col("h").alias(h), F.col("n").alias(n), F.col("bits").alias(bits)) for h, n, bits in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, candidates: DataFrame, bitmaps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets link, by their whole sets."""
    spark = docs.sparkSession
    pairs = materialize(_sieved(candidates, bitmaps, percent), "sieved")
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    bits = max(16, min(27, int(8 * max(1, pairs.count())).bit_length()))
    flags = _bitmap(spark, ends, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = flags.value
        seen: set[int] = set()
        for part in pieces(batches, "text"):
            ids, out = [], []
            if len(seen) > 500_000:
                seen.clear()
            for s in shingle_sets(Words(part["text"]), words):
                h = fingerprint(s)
                spot = h & ((1 << bits) - 1)
                if h not in seen and marked[spot >> 3] >> (spot & 7) & 1:
                    seen.add(h)
                    ids.append(h)
                    out.append(s)
            if ids:
                values = pa.array(np.concatenate(out).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32)), values)], names=["h", "s"])

    raw = map_texts(docs, run, "h long, s array<long>").join(ends, "h", "left_semi")
    sets = materialize(raw.groupBy("h").agg(F.any_value("s").alias("s")), "sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = materialize(both.where((100 + percent) * common >= percent * (F.size("sa") + F.size("sb")).cast("long")).select("a", "b"), "links")
    discard(sets, pairs)
    return out


def _bitmap(spark: SparkSession, keys: DataFrame, bits: int):
    """A table of the low bits of column h, of fixed size, as a broadcast; made on the executors in slices."""
    width = max(0, bits - 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for b in batches:
            table[b["h"].to_numpy() & ((1 << bits) - 1)] = True
        slices = table.reshape(1 << width, -1)
        some = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([np.packbits(slices[i], bitorder="little").tobytes() for i in some], pa.binary())], names=["i", "b"])

    def merge(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in t["b"]])
        return pa.table({"i": t["i"][:1], "b": pa.array([out.tobytes()], pa.binary())})

    rows = keys.mapInArrow(run, "i int, b binary").groupBy("i").applyInArrow(merge, "i int, b binary").collect()
    table = np.zeros((1 << width, (1 << bits) >> width >> 3), np.uint8)
    for r in rows:
        table[r["i"]] = np.frombuffer(r["b"], np.uint8)
    return spark.sparkContext.broadcast(table.reshape(-1))


def _cells(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, pos, n, h, root, hub, c): the members of lists that hold two components, to be compared with each other.

    Lists whose hubs are of one component mostly hold the same near copies over again. Where it is less work, their
    members stand together once, each at its first place, and every pair of them is compared once instead of in each list."""
    of = roots.select(F.col("node").alias("h"), "root")
    top = roots.select(F.col("node").alias("hub"), F.col("root").alias("top"))
    named = lists.join(of, "h", "left").join(top, "hub", "left").select("key", "pos", "n", "h", F.coalesce("root", "h").alias("root"), "hub", F.coalesce("top", "hub").alias("top"))
    held = named.groupBy("key").agg(F.count("*").alias("c"), *(f(x).alias(f"{x}{i}") for x in ("root", "hub", "top") for i, f in enumerate((F.min, F.max))))
    wide = held.where("root0 <> root1 and (c > 2 or hub0 <> hub1)").select("key", "c", F.when(F.col("top0") == F.col("top1"), F.col("top0")).alias("g"))
    shared = materialize(named.join(wide, "key").select("key", "pos", "n", "h", "root", "hub", "c", "g"), "shared")
    once = materialize(shared.where("g is not null").groupBy("g", "h").agg(F.min("pos").alias("pos"), F.min("n").alias("n"), F.min("root").alias("root"), F.sum("c").alias("w")), "once")
    whole = once.groupBy("g").agg(F.count("*").alias("c"), F.sum("w").alias("w")).where("c * c < w").select("g", "c")
    # no hub: a pair found in several lists may be a hub's in some of them only
    joined = once.join(whole, "g").select(F.xxhash64("g", F.lit("whole")).alias("key"), "pos", "n", "h", "root", F.col("h").alias("hub"), "c")
    return joined.union(shared.join(whole, "g", "left_anti").select("key", "pos", "n", "h", "root", "hub", "c"))


def _rest(lists: DataFrame, roots: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs of a cell's members that lie in different components and may link, by sizes, places and bitmaps; large cells
    by pairs of blocks. Only pairs that pass leave a task."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h"), blocks).cast("int")
    cells = _cells(lists, roots).join(bitmaps.select("h", "bits"), "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "pos", "n", "h", "root", "hub", "bits")

    def emit(c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, once = np.unique(c["h"], return_index=True)
        c = {k: v[once] for k, v in c.items()}
        if c["root"].min() == c["root"].max():
            return
        first, second = (np.flatnonzero(c["own"] == c[k]) for k in ("x", "y"))
        for start in range(0, len(first), 256):
            i = first[start : start + 256]
            n, most = c["n"][i][:, None] + c["n"][second], np.minimum((c["n"] - c["pos"])[i][:, None], (c["n"] - c["pos"])[second])
            ok = ((100 + percent) * most >= percent * n) & (c["root"][i][:, None] != c["root"][second])
            ok &= (c["hub"][i][:, None] != c["h"][second]) & (c["h"][i][:, None] != c["hub"][second])
            p, q = np.nonzero(ok)
            p, q = i[p], second[q]
            may = may_match(c["bits"], c["n"], p, q, percent)
            p, q = c["h"][p[may]], c["h"][q[may]]
            yield np.minimum(p, q), np.maximum(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "x", "y", "own", "pos", "n", "h", "root", "hub", "bits"]
        held: dict[str, np.ndarray] | None = None

        def flush(c):
            for a, b in emit(c):
                if len(a):
                    both = np.unique(np.stack([a, b]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            c = {k: batch[k].to_numpy(zero_copy_only=False).astype(object if k == "bits" else np.int64) for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            cut = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)) + 1
            edges = [0, *cut.tolist()]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield from flush({k: v[s:e] for k, v in c.items()})
            held = {k: v[edges[-1] :] for k, v in c.items()}
        if held is not None and len(held["key"]):
            yield from flush(held)

    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _linked(documents: DataFrame, words: int, percent: int, frequent: int, most_frequent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, t: its text's hash, h: its set, n_shingles), and (h, root) for sets with links."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    spark = docs.sparkSession
    profiles = materialize(_profiles(docs, words), "profiles")
    table = materialize(profiles.where("kind = 0").select("doc_id", "t", "h", F.col("n").alias("n_shingles"), "bits"), "sizes")
    counts = materialize(profiles.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16"), "counts")
    discard(profiles)
    order, partners = _frequent(counts, frequent, most_frequent)
    boundary = pick_boundary(partners, percent)
    discard(counts)
    shared = spark.sparkContext.broadcast(order)
    lists = materialize(_scan_lists(_postings(docs, shared, words, boundary, percent)), "lists")

    first, second = F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")
    filters = (F.col("h") != F.col("hub")) & _may_link(percent, F.col("n"), F.col("hub_n"), F.col("pos"), F.col("hub_pos"))
    hubs = lists.where("split and h = hub").select("key", F.lit(0).alias("salt"), F.lit(False).alias("split"), "pos", "n", "h")
    pairs = materialize(lists.where(filters).select(first, second).union(_scan_lists(hubs).where(filters).select(first, second)).distinct(), "pairs")
    bitmaps = materialize(table.groupBy("h").agg(F.any_value("n_shingles").alias("n"), F.any_value("bits").alias("bits")), "bitmaps")
    links = _verified(docs, pairs, bitmaps, words, percent)
    roots = components(links)
    more = materialize(_rest(lists, roots, bitmaps, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(lists, pairs)
    if not more.isEmpty():
        links = links.union(_verified(docs, more, bitmaps, words, percent))
        roots = components(links)
    discard(more, bitmaps)
    return table.drop("bits"), roots.withColumnRenamed("node", "h")


def jaccard_components(documents: DataFrame, words: int = 4, percent: int = PERCENT, frequent: int = 64, most_frequent: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents`` (doc_id, text).

    A null or empty text, or one without words, has an empty set, which links with nothing. Equal
    texts and repeated rows share a set. Rows that share a doc_id are one document to the answer: each
    gets its own row and its set's component. A row whose doc_id is null gets a null component_id
    unless its set has other documents. Ids may be numbers or text. An empty table gives no rows; columns but
    doc_id and text are not read. ``frequent`` and ``most_frequent`` only order shingles (estimates over all documents
    suffice); every link is decided on whole sets.
    """
    table, roots = _linked(documents, words, percent, frequent, most_frequent)
    per_set = table.where("n_shingles > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    placed = per_set.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    grouped = placed.where("c > 1 or root <> h").select("root").union(roots.select("root")).distinct()
    known = materialize(placed.join(grouped, "root", "left_semi").select("h", "root", "least"), "known")
    named = known.groupBy("root").agg(F.min("least").alias("component_id")).join(known, "root").select("h", "component_id")
    return table.join(named, "h", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of each component, all columns: that of the smallest doc_id (nulls last, then by a hash of the text).

    Rows are told apart by doc_id and text, so that different texts under one id, or without an id, are different
    documents. Of rows equal in both any one stays. A null or empty text, or one without words, links with nothing
    and stays, however often. An empty table stays empty; columns of any name are carried. What goes is taken out by
    a broadcast while it is within ``broadcast_rows`` rows, else by a join.
    """
    table, roots = _linked(documents, words, percent, 64, 500_000)
    rows = materialize(table.where("n_shingles > 0").groupBy("doc_id", "t", "h").agg(F.count("*").alias("c")).join(roots, "h", "left").select("doc_id", "t", "c", F.coalesce("root", "h").alias("root")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = rows.groupBy("root").agg(F.min(place).alias("f"), F.count("*").alias("k")).where("k > 1").select("root", "f")
    told = materialize(rows.join(first, "root", "left").select("doc_id", "t", "c", F.coalesce(place != F.col("f"), F.lit(False)).alias("goes")), "told")
    gone, twice = told.where("goes"), told.where("not goes and c > 1")
    discard(table, rows)
    mark = free_name("t", documents.columns)
    kept = documents.withColumn(mark, F.xxhash64("text"))

    def among(them: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(them) if them.count() <= broadcast_rows else them
        few = few.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
        return kept.join(few, (kept[mark] == few["__t"]) & kept["doc_id"].eqNullSafe(few["__id"]), how)

    kept = among(gone, "left_anti")
    if not twice.isEmpty():
        kept = among(twice, "left_anti").unionByName(among(twice, "left_semi").dropDuplicates(["doc_id", mark]))
    return kept.select(documents.columns)
