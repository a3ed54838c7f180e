"""Vector search: exact, by cells, and by product-quantised codes.

A set of queries goes out whole, and one scan of the vectors meets them in tiles of SCORES numbers; a task keeps the
best of each query and gives them once. By cells, queries and vectors meet in groups of a cell, so that other cells are
not scored; a large cell is several groups. By codes, a vector costs a table lookup for each part, and is never
rebuilt. Rows without a vector are not searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siltstone.session import pieces, written

#: Vectors and scores of one tile.
ROWS, SCORES = 8192, 1 << 20
#: Vectors of a cell that are in one group.
GROUP = 32_768


def unit(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _asked(queries: DataFrame, query: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Queries that have a vector: their ids and the vectors."""
    rows = queries.where(F.col(vector).isNotNull()).select(query, vector).toArrow()
    return rows[query].to_numpy(), matrix(rows[vector].combine_chunks())


def top_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the ``k`` greatest scores of each row, all ties by ascending key."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero(scores >= least[:, None])
    else:
        i, j = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((keys[j], -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep]


def products(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scores of queries x vectors, greater is better, rounded so that sums in another order agree."""
    if metric == "ip":
        return lambda q, x: np.round(s := q @ x.T, 6, out=s)
    return lambda q, x: np.round(-((q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)), 6)


def _ranked(found: DataFrame, k: int, key: str, query: str) -> DataFrame:
    """The best ``k`` over all tasks; a distance is given as it is."""
    order = W.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


class Best:
    """The ``k`` best so far of each of ``n`` queries: greater scores first, ties by key."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.key = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def meet(self, q: np.ndarray, x: np.ndarray, keys: np.ndarray, score: Callable) -> None:
        """Queries ``q`` and vectors or codes ``x``, in tiles."""
        for v in range(0, len(keys), ROWS):
            some, names = x[v : v + ROWS], keys[v : v + ROWS]
            step = max(1, SCORES // len(names))
            for at in range(0, len(q), step):
                self._take(at, score(q[at : at + step], some), names)

    def _take(self, at: int, scores: np.ndarray, keys: np.ndarray) -> None:
        held, names = self.score[at : at + len(scores)], self.key[at : at + len(scores)]
        least, last = held[:, -1:], names[:, -1:]
        i, j = np.nonzero((scores > least) | ((scores == least) & (keys < last)))
        if len(i) > 4 * held.size:
            i, j = top_rows(scores, keys, self.k)
        if not len(i):
            return
        rows = np.concatenate([np.repeat(np.arange(len(held)), self.k), i])
        s, t = np.concatenate([held.ravel(), scores[i, j]]), np.concatenate([names.ravel(), keys[j]])
        order = np.lexsort((t, -s, rows))
        kept = order[np.searchsorted(rows[order], np.arange(len(held)))[:, None] + np.arange(self.k)]
        held[:], names[:] = s[kept], t[kept]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.score > -np.inf)
        return ids[i], self.key[i, j], self.score[i, j]


def _scan(base: DataFrame, asked: tuple[np.ndarray, np.ndarray], columns: list[str], read: Callable, score: Callable, k: int, key: str, query: str) -> DataFrame:
    """The ``k`` best of each query of ``asked`` (ids, vectors) in each task's rows of ``base``; ``read`` gives what
    ``score`` takes from a column."""
    shared = base.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = Best(len(ids), k)
        for b in pieces(batches):
            best.meet(q, read(b[columns[1]]), b[key].to_numpy(), score)
        for at in range(0, len(ids), ROWS):
            some = Best(0, k)
            some.score, some.key = best.score[at : at + ROWS], best.key[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(some.rows(ids[at : at + ROWS]), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[query, key, "score"])

    return base.select(*columns).where(F.col(columns[1]).isNotNull()).mapInArrow(run, f"{query} long, {key} long, score double")


def flat_topk(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip", key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query, key, score, rank): the exact ``k`` best by inner product or squared distance; ties by key. Each task gives
    k of each query, so what is shuffled does not grow with a task's rows."""
    out = _ranked(_scan(base, _asked(queries, query, query_vector), [key, vector], matrix, products(metric), k, key, query), k, key, query)
    return out if metric == "ip" else out.withColumn("score", -F.col("score"))


def cells_topk(base: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "ip", key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "vector", books: np.ndarray | None = None) -> DataFrame:
    """The same over ``base`` with ``cell``: a query meets the vectors of its ``nprobe`` best cells, in groups of GROUP.
    With ``books`` the column ``vector`` holds codes, scored by lookups."""
    read, score = (matrix, products(metric)) if books is None else by_codes(books)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)).cast("int")
    sizes = written(base.groupBy("cell").agg(F.count("*").alias("n")).select("cell", groups.alias("groups")), "cells")
    few = F.broadcast(sizes)  # a row for each cell of the index, whose number is a parameter
    part = F.pmod(F.xxhash64(key), F.col("groups")).cast("int")
    held = base.where(F.col(vector).isNotNull()).join(few, "cell").select("cell", part.alias("part"), key, F.col(vector).alias("v"))
    probes = flat_topk(centroids.select("cell", "vector"), queries, nprobe, metric, key="cell", vector="vector", query=query, query_vector=query_vector)
    asked = probes.select(query, "cell").join(queries.select(query, F.col(query_vector).alias("q")), query).join(few, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), query, "q")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({query: pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        keys, ids, q = one[key].to_numpy(), two[query].to_numpy(), matrix(two["q"].combine_chunks())
        best = Best(len(ids), k)
        best.meet(q, read(one["v"].combine_chunks()), keys, score)
        return pa.table(dict(zip((query, key, "score"), best.rows(ids), strict=True)))

    found = held.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, f"{query} long, {key} long, score double")
    out = _ranked(found, k, key, query)
    return out if metric == "ip" else out.withColumn("score", -F.col("score"))


def assign_cells(base: DataFrame, centroids: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``base`` with ``cell``, that of the nearest centroid (cell, vector) by inner product; ties by cell.
    The number of centroids is a parameter of the index, so they fit a broadcast."""
    rows = sorted((r["cell"], list(r["vector"])) for r in centroids.select("cell", "vector").collect())
    shared = base.sparkSession.sparkContext.broadcast((np.array([c for c, _ in rows]), np.array([v for _, v in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = shared.value
        for b in batches:
            best = cells[np.round(matrix(b[vector]) @ c.T, 6).argmax(axis=1)] if b.num_rows else cells[:0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], schema=b.schema.append(pa.field("cell", pa.int64())))

    return base.mapInArrow(run, base.withColumn("cell", F.lit(0).cast("long")).schema)


def training_rows(base: DataFrame, rows: int, key: str, seed: int) -> DataFrame:
    """About ``rows`` rows with a vector, by a hash of the key: the bounded sample that an index learns from."""
    n = base.where(F.col("embedding").isNotNull()).count() if "embedding" in base.columns else base.count()
    share = min(1.0, rows / max(1, n))
    return base.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def train_cells(base: DataFrame, nlist: int, vector: str = "embedding", seed: int = 42, key: str = "vec_id", sample: int = 200_000) -> DataFrame:
    """(cell, vector) by k-means on cosine distance over about ``sample`` rows; few rows mean fewer cells."""
    rows = training_rows(base.where(F.col(vector).isNotNull()), sample, key, seed).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).cache()
    try:
        k = max(1, min(nlist, max(16, rows.count() // 39)))
        centers = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows).clusterCenters()
    finally:
        rows.unpersist()
    return base.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell long, vector array<double>")


def train_codebooks(base: DataFrame, parts: int, codes: int, vector: str = "embedding", seed: int = 42, key: str = "vec_id", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """parts x codes x width: k-means of each slice of about ``sample`` vectors, which come to the driver; the
    dimension must divide by ``parts``."""
    rows = training_rows(base.where(F.col(vector).isNotNull()), sample, key, seed).select(vector).toArrow()
    x = matrix(rows[vector].combine_chunks())
    if not len(x) or x.shape[1] % parts:
        raise ValueError(f"{len(x)} vectors of dimension {x.shape[1]} do not divide into {parts} parts")
    x, rng = x.reshape(len(x), parts, -1), np.random.default_rng(seed)
    books = np.stack([x[rng.choice(len(x), codes, replace=len(x) < codes), m] for m in range(parts)])
    for _ in range(rounds):
        for m in range(parts):
            near = codes_of(x[:, m : m + 1], books[m : m + 1])[:, 0]
            n = np.bincount(near, minlength=codes)
            sums = np.stack([np.bincount(near, x[:, m, d], codes) for d in range(x.shape[2])], axis=1)
            books[m] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], books[m])
    return books


def codes_of(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest code of each part of vectors (n x parts x width)."""
    far = lambda m: (books[m] ** 2).sum(axis=1) - 2 * x[:, m] @ books[m].T
    return np.stack([far(m).argmin(axis=1) for m in range(len(books))], axis=1).astype(np.uint8 if books.shape[1] <= 256 else np.uint16)


def encode(base: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, codes): a byte for each part of the vector, two where there are more than 256 codes."""
    shared = base.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            if b.num_rows:
                code = codes_of(matrix(b[vector]).reshape(b.num_rows, len(books), -1), books)
                yield pa.RecordBatch.from_arrays([b[key], pa.array([c.tobytes() for c in code], pa.binary())], names=[key, "codes"])

    return base.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{key} long, codes binary")


def code_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """query x part x code: the products of each query's parts with all codes."""
    return np.einsum("qmw,mcw->qmc", q.reshape(len(q), len(books), -1), books)


def lookups(tables: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Scores of queries x rows: the sums of the rows' entries in the queries' tables."""
    out = np.zeros((len(code), len(tables)))
    for m, entries in enumerate(np.ascontiguousarray(tables.transpose(1, 2, 0))):
        out += entries[code[:, m]]
    return np.ascontiguousarray(np.round(out, 6, out=out).T)


def by_codes(books: np.ndarray) -> tuple[Callable, Callable]:
    """How a column of codes is read, and scored for a tile of queries, whose tables are made for that tile alone."""
    kind = np.uint8 if books.shape[1] <= 256 else np.uint16
    read = lambda column: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), len(books))
    return read, lambda q, code: lookups(code_tables(q, books), code)


def codes_topk(coded: DataFrame, books: np.ndarray, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query, key, score, rank) by inner product with each vector's codes: a table of products of the query with all
    codes is made for a tile, and a vector's score is a sum of lookups."""
    return _ranked(_scan(coded, _asked(queries, query, query_vector), [key, "codes"], *by_codes(books), k, key, query), k, key, query)


def new_rows(base: DataFrame, stored: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row of each key of ``base`` that ``stored`` does not have."""
    return base.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def save_cells(path: str, centroids: DataFrame) -> None:
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def add_vectors(spark: SparkSession, path: str, base: DataFrame, key: str = "vec_id", vector: str = "embedding") -> int:
    """Add the vectors of new keys to the index at ``path``, a folder of files for each cell; returns how many.

    The cells must have been trained. Keys that the index has, and repeats, are passed over; rows that lack a vector too.
    """
    centroids = spark.read.parquet(f"{path}/centroids")
    rows = base.select(key, vector).where(F.col(vector).isNotNull())
    try:
        rows = new_rows(rows, spark.read.parquet(f"{path}/vectors"), key)
    except Exception as e:  # the first rows of the index
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = rows.dropDuplicates([key])
    added = written(assign_cells(rows, centroids, key, vector), "added")
    added.repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    return added.count()


def index_keys(spark: SparkSession, path: str, key: str = "vec_id") -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").select(key)


def load_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors with their cell, centroids) of a written index."""
    return spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("long")), spark.read.parquet(f"{path}/centroids")
