import numpy as np
import pytest
from conftest import DATA

from siltstone.operators import vectors as V
from siltstone.plans import search
from siltstone.session import work_path

SCHEMA = "vec_id long, embedding array<float>"


def unit_vectors(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(rows, k):
    return {(r.query_id, r.vec_id) for r in rows if r["rank"] <= k}


@pytest.fixture(scope="module")
def base(spark):
    x = unit_vectors(800, 64, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)]
    return x, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 800, 8)] + [(1, None)], "query_id long, vector array<float>")


def test_top_rows_against_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((5, 10), (200, 7), (10, 10)):
        s, keys = np.round(rng.random((6, n)), 1), rng.permutation(n)
        i, j = V.top_rows(s, keys, k)
        for q in range(6):
            want = sorted(range(n), key=lambda p: (-s[q, p], keys[p]))[:k]
            assert j[i == q].tolist() == want


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_flat_finds_itself(base, metric):
    x, df, queries = base
    got = V.flat_topk(df, queries, 5, metric).collect()
    assert len(got) == 500 and {r.vec_id for r in got if r["rank"] == 1} == set(range(0, 800, 8))
    s = x[::8].astype(float) @ x.T.astype(float)
    want = {(8 * q, int(v)) for q in range(100) for v in np.argsort(-s[q])[:5]}
    assert len(best(got, 5) - want) <= 2


def test_cells(spark, base):
    x, df, queries = base
    path = work_path(spark, "index")
    V.save_cells(path, V.train_cells(df, 16))
    assert V.add_vectors(spark, path, df.where("vec_id < 500")) == 500
    assert V.add_vectors(spark, path, df.union(df)) == 300 and V.index_keys(spark, path).distinct().count() == 800
    vectors, cells = V.load_cells(spark, path)
    flat = best(V.flat_topk(df, queries, 10).collect(), 10)
    V.GROUP, kept = 30, V.GROUP
    whole = V.cells_topk(vectors, queries, cells, 10, 16).collect()
    V.GROUP = kept
    assert len(best(whole, 10) & flat) >= 0.99 * len(flat)
    some = V.cells_topk(vectors, queries, cells, 10, 4).collect()
    assert sum(r.query_id == r.vec_id for r in some if r["rank"] == 1) >= 95 and best(some, 10) != flat


def test_codes(base):
    x, df, queries = base
    books = V.train_codebooks(df, 16, 64)
    coded = V.encode(df, books)
    got = V.codes_topk(coded, books, queries, 10).collect()
    assert sum(r.query_id == r.vec_id for r in got if r["rank"] == 1) >= 60
    code = {r.vec_id: np.frombuffer(r.codes, np.uint8) for r in coded.collect()}
    for r in got[:50]:  # a score is the product with the codes' vector
        back = books[np.arange(16), code[r.vec_id]].reshape(-1)
        assert r.score == pytest.approx(float(x[r.query_id] @ back), abs=1e-5)
    with pytest.raises(ValueError):
        V.train_codebooks(df, 7, 8)


def test_recall_of_the_queries(spark):
    flat = best(search.flat_ip_topk(spark, DATA).collect(), 10)
    for query, least in ((search.ivf_kmeans_search, 0.9), (search.pq_encode_search, 0.9), (search.ivf_pq_search, 0.8)):
        assert len(best(query(spark, DATA).collect(), 10) & flat) >= least * len(flat), query.__name__
