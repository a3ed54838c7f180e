"""What a task holds is bounded, however many rows a batch has: the functions that go to executors are run here on one
large batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siltstone.engine import Engine
from siltstone.functions.english import lexemes
from siltstone.operators import bm25, chunking as C, evaluation as E, evidence as EV, fulltext as FT, vectors as V

MB = 1e6


@pytest.fixture
def sent(spark, monkeypatch):
    """The functions given to mapInArrow, the last one last."""
    frame, found = type(spark.range(0)), []
    kept = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: found.append(run) or kept(self, run, *a, **b))
    return found


def held(run, *batches):
    """(rows out, the most MB that Python and numpy held meanwhile, rows of the largest batch out)."""
    tracemalloc.start()
    rows = most = 0
    for b in run(*batches):
        rows, most = rows + b.num_rows, max(most, b.num_rows)
    peak = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    return rows, peak, most


def words(n, seed=1):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice('abcdefgh')}ub{rnd.randrange(5000)}ing" for _ in range(n))


def test_fulltext_search_holds_slices(spark, sent):
    queries = spark.createDataFrame([(1, "rocks")], "query_id long, query string")
    FT.fulltext_search(FT.with_lexemes(spark.createDataFrame([(1, "rocks")], "doc_id long, text string")), queries, 2)
    one = [{"lexeme": k, "places": v} for k, v in lexemes(words(300) + " rocks").items()]
    lists = pa.array([one], pa.list_(pa.struct([("lexeme", pa.string()), ("places", pa.list_(pa.int32()))])))
    big = pa.RecordBatch.from_arrays([pa.array(range(1500)), lists.take(pa.array([0] * 1500))], names=["doc_id", "text_tsv"])
    rows, mb, _ = held(sent[-1], iter([big]))
    assert rows == 1500 and mb < 30


def test_asked_lexemes_alone_find_the_same(spark):
    rnd = random.Random(3)
    made = lambda n: " ".join(rnd.choice("Rocks moving the glaciers ice moved running a skies".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, made(rnd.randint(0, 12))) for i in range(200)] + [(500, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, made(3)) for q in range(20)] + [(30, "the a")], "query_id long, query string")
    whole, few = FT.with_lexemes(docs), FT.with_lexemes(docs, terms=FT.query_lexemes(queries))
    asked = FT.query_lexemes(queries)
    for r in whole.collect():
        assert {x.lexeme: x.places for x in r.text_tsv} == lexemes(r.text) and [x.lexeme for x in r.text_tsv] == sorted(lexemes(r.text))
    assert {r.doc_id: {x.lexeme: x.places for x in r.text_tsv} for r in few.collect()} == {r.doc_id: {k: v for k, v in lexemes(r.text).items() if k in asked} for r in docs.collect()}
    rows = lambda df: sorted(map(tuple, FT.fulltext_search(df, queries, 3).collect()))
    assert rows(few) == rows(whole) != []


def test_bm25_counts_slices(spark, sent):
    bm25.counted(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    one = pa.array([words(1000).split()], pa.list_(pa.string()))
    big = pa.RecordBatch.from_arrays([pa.array(range(2000)), one.take(pa.array([0] * 2000))], names=["doc_id", "tokens"])
    rows, mb, most = held(sent[-1], iter([big]))
    assert mb < 40 and most < 400_000 and rows > 1_000_000


def test_evidence_holds_slices(spark, sent):
    asked = spark.createDataFrame([(1, "ub1")], "query_id long, query string")
    EV.containing(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked, "doc_id", "text", "query_id", "query")
    big = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["x" * 20_000 + "ub1"] * 2000)], names=["doc_id", "text"])
    rows, mb, _ = held(sent[-1], iter([big]))
    assert rows == 2000 and mb < 20


def vectors(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.reshape(-1)))


@pytest.mark.parametrize("kind", ["flat", "codes"])
def test_vector_search_holds_tiles(spark, sent, kind):
    base = spark.createDataFrame([(1, [0.1] * 8)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame(pa.table({"query_id": range(3000), "vector": vectors(3000, 8, 2)}))
    books = np.random.default_rng(1).normal(size=(4, 256, 2))
    if kind == "flat":
        V.flat_topk(base, queries, 5)
        big = pa.RecordBatch.from_arrays([pa.array(range(6000)), vectors(6000, 8, 3)], names=["vec_id", "embedding"])
    else:
        V.codes_topk(V.encode(base, books), books, queries, 5)
        code = np.random.default_rng(4).integers(0, 256, (6000, 4)).astype(np.uint8)
        big = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "codes"])
    rows, mb, _ = held(sent[-1], iter([big, big.slice(0, 0)]))
    assert rows == 15_000 and mb < 100


def test_best_of_tiles_against_sorting():
    rng = np.random.default_rng(7)
    scores, keys = np.round(rng.random((9, 700)), 1), rng.permutation(700)
    for order in (np.arange(700), np.argsort(scores[0])):  # also scores that only rise
        best = V.Best(9, 6)
        for at in range(0, 700, 90):
            some = order[at : at + 90]
            best.meet(np.arange(9), some, keys[some], lambda q, x: scores[np.ix_(q, x)])
        for q in range(9):
            want = sorted(range(700), key=lambda p: (-scores[q, p], keys[p]))[:6]
            assert best.key[q].tolist() == keys[want].tolist() and best.score[q].tolist() == scores[q, want].tolist()


def test_chunks_are_cut_in_slices(spark, sent):
    C.chunk_documents(spark.createDataFrame([(1, "T", "u", "a")], "doc_id long, title string, url string, text string"))
    n, text = 100, "x" * 60_000
    big = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["T"] * n), pa.array(["u"] * n), pa.array([text] * n)], names=["doc_id", "title", "url", "text"])
    rows, mb, most = held(sent[-1], iter([big]))
    assert most < rows / 4 and mb < 40


def test_long_answers_are_counted_once(spark):
    p, g = pa.array([["a", "b", "a"], []]), pa.array([[["a", "a", "a"], []], []], pa.list_(pa.list_(pa.string())))
    assert E._common.func(p, g).to_pylist() == [[{"n": 2, "p": 3, "g": 3}, {"n": 0, "p": 3, "g": 0}], []]
    long = pa.array([[str(i) for i in range(100_000)]])
    assert E._common.func(long, pa.array([long.to_pylist()])).to_pylist() == [[{"n": 100_000, "p": 100_000, "g": 100_000}]]


def test_modes_read_written_rankings(spark):
    text, vector = "doc_id long, title string, url string, text string", "vec_id long, embedding array<float>"
    docs = spark.createDataFrame([(i, "t", "u", f"rock ice{i}") for i in range(5)], text)
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], vector)
    q = spark.createDataFrame([(1, "rock ice1")], "query_id long, query string")
    runs = Engine(docs, e).runs(q, spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<float>"))
    assert all(r.inputFiles() and all("/tables/" in f for f in r.inputFiles()) for m, r in runs.items() if m != "hybrid_rerank")
