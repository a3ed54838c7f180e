import pytest
from pyspark.sql import functions as F

from siltstone.functions.wikitext import cleaned
from siltstone.operators import chunking as C, evaluation as E, retrieval as R, storage as S


def test_cleaning(spark):
    rows = [("a {{x {{y}} z}} b [[C|d]] [[e]] <ref>q</ref>'''f''' [https://g.h i]",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(cleaned(F.col("t"))).collect()] == ["a b d e f i", ""]


def test_sections_keep_subsections_of_left_out_ones():
    found = dict(C.sections("T", "lead\n== A ==\none\n=== B ===\ntwo\n== References ==\nno\n=== C ===\nthree"))
    assert found == {"T > Overview": "lead", "T > A": "one", "T > A > B": "two", "T > A > C": "three"}


def test_sentences_and_windows():
    rules = C.ChunkRules(target=8, overlap=3, least=1)
    assert [s for s, _ in C.sentences("Dr. Wu came. She left.", rules, C.count_tokens)] == ["Dr. Wu came.", "She left."]
    texts = [t for t, _ in C.windows([("a", 3), ("b", 3), ("c", 3), ("d", 3)], rules)]
    assert texts == ["a b", "b c", "c d"]
    assert C.chunk_article("T", "   ") == []


def test_chunk_ids(spark):
    rows = C.chunk_documents(spark.createDataFrame([(7, "T", "u", "word. " * 900), (8, "T", "u", " ")], "doc_id long, title string, url string, text string")).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) and {r.chunk_id >> 16 for r in rows} == {7}


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "query_id long, doc_id long, score double, rank long")
    sparse = spark.createDataFrame([(1, 12, 5.0, 1), (1, 13, 4.0, 2)], dense.schema)
    rows = R.reciprocal_rank_fusion(dense, sparse).orderBy("fused_rank").collect()
    assert [r.doc_id for r in rows] == [12, 10, 11, 13] and rows[0].rrf_score == pytest.approx(1 / 63 + 1 / 61, abs=1e-8)


def test_metrics(spark):
    runs = spark.createDataFrame([(1, 5, 3)], "query_id long, doc_id long, rank long")
    truth = spark.createDataFrame([(1, 5, 1.0), (2, 6, 1.0)], "query_id long, doc_id long, rel double")
    got = {r.query_id: r for r in E.retrieval_metrics(runs, truth).collect()}
    assert (got[1].mrr, got[1].hit_rate_1, got[1].hit_rate_5, got[2].mrr, got[2].ndcg_10) == (0.333333, 0.0, 1.0, 0.0, 0.0)


def test_storage(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, x string, v int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], old.schema)
    assert {(r.k, r.x) for r in S.upsert_last_wins(old, new, "k", F.col("v")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.k, r.x) for r in S.insert_ignore(old, new, "k", F.col("v")).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_graded_gains(spark):
    import math

    runs = spark.createDataFrame([(1, 5, 2), (1, 6, 3), (1, 9, 1)], "query_id long, doc_id long, rank long")
    truth = spark.createDataFrame([(1, 5, 2.0), (1, 6, 0.5), (1, 7, 1.0)], "query_id long, doc_id long, rel double")
    got = E.retrieval_metrics(runs, truth).first()
    gain = lambda rel, rank: (2**rel - 1) / math.log2(rank + 1)
    want = (gain(2, 2) + gain(0.5, 3)) / (gain(2, 1) + gain(1, 2) + gain(0.5, 3))
    assert got.ndcg_5 == pytest.approx(want, abs=1e-6) and got.recall_5 == pytest.approx(2 / 3, abs=1e-6) and got.mrr == 0.5


def test_token_scores_of_several_golds(spark):
    rows = [("the cat sat", ["a cat", "cat sat down"], "r"), ("", ["x"], "r"), ("x", [], "r"), ("x", None, "r"), ("b b", ["b"], "r")]
    got = spark.createDataFrame(rows, "p string, g array<string>, f1 string").select(E.token_prf(F.col("p"), F.col("g")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [(0.8, 1.0, 0.6667), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.6667, 0.5, 1.0)]
    cited = spark.createDataFrame([([1, 1, 2], [1]), ([], []), ([], [1])], "c array<long>, t array<long>")
    assert [round(r[0], 4) for r in cited.select(E.citation_precision(F.col("c"), F.col("t"))).collect()] == [0.6667, 1.0, 0.0]
