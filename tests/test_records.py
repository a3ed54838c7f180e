import json
import random
import re
from itertools import product

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from siltstone import __main__ as cli
from siltstone.engine import MODES, Engine
from siltstone.functions.english import lexemes, stem
from siltstone.operators import bm25, evidence as EV, fulltext as FT, lookup as L, runs as R
from siltstone.operators.chunking import ChunkRules, windows
from siltstone.operators.embedding import embedded, hashed
from siltstone.plans import passages as P
from siltstone.session import work_path
from siltstone.sources import readers, synthetic, writers
from siltstone.streaming.ingest import embed_stream, ingest, rolling_latency


def normal(x):
    return " ".join(w for w in re.sub(r"[!-/:-@\[-`{-~]", "", x.lower()).split() if w not in ("a", "an", "the"))


def test_items_of_any_length_are_found(spark):
    docs = [(1, "xx hello yy"), (2, "hello"), (3, "say hello world now"), (4, None), (5, "nothing")]
    items = [(1, "hello"), (2, "hello world"), (3, "o w"), (4, "absent"), (5, None), (6, "hello"), (7, "")]
    got = EV.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, query string"), "doc_id", "text", "query_id", "query")
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, i in items for d, t in docs if i is not None and t is not None and i in t)


def test_graded_evidence_against_plain_loops(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["ice", "Lava", "the", "x1", "2", "fruit-tree", "é", "lav"])
    passages = [(i, " ".join(word() for _ in range(3)), " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(150)]
    samples = [(q, [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(2)], [" ".join(word() for _ in range(rnd.randint(1, 2)))]) for q in range(25)] + [(90, [], ["ice"]), (91, ["  "], ["ice"]), (92, ["lava"], [])]
    want = {}
    for (q, answers, titles), (k, title, text) in product(samples, passages):
        if not [a for a in answers if a.strip()]:
            continue
        spans = any(normal(a) and re.search(rf"\b{re.escape(normal(a))}\b", normal(text)) for a in answers)
        norms = {normal(t) for t in titles if t} - {""}
        named = normal(title) in norms or any(len(t) >= 2 and t in normal(title) for t in norms)
        if spans or named:
            want[q, k] = 2.0 if spans and named else 1.0 if spans else 0.5
    got = EV.map_evidence(spark.createDataFrame(samples, "query_id long, answers array<string>, titles array<string>"), spark.createDataFrame(passages, "chunk_id long, title string, text string"))
    assert {(r.query_id, r.chunk_id): r.rel for r in got.collect()} == want and {0.5, 1.0, 2.0} == set(want.values())


def test_stems():
    pairs = "consigned consign,consistency consist,consolation consol,conspicuously conspicu,knives knive,knotty knotti,generously generous,running run,hopping hop,hoping hope,skies sky,ties tie,agreed agre,luxuriating luxuri,dying die,national nation,relational relat,by by"
    assert all(stem(a) == b for a, b in (p.split() for p in pairs.split(",")))
    assert lexemes("The cats were running; a cat RUNS") == {"cat": [2, 6], "run": [4, 7]}


def test_covers_against_all_windows():
    rnd = random.Random(4)
    for _ in range(200):
        places = {t: sorted(rnd.sample(range(1, 25), rnd.randint(1, 4))) for t in "abc"[: rnd.randint(1, 3)]}
        taken, used = {}, set()
        for t, ps in places.items():  # a place holds one word
            taken[t] = [p for p in ps if p not in used and not used.add(p)] or [30 + len(used)]
        spans = [(p, q) for p in range(1, 40) for q in range(p, 40) if all(any(p <= x <= q for x in ps) for ps in taken.values())]
        least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
        want = sum(0.1 / (1 + (q - p) - (sum(p <= x <= q for ps in taken.values() for x in ps) - 1)) for p, q in least)
        assert FT.cover_rank(taken, set(taken)) == pytest.approx(want)


def test_fulltext_search(spark):
    docs = spark.createDataFrame([(1, "Glaciers moved the rocks"), (2, "a rock and a moving glacier, rocks"), (3, "rocks only"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "moves rock"), (2, "the"), (3, "rock"), (4, "absent rock")], "query_id long, query string")
    stored = FT.with_lexemes(docs).drop("text")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in FT.fulltext_search(stored, queries, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 1, 2), (3, 2, 1), (3, 1, 2)]


def test_a_written_index_finds_the_same(spark):
    docs, queries, path = spark.read.parquet(f"{DATA}/documents.parquet"), P.benchmark_queries(spark, DATA), work_path(spark, "bm25")
    bm25.save_index(docs, path, buckets=8)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(bm25.search_index(bm25.load_index(spark, path), queries, 5, buckets=8)) == rows(bm25.search(docs, queries, 5))
    blank = spark.createDataFrame([(1, " "), (2, "the of")], "query_id long, query string")
    assert bm25.search(docs, blank, 5).count() == 0 and bm25.search(docs.limit(0), queries, 5).count() == 0


def test_articles_and_their_files(spark, tmp_path):
    rows = [("wiki_12", None, "u", "text", None), (None, "t", None, "more", ["c"]), ("x", "t", "u", None, [])]
    spark.createDataFrame(rows, "id string, title string, url string, content string, categories array<string>").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = readers.read_articles(spark, str(tmp_path / "in")).collect()
    assert [(r.doc_id, r.title, r.url, r.text, r.categories) for r in got] == [(12, "", "u", "text", []), (2, "t", "", "more", ["c"]), (3, "t", "u", "", [])]
    names = ["chunks_00002-of-00041", "shard-7", "part00013", "none"]
    ids = spark.createDataFrame([(n,) for n in names], "n string").select(readers.shard_id(F.col("n"), -1)).collect()
    assert [r[0] for r in ids] == [2, 7, 13, -1]
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).toPandas().to_parquet(tmp_path / f"chunks_{k:03d}.parquet")
    folder = f"file://{tmp_path}"
    assert readers.read_shards(spark, folder, max_shards=2).count() == 20 and readers.chunk_store(spark, folder, 1).count() == 10
    feet = readers.parquet_footers(spark, folder, "chunks_*").collect()
    assert sorted((r.rows, r.row_groups) for r in feet) == [(10, 1)] * 3 and all(r.packed_bytes > 0 for r in feet)
    assert {len(r.sha256) for r in readers.file_digests(spark, folder, "chunks_*").collect()} == {64}
    assert [r.id for r in readers.first_rows(spark, f"{folder}/chunks_001.parquet", 3).collect()] == [10, 11, 12]


def test_questions(spark, tmp_path):
    lines = ['{"question": "a", "answer": "x"}', "", '{"id": "k", "question": "b", "answers": ["y", "z"], "titles": ["T"]}', '{"query_id": "q", "aliases": ["l"]}']
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    got = [tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.jsonl")).collect()]
    assert got == [("q_0", "a", ["x"], [], []), ("k", "b", ["y", "z"], [], ["T"]), ("q", "", [], ["l"], [])]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "units")
    for v in (1, 2):
        writers.write_units(spark.createDataFrame([(1, "a", v), (2, "b", v)][: 3 - v], "id long, unit string, v long"), path)
    assert sorted((r.unit, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
    writers.write_report(spark.range(2), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 2
    writers.write_embeddings(embedded(spark.createDataFrame([(2, "ice"), (1, "ice")], "chunk_id long, text string"), hashed(8)), str(tmp_path / "e"))
    a, b = spark.read.parquet(str(tmp_path / "e")).orderBy("chunk_id").collect()
    assert (a.chunk_id, b.chunk_id) == (1, 2) and a.embedding == b.embedding
    L.log_queries(spark.createDataFrame([("q", [1], 2.0)], "query_text string, retrieved array<long>, total_ms double"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("query_id is not null and created_at is not null").count() == 1


def test_made_up_articles_answer_their_questions(spark):
    made = synthetic.articles(spark, 40).withColumnRenamed("id", "chunk_id")
    assert made.collect() == synthetic.articles(spark, 40).withColumnRenamed("id", "chunk_id").collect()
    samples = synthetic.questions(spark)
    found = {r.query_id: r for r in EV.map_evidence(samples, made).where("rel = 2").groupBy("query_id").count().collect()}
    assert len(found) == 20 and samples.count() == 23


def test_windows_against_an_independent_fold():
    rnd, rules = random.Random(6), ChunkRules(target=20, overlap=6)
    for _ in range(200):
        parts = [(f"s{i}", rnd.randint(1, 14)) for i in range(rnd.randint(1, 25))]
        want, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and (j == i or sum(n for _, n in parts[i : j + 1]) <= 20):
                j += 1
            first = i
            want.append((first, j))
            if j == len(parts):
                break
            back = j - 1
            while back > first and sum(n for _, n in parts[back:j]) < 6 and sum(n for _, n in parts[back - 1 : j]) <= 6:
                back -= 1
            i = back if sum(n for _, n in parts[back : j + 1]) <= 20 else back
            if (i, j) == (first, j) and i == first:
                break
        got = [tuple(t.split()) for t, _ in windows(parts, rules)]
        assert got[0] == tuple(t for t, _ in parts[want[0][0] : want[0][1]])
        flat = [t for w in got for t in w]
        assert list(dict.fromkeys(flat)) == [t for t, _ in parts]  # every sentence, in order
        for a, b in zip(got, got[1:], strict=False):
            shared = [t for t in a if t in b]
            assert shared and list(b[: len(shared)]) == shared == list(a[-len(shared) :])


def test_streams(spark, tmp_path):
    src, out, vec = (f"file://{tmp_path}/{n}" for n in ("in", "out", "vec"))
    one = spark.createDataFrame([(7, "T", "u", "A sentence here. " * 60), (8, "T", "u", " ")], "doc_id long, title string, url string, text string")
    one.write.parquet(src)
    go = lambda: (ingest(spark, src, out, f"file://{tmp_path}/c1").awaitTermination(), embed_stream(spark, f"{out}/*", vec, f"file://{tmp_path}/c2").awaitTermination())
    go()
    n = spark.read.parquet(out).count()
    one.write.mode("append").parquet(src)  # the same articles again
    go()
    assert spark.read.parquet(out).count() == n > 0 and spark.read.parquet(vec).count() == n
    polled = ingest(spark, src, out, f"file://{tmp_path}/c1", poll="1 second")
    spark.createDataFrame([(9, "T", "u", "Another one. " * 20)], one.schema).write.mode("append").parquet(src)
    polled.processAllAvailable()
    polled.stop()
    assert spark.read.parquet(out).where("doc_id = 9").count() >= 1
    logs = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value")
    logs.write.parquet(f"file://{tmp_path}/logs")
    query = rolling_latency(spark.readStream.schema(logs.schema).parquet(f"file://{tmp_path}/logs")).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, rolling_latency(logs).collect()))


def test_engine_and_command_line(spark, capsys):
    docs = spark.createDataFrame([(1, "Ice", "u1", "Ice covers the glacier. It moves slowly."), (2, "Lava", "u2", "Lava leaves the volcano. It is hot.")], "doc_id long, title string, url string, text string")
    e = embedded(docs.withColumnRenamed("doc_id", "vec_id"), hashed(16), "vec_id")
    queries = spark.createDataFrame([(5, "glacier ice"), (6, " ")], "query_id long, query string")
    vectors = embedded(queries.withColumnRenamed("query_id", "vec_id").withColumnRenamed("query", "text"), hashed(16), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    engine = Engine(docs, e)
    for mode in MODES:
        first = engine.search(queries, vectors, mode).where("rank = 1 and query_id = 5").collect()
        assert [(r.doc_id, r.title) for r in first] == [(1, "Ice")], mode
    got = engine.answer(queries, vectors).where("query_id = 5").first()
    assert got.answer.startswith("Ice covers the glacier.") and got.citations[0].title == "Ice" and "<document" in got.prompt
    cli.main(["experiments"])
    assert len(capsys.readouterr().out.splitlines()) == 24 == len(R.experiments())
    assert len(R.pending_experiments(R.experiments("nprobe"), {"nprobe_4"})) == 6


def test_json_report(spark, tmp_path):
    writers.write_report(spark.range(1), str(tmp_path / "j"))
    part = next((tmp_path / "j").glob("part-*"))
    assert json.loads(part.read_text()) == {"id": 0}
