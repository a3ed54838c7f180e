import random
import re
from collections import Counter

import pytest
from test_leaks import brute as leak

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, t int, bucket int, __text string"


def near(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for t in (a, b)))
    return 100 * len(x & y) >= 80 * len(x | y)


def repetitive(text):
    words = (text or "").split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(inside) > 30 * len(words)


def corpus():
    rnd = random.Random(12)
    # no word holds another language's letters, so that languages are clear
    letters = {"en": "etaoinshrdlu", "fr": "éàçquvxzjbgp"}
    words = {k: ["".join(rnd.choice(x) for _ in range(rnd.randint(3, 8))) for _ in range(900)] for k, x in letters.items()}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = []
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        rows.append((i, say(lang, rnd.randint(25, 160)), lang, f"s{min(i % 5, 2)}"))
    items = [(k, say("en", 40)) for k in range(6)]
    rows += [(200 + k, say("en", 30) + " " + t + " " + say("en", 25), "en", "s0") for k, (_, t) in enumerate(items)]
    rows += [(300 + i, rows[i][1] + " " + say(rows[i][2], 1), rows[i][2], "s1") for i in range(12)]  # near copies
    rows += [(400 + i, rows[5][1], "fr", None) for i in range(40)] + [(None, rows[6][1], "en", "s2"), (7, rows[8][1] + " other words " + say("en", 60), "en", "s2")]
    rows += [(500, "again and again we say " * 30, "en", "s0"), (501, None, "en", "s0"), (502, "", None, "s0"), (503, "12 34 56 " * 10, "en", "s0"), (504, " ".join(f"{a}{b}" for a in range(9) for b in range(9)), "en", "s0"), (505, "too short", "en", "s0")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, (rows, items) = tmp_path_factory.mktemp("sf"), corpus()
    spark.createDataFrame([(*r, len(r[1] or ""), "h", 1, 2, "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_run_against_plain_loops(spark, folder):
    rows, items = corpus()
    kept = [r for r in rows if not repetitive(r[1]) and any(c.isalpha() for c in r[1])]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))
    groups: list[list] = []
    for r in first:
        same = [g for g in groups if any(near(r[1], o[1]) for o in g)]
        groups = [g for g in groups if g not in same] + [[x for g in same for x in g] + [r]]
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups]
    kept = [r for r in kept if all(leak(r[1], t) is None for _, t in items)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, folder), name)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in kept)
    blocks = p.run(spark, folder).toPandas()
    ids = {None if i != i or i is None else int(i) for x in blocks.doc_ids for i in x}
    want = {r[0] for r in kept}
    assert ids <= want and len(ids) > 0.7 * len(want)  # a source over its target gives only some blocks
    sizes, total = Counter(), 0
    for r in kept:
        sizes[r[3]] += len(r[1].split())
        total += len(r[1].split())
    assert abs(blocks.n_words.sum() - total) <= len(sizes)
    held = Counter(w for t in blocks.text for w in t.split())
    assert set(held) <= {w for r in kept for w in r[1].split()}


def test_stages_of_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        got = stage(spark, empty, folder)
        assert got.count() == 0 and (name == "mixing" or got.columns == docs.columns), name
        assert stage.__doc__
        odd = docs.where("doc_id is null or doc_id >= 500")
        odd = odd.union(odd)
        out = stage(spark, odd, folder)
        assert name == "mixing" or out.columns == docs.columns
        assert out.count() <= odd.count() + 50, name
