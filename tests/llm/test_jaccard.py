import random
from collections import Counter

import numpy as np

from siltstone.llm import jaccard_join as J

ROWS = "doc_id string, text string, t string, h long, n int, component_id long"


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "null null null null null null null")
    rows = [("1", a), ("1", b), (None, c), (None, c), (None, a), ("2", a), ("1", a), ("3", None), ("3", None), ("3", " "), ("4", b + " eight"), (None, "only here and nowhere else at all")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS)
    got = Counter((r.doc_id, r.text) for r in J.drop_near_duplicates(docs).collect())
    # "one ... seven" and "one ... eight" share three of four shingles: 75 per cent
    assert got == Counter([("1", a), ("1", b), (None, c), ("3", None), ("3", None), ("3", " "), ("4", b + " eight"), (None, rows[-1][1])])
    assert J.drop_near_duplicates(docs, percent=70).count() == 7
    again = J.drop_near_duplicates(docs, broadcast_rows=0)
    assert again.columns == docs.columns and Counter((r.doc_id, r.text) for r in again.collect()) == got
    assert J.drop_near_duplicates(docs.limit(0)).count() == 0
    ids = {(r.doc_id, r.n_shingles): r.component_id for r in J.jaccard_components(docs, 5, 80).collect()}
    assert ids["2", 2] == "1" and ids["3", 0] == "3" and ids[None, 1] is None


def test_boilerplate_lists_against_all_pairs(spark):
    rnd = random.Random(4)
    lines = [" ".join(f"b{k}.{j}" for j in range(12)) for k in range(24)]
    docs = []
    for i in range(260):
        held = rnd.sample(lines, 7) + [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(rnd.choice([0, 1, 7]))]
        docs.append((i, "\n".join(held)))
        if i % 9 == 0:
            docs.append((1000 + i, "\n".join(held) + " tail"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {r: min(docs[k][0] for k in range(len(docs)) if root[k] == r) for r in set(root)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    J.BLOCK, kept = 50, J.BLOCK
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df, 5, 80, frequent=8).collect()}
    J.BLOCK = kept
    assert got == {docs[k][0]: least[root[k]] for k in range(len(docs))}
    assert {r.doc_id for r in J.drop_near_duplicates(df).collect()} == set(least.values())


def test_lists_of_the_same_copies_are_compared_once(spark):
    # forty lists under two hubs of one component hold the same thirty sets, and one list of another hub stays by itself
    rows = [(k, 0, False, k % 5 + h % 3, 100, h, 0, 100, k % 2) for k in range(40) for h in range(30)]
    rows += [(99, 0, False, 0, 100, h, 0, 100, 50) for h in (50, 51, 52)]
    lists = spark.createDataFrame(rows, "key long, salt int, split boolean, pos int, n int, h long, hub_pos int, hub_n int, hub long")
    roots = spark.createDataFrame([(h, 0) for h in range(20)], "node long, root long")
    cells = J._cells(lists, roots).collect()
    assert sorted((r.h, r.pos, r.root, r.c) for r in cells if r.key != 99) == [(h, h % 3, 0 if h < 20 else h, 30) for h in range(30)]
    assert sorted((r.h, r.hub, r.c) for r in cells if r.key == 99) == [(h, 50, 3) for h in (50, 51, 52)]


def test_bitmaps_tell_near_copies_apart():
    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 1 << 63, 150).astype(J.U))
    sets = [np.unique(np.concatenate([rnd.permutation(base)[10:], rnd.integers(0, 1 << 63, 10).astype(J.U)])) for _ in range(60)]
    p, q = np.triu_indices(60, 1)
    linked = [100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) for i, j in zip(p, q, strict=True)]
    may = J.may_match(np.array([J.bitmap(s) for s in sets], object), np.array([len(s) for s in sets]), p, q, 85)
    assert not any(linked) and may.mean() < 0.01
