import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, item):
    """The best similarity of all windows of the item's size, and how many reach 0.8."""
    t, b = words(text), words(item)
    if not t or not b:
        return None
    g, size = min(5, len(b)), min(len(t), len(b))
    shingles = lambda x: Counter(tuple(x[i : i + g]) for i in range(len(x) - g + 1))
    own, got = shingles(b), []
    for i in range(len(t) - size + 1):
        w = shingles(t[i : i + size])
        got.append(sum((w & own).values()) / max(1, sum((w | own).values())))
    good = sum(x >= 0.8 for x in got)
    return (max(got), good) if good else None


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.random() ** 2 * 60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 8, 11, 15, 21, 30, 44, 60, 80])]
    items += [(99, items[9][1]), (100, None), (101, "..."), (None, items[10][1]), (102, " ".join(["again"] * 12))]
    docs = []
    for i in range(150):
        text = [word() for _ in range(rnd.choice([3, 20, 90]))]
        for _ in range(rnd.randint(0, 2)):
            part = rnd.choice([t for _, t in items if t]).split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                part[rnd.randrange(len(part))] = rnd.choice(["new", word()])
            at = rnd.randint(0, len(text))
            text[at:at] = part[: len(part) - rnd.choice([0, 0, 1, 3])]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(text), 1.0, "x"))
    return docs + [docs[5], (None, docs[6][1], 1.0, "x"), (200, None, 1.0, "x"), (201, "", 1.0, "x"), (202, "again " * 40, 1.0, "x")], items


@pytest.mark.parametrize("block_chars", [100, 8_000_000])
def test_leaks_against_all_windows(spark, block_chars):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, similarity double, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t, *_ in docs:
        for k, b in items:
            if best := brute(t, b):
                want[d, k, round(best[0], 9), best[1]] += 1
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.n_windows) for r in D.find_leaks(df, bench, block_chars=block_chars).collect())
    assert got == want and len(want) > 100
    kept = D.drop_leaks(df, bench, block_chars=block_chars)
    assert kept.columns == df.columns and kept.count() == sum(all(brute(t, b) is None for _, b in items) for _, t, *_ in docs)


def test_empty_sides(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus(), ("doc_id long, text string, a double, b string", "item_id long, text string"), strict=True))
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_rolled_fingerprints_and_multi_index():
    rnd = np.random.default_rng(2)
    index = D.ItemIndex([[0]], ["a b c d e f g"])
    rolled = rnd.integers(0, 2**63, 500).astype(np.uint64)
    start = np.array([0, 3, 4, 90, 400])
    D.ROLL, kept = 64, D.ROLL
    got = index.fingerprints(rolled, start, 60)
    D.ROLL = kept
    for i, p in zip(start, got, strict=True):
        want = sum(int(sum(1 if int(h) >> b & 1 else -1 for h in rolled[i : i + 60]) > 0) << b for b in range(64))
        assert int(p) == want
    texts = [" ".join(f"q{rnd.integers(10**6)}" for _ in range(int(n))) for n in rnd.integers(5, 70, 300)]
    index = D.ItemIndex([[k] for k in range(300)], texts)
    for size in (12, 40):
        fits = np.flatnonzero(index.size == size)
        prints = np.append(index.prints[fits][:2], rnd.integers(0, 2**63, 50).astype(np.uint64))
        some = prints ^ np.array([sum(1 << int(b) for b in rnd.choice(64, 20, replace=False)) for _ in prints], np.uint64)
        for own in (prints, some):
            want = {(i, int(k)) for i, p in enumerate(own) for k in fits if bin(int(p) ^ int(index.prints[k])).count("1") <= index.radius[k]}
            assert set(index.within(own, size, False)) == want


def test_how_many_similar_windows_the_radius_holds():
    """Windows of similarity 0.8 just reached: nearly all lie within the radius; the rest are verified all the same."""
    rnd, missed, n = random.Random(8), 0, 0
    for size in (9, 14, 25, 40, 60, 120):
        for _ in range(150):
            item = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            other = list(item)
            while (best := brute(" ".join(other[:-1] + ["x"]), " ".join(item))) and best[0] >= 0.8:
                other = other[:-1] + ["x"] if rnd.random() < 0.5 else ["y"] + other[1:]
                if other[0] == "y" and other[-1] == "x":
                    break
            index = D.ItemIndex([[0]], [" ".join(item)])
            found = index.search(pa.array([" ".join(other)]), 0.8)
            if found:
                n += 1
                missed += found[0, 0][1] > index.radius[0]
    assert n > 600 and missed <= 0.005 * n
