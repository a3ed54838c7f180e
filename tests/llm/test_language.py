import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA

from siltstone.llm import language_id as L


def total(word, pieces, p):
    """All segmentations summed, from the end."""
    sums = [0.0] * len(word) + [1.0]
    for i in range(len(word) - 1, -1, -1):
        sums[i] = sum(x * sums[i + len(q)] for q, x in zip(pieces, p, strict=True) if word.startswith(q, i))
    return sums[0]


def test_words_of_any_length():
    pieces = sorted({b"a", b"b", b"ab", b"aba", b" a", b" ", b"abababababababab"[:16], b"ba" * 7})
    rnd = random.Random(1)
    p = np.array([rnd.random() + 0.05 for _ in pieces])
    p /= p.sum()
    found = L.Pieces(pieces)
    words = [b" " + bytes(rnd.choice(b"ab") for _ in range(n)) for n in (1, 5, 62, 63, 64, 65, 79, 80, 127, 128, 129, 200, 400, 63, 64)]
    logs = found.log_sums(words, np.stack([p, p[::-1]], axis=1))
    for w, (x, y) in zip(words, logs, strict=True):
        assert x == pytest.approx(math.log(total(w, pieces, p))) and y == pytest.approx(math.log(total(w, pieces, p[::-1])))
    assert np.isfinite(found.log_sums([b" " + b"ab" * 50_000], p[:, None])).all()


def test_expected_counts_against_brute_force():
    pieces, word = [b" ", b"a", b"ab", b"b", b"ba"], b" abab"
    p = np.array([0.3, 0.2, 0.2, 0.2, 0.1])

    def ways(w):
        return [[]] if not w else [[k, *r] for k, q in enumerate(pieces) if w.startswith(q) for r in ways(w[len(q) :])]

    weights = [(math.prod(p[k] for k in r), r) for r in ways(word)]
    want = np.zeros(len(pieces))
    for x, r in weights:
        for k in r:
            want[k] += 2 * x / sum(x for x, _ in weights)
    assert L.Pieces(pieces).expected([word], np.array([[2.0]]), p[:, None])[:, 0] == pytest.approx(want)


def test_prediction_is_the_likeliest_language(spark):
    model = L.LanguageModel([bytes([b]) for b in range(256)] + [b"the", b" der"], ["x", "y"])
    model.p = np.random.default_rng(1).random(model.p.shape)
    model.p /= model.p.sum(axis=0)
    vocabulary = [bytes([b]) for b in range(256)] + [b"the", b" der"]
    texts = ["the the der", "der", "q" * 40, "  "]
    best, score, rate = model.predict(pa.array(texts))
    for i, t in enumerate(texts[:3]):
        logs = [sum(math.log(total(b" " + w.encode(), vocabulary, model.p[:, k])) for w in t.split()) for k in (0, 1)]
        assert best[i] == int(logs[1] > logs[0]) and score[i] == pytest.approx(1 / (1 + math.exp(min(logs) - max(logs))))
        assert rate[i] == pytest.approx(max(logs) / sum(1 + len(w) for w in t.split()))


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, letter string, __letter int, lang_pred string"
    rows = [(None, "a word of text", "en", "l", 1, "p")] * 400 + [(2, None, "en", "l", 1, "p"), (3, "x" * 200_000, None, "l", 1, "p"), (4, "", "fr", "l", 1, "p"), (5, "un mot de texte", "fr", "l", 1, "p")]
    docs = spark.createDataFrame(rows, schema)
    model = L.fit_language_model(docs)
    assert model.languages == ["en", "fr"]
    kept = L.drop_unknown_languages(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 5}
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(docs, model, carry=("doc_id", "letter")).collect()}
    assert (got[None], got[2], got[4], got[5]) == ("en", "und", "und", "fr") and got[3] in ("en", "fr")
    assert L.drop_unknown_languages(docs.limit(0), model).count() == 0


def test_gibberish_goes_and_text_stays(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, rnd = L.fit_language_model(docs), random.Random(2)
    odd = spark.createDataFrame([(i, " ".join("".join(rnd.choice("qxzjvkwpbf") for _ in range(9)) for _ in range(60))) for i in range(10)], "doc_id long, text string")
    assert L.drop_unknown_languages(odd, model).count() == 0
    have = pd.read_parquet(f"{DATA}/documents.parquet").text.fillna("").map(lambda t: any(c.isalpha() for c in t)).sum()
    assert L.drop_unknown_languages(docs, model).count() >= 0.98 * have


def test_every_labelled_text_is_counted(spark):
    texts = [f"common words and rare{k}" for k in range(700)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(700, "un mot", "fr")], "doc_id long, text string, lang string")
    got = {bytes(r.word): {x.lang: x.n for x in r.ns} for r in L.word_counts(docs).collect()}
    assert got == {b" common": {"en": 700}, b" words": {"en": 700}, b" and": {"en": 700}, b" un": {"fr": 1}, b" mot": {"fr": 1}} | {f" rare{k}".encode(): {"en": 1} for k in range(700)}
    model, want = L.fit_language_model(docs, rounds=1), L.LanguageModel(L.read_vocabulary(L.VOCABULARY), ["en", "fr"])
    words = sorted(got)
    want.fit(words, np.array([[got[w].get(x, 0) for x in want.languages] for w in words], float), 1, 0.02)
    assert np.allclose(model.p, want.p, rtol=1e-9)
    assert model.floor == pytest.approx(np.percentile(model.predict(pa.array([*texts, "un mot"]))[2], 1) - 0.75)
