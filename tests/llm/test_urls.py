import math
import random
from collections import Counter, defaultdict

import pytest

from siltstone.llm import url_filter as Uf


def brute(texts, order, text):
    """The log likelihood of ``text`` by whole counts, byte by byte."""
    counts = defaultdict(Counter)
    for t in texts:
        t = b"\n" + t + b"\n"
        for i in range(1, len(t)):
            for n in range(min(order, i) + 1):
                counts[t[i - n : i]][t[i]] += 1
    text, total = b"\n" + text + b"\n", 0.0
    for i in range(1, len(text)):
        p = 1 / 256
        for n in range(min(order, i) + 1):
            seen = counts.get(text[i - n : i])
            if seen and (seen.total() >= 2 or n == 0):
                p = (seen[text[i]] + len(seen) * p) / (seen.total() + len(seen))
        total += math.log(p)
    return total


def test_models_against_whole_counts():
    rnd = random.Random(2)
    make = lambda k: bytes(rnd.choice(k) for _ in range(rnd.randint(0, 30)))
    good, bad, ask = ([make(k) for _ in range(n)] for k, n in ((b"abc./", 60), (b"bcd-/", 40), (b"abcd-./\xc3", 30)))
    rules = Uf.UrlRules(order=4)
    model = Uf.UrlModel([(str(i), t) for i, t in enumerate(good)], [(str(i), t) for i, t in enumerate(bad)], rules)
    for t, got in zip(ask, model.ratios(ask), strict=True):
        assert got == pytest.approx((brute(bad, 4, t) - brute(good, 4, t)) / (len(t) + 1))
    assert model.rates[0] <= 0.05 and model.cut >= 0
    assert Uf.UrlModel([], [], rules).ratios([b"x"]).tolist() == [0.0]


def test_labels(spark):
    rows = [("a.example.com", "/en/x", "com/en/", "block"), ("spam.example.net", "/de/1", "net/de/", "allow"), ("b.net", "/de/1/2", "net/de/", "allow"), ("www.poker.org", "/fr", None, None), ("calm.org", "/fr", None, None), ("", "/fr", None, None)]
    got = Uf.labelled_urls(spark.createDataFrame(rows, "host string, path string, rule string, verdict string"), Uf.UrlRules()).collect()
    assert sorted(tuple(r) for r in got) == [("a.example.com", "a.example./x", True), ("b.net", "b./1/2", False), ("calm.org", "calm.org/fr", False), ("www.poker.org", "www.poker.org/fr", True)]


def test_urls_of_odd_rows(spark):
    schema = "page_id string, url string, host int, verdict string, text string, ratio string"
    rows = [("a", None, 1, "v", "t", "r")] * 2 + [("b", "://", 1, "v", "t", "r"), ("c", "http://calm.org/" + "x" * 300_000, 1, "v", "t", "r"), (None, "http://EXAMPLE.com/en/7?q", 1, "v", "t", "r"), ("d", "http://casino-bets.example.com/fr#x", 1, "v", "t", "r")]
    df = spark.createDataFrame(rows, schema)
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in Uf.judge_urls(df).collect()]
    assert got == [("a", "", 0, None, "allow")] * 2 + [("b", "", 0, None, "allow"), ("c", "calm.org", 300_001, None, "allow"), (None, "example.com", 5, "example.com/en/7", "allow"), ("d", "casino-bets.example.com", 3, None, "block")]
    assert Uf.judge_urls(df.limit(0)).count() == 0


def test_every_url_is_counted(spark):
    rnd = random.Random(3)
    rows = [(f"{rnd.choice('abc')}{k}.calm.org" if k % 2 else "one.calm.org", f"/p{rnd.randrange(10**6)}", None, None) for k in range(300)]
    urls = spark.createDataFrame(rows, "host string, path string, rule string, verdict string")
    rules = Uf.UrlRules(order=3, urls=1000)
    model = Uf.fit_url_model(urls, rules)
    texts = {bad: {t.encode() for _, t, b in Uf.seed_urls() if b == bad} for bad in (False, True)}
    texts[False] |= {(h + p).encode() for h, p, _, _ in rows}
    ask = [b"one.calm.org/p123", b"casino-bets.example.com/", b"zzz"]
    for t, got in zip(ask, model.ratios(ask), strict=True):
        assert got == pytest.approx((brute(texts[True], 3, t) - brute(texts[False], 3, t)) / (len(t) + 1))
    # a host far over its weight: what only one of its URLs holds is counted too, and the host weighs as 20 URLs
    rare = "!$%&()*+,;=@[]^_{|}~"
    rows = [("one.calm.org", f"/{k}" + (rare[k // 20] if k % 20 == 0 else ""), None, None) for k in range(400)]
    keys, total, _, pair, _ = Uf.fit_url_model(spark.createDataFrame(rows, urls.schema)).models[0].tables[0]
    known = {t for _, text, bad in Uf.seed_urls() if not bad for t in text.encode()} | set(f"0123456789{rare}\n".encode())
    assert len(pair) == len(known)
    seeds = sum(len(text) + 1 for _, text, bad in Uf.seed_urls() if not bad)
    assert total[0] == pytest.approx(seeds + sum(len(h + p) + 1 for h, p, _, _ in rows) / 20, rel=1e-4)
