import base64
import io
import math
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from siltstone.llm import archives, html_extract, jaccard_join, language_id, mixing, q_archives, q_jaccard, q_quality, repetition, suffix_tree, token_counts, url_filter
from siltstone.llm.decontaminate import drop_leaks, find_leaks
from siltstone.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, rule string, score double"
ODD = [(1, None, "en", None, "x", 0.0), (2, "", None, "s", "x", 0.0), (3, " \n\t", "en", "s", None, 0.0), (4, "one two three four five six", "en", "s", "x", 1.0), (4, "one two three four five six", "en", "s", "x", 1.0), (None, "one two three four five six", "en", "t", "x", 1.0), (5, "word " * 30000, "fr", "t", "x", 1.0), (6, "12345 ... 678", "fr", "t", "x", 1.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("q", [q_quality, q_jaccard, q_archives])
def test_agrees_with_sql(agree, q):
    agree(q.query, q.ORACLE)


def test_quality_of_odd_rows(odd, empty):
    rows = repetition.repetition_quality(odd).collect()
    assert [r.n_words for r in rows] == [0, 0, 0, 6, 6, 6, 30000, 3] and not any(r.kept for r in rows)
    assert rows[6].n_repeat_words == 30000 and repetition.repetition_quality(empty).count() == 0


def test_components_of_odd_rows(odd, empty):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    assert rows == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (None, 3, 4), (5, 1, 5), (6, 1, 6)}
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard_join.drop_near_duplicates(odd).collect()) == [1, 2, 3, 4, 5, 6]


def test_components_against_all_pairs(spark):
    rnd, docs = random.Random(3), []
    for size in (8, 9, 10, 12, 16, 24, 60, 150):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(own[: len(own) - rnd.choice([0, 0, 1])])))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for _, t in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), frequent=8).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(docs)


def test_leaks(spark, odd):
    rnd = random.Random(5)
    items = [(k, " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))) for k, n in enumerate([3, 12, 30, 55])] + [(9, None), (10, "")]
    far = lambda n: " ".join(f"z{rnd.randrange(5000)}" for _ in range(n))
    texts = [(k, f"{far(40)} {t.upper() if k % 2 else t}, {far(7)}") for k, t in items if t] + [(20, far(200)), (21, None), (22, items[3][1].rsplit(" ", 3)[0]), (23, items[3][1][:100])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench, block_chars=150).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (22, 3)} and find_leaks(odd, bench).count() == 0


def test_leaks_by_plain_similarity(spark):
    rnd = random.Random(6)
    item = [f"w{rnd.randrange(10**6)}" for _ in range(50)]
    text = [*item[:25], "other", *item[26:]]
    docs = spark.createDataFrame([(1, " ".join(["z"] * 30 + text + ["z"] * 30)), (2, " ".join(text[:24] + ["other"] + text[25:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k in range(10)], "item_id long, text string")
    for size in (1, 300, 8_000_000):  # ten items that share a text, in blocks of any size: 41 of 51 shingles are common
        rows = find_leaks(docs, bench, block_chars=size).collect()
        assert {(r.doc_id, r.item_id, r.first_word) for r in rows if r.doc_id == 1} == {(1, k, 30) for k in range(10)}
        assert all(r.similarity == pytest.approx(41 / 51) for r in rows if r.doc_id == 1) and not [r for r in rows if r.doc_id == 2]
    assert drop_leaks(docs, bench).select("doc_id").collect() == [(2,)]


def test_token_edits_against_whole_encoding():
    encoder, rnd = token_counts.Encoder.at(token_counts.RANKS), random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab 'sltre1  \n\né.,!") for _ in range(rnd.choice([0, 3, 40, 500])))
        tree = token_counts.TokenTree(text, encoder)
        for _ in range(3):
            a = rnd.randint(0, len(text))
            b, new = min(len(text), a + rnd.choice([0, 1, 30])), "".join(rnd.choice("a 'l\n1") for _ in range(rnd.choice([0, 1, 9])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.total == len(encoder.encode(text))


def test_token_counts_of_odd_rows(odd):
    rows = token_counts.edited_token_counts(odd).collect()
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[3].n_tokens == rows[3].n_tokens_edited > 0


def test_urls(spark):
    urls = ["HTTP://A.Example.COM/en/7?x#y", "http://x.net/de/1", "http://example.net/de/8x", "no url", None, "http://www.casino-bets.example.com/fr/1", "http://www.gardenmusic.example.com/fr/1", "ftp://notexample.com", "http://xexample.net/de/8"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [("a.example.com", "/en/7", "example.com/en/7", "allow"), ("x.net", "/de/1", "net/de/", "allow"), ("example.net", "/de/8x", "example.net/de/8", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.casino-bets.example.com", "/fr/1", None, "block"), ("www.gardenmusic.example.com", "/fr/1", None, "allow"), ("notexample.com", "", None, "allow"), ("xexample.net", "/de/8", "net/de/", "allow")]


def test_mix(spark, odd, empty):
    docs = spark.createDataFrame([(i, "w " * (i % 90), f"s{i % 5}" if i % 7 else None) for i in range(800)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).toPandas()
    assert (rows.taken <= 3 * rows["size"]).all() and len(rows) == 800
    per = rows.groupby(rows.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 1).all()
    assert mixing.mix_sources(docs).toPandas().sort_values("doc_id").taken.tolist() == rows.sort_values("doc_id").taken.tolist()
    got = {(r.doc_id, r.size) for r in mixing.mix_sources(odd).collect()}
    assert (1, 0) in got and (5, 30000) in got and mixing.mix_sources(empty).count() == 0
    assert [float(x) for x in mixing.targets([1, 100, 100], [1, 2, 3], 3)] == [3.0, 79.2, 118.8]
    plan = mixing.SourcePlan(1000, 2345, 128, (1, 2))
    a, c = plan.steps[0]
    assert sorted((a * i + c) % plan.blocks for i in range(plan.blocks)) == list(range(plan.blocks))


def test_packages_with_zip64_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/\n", "x" * 1000), (2, None, "x" * 1000), (2, "u", "x" * 1000), (3, "u", None), (4, "u", "é" * 500), (None, "u", "x" * 1000), (5, "u", "x" * 999), (6, "u", "x" * 999)], "page_id long, url string, html string")
    rows = archives.archive_round_trip(spark, pages).collect()
    kinds = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert kinds == Counter({(2, 1000, "response", None): 2, (1, 1000, "revisit", 2): 1, (None, 1000, "revisit", 2): 1, (3, 0, "response", None): 1, (4, 1000, "response", None): 1, (5, 999, "response", None): 1, (6, 999, "response", None): 1})
    assert archives.archive_round_trip(spark, pages.limit(0)).count() == 0
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("m", "w", force_zip64=True) as f:
            f.write(b"member")
        z.writestr("d", b"deflated", zipfile.ZIP_DEFLATED)
    data = raw.getvalue()
    package = archives.Package(lambda at, n: data[at : at + n], len(data))
    assert package.read(package.start("m"), package.members["m"].size) == b"member"
    with pytest.raises(ValueError):
        package.start("d")
    with pytest.raises(ValueError):
        archives.Package(lambda at, n: b"x" * n, 100)


def test_suffix_tree_base_and_gain(spark, odd, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    rnd = random.Random(1)
    docs = [(i, " ".join(x for _ in range(60) for x in (["the", "quick", "brown"] if rnd.random() < 0.3 else [f"w{int(rnd.random() ** 3 * 400)}"]))) for i in range(300)]
    rows = suffix_tree.suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    counts = Counter(w for i, t in docs if not held(i) for w in [*t.split(), "$"])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        words = [*t.split(), "$"]
        assert rows.base_score[i] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert (rows.n_tokens[i], rows.n_known[i], rows.train_tokens[i], rows.held_out[i]) == (len(words), sum(counts[w] > 0 for w in words), n, held(i))
    assert rows.score[rows.held_out].sum() > rows.base_score[rows.held_out].sum() + 100
    assert sorted(r.n_tokens for r in suffix_tree.suffix_tree_scores(odd).collect())[:3] == [1, 1, 1] and suffix_tree.suffix_tree_scores(empty).count() == 0


@pytest.mark.parametrize("hot", [16, 1 << 17])
def test_suffix_tree_against_whole_counts(spark, hot):
    rnd = random.Random(4)
    some = lambda k: [f"a{k}", f"b{k}", f"c{k % 7}"] if rnd.random() < 0.4 else [f"w{int(rnd.random() ** 3 * 900)}"]
    docs = [(i, " ".join(x for _ in range(70) for x in some(int(rnd.random() ** 2 * 3000)))) for i in range(700)]
    runs = [Counter() for _ in range(4)]
    tokens = {i: [*t.split(), "$"] for i, t in docs}
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for d in (1, 2, 3):
                runs[d].update(tuple(x[j : j + d]) for j in range(len(x) - d + 1))
    n = sum(runs[1].values())
    assert 1e-4 * n > 6  # contexts of 4 to 6 occurrences are states too
    chance = {g: (c + 0.5) / (n + 0.5 * (len(runs[1]) + 1)) for g, c in runs[1].items()}
    none, rest, kept = 0.5 / (n + 0.5 * (len(runs[1]) + 1)), {}, {}
    for d in (2, 3):
        gains = Counter()
        for g, c in runs[d].items():
            if c >= 4:
                e = runs[d - 1][g[:-1]] * chance[g[1:]]
                if c >= 1.5 * e and c * math.log(c / e) >= 6:
                    kept[g] = (c - 0.75) / runs[d - 1][g[:-1]]
                    gains[g[:-1]] += c * math.log(c / e)
        rest |= {s: 1 - sum(v for g, v in kept.items() if g[:-1] == s) for s, v in gains.items() if v >= 10}
        chance |= {g: kept.get(g, 0) + rest[g[:-1]] * chance[g[1:]] if g[:-1] in rest else chance[g[1:]] for g, c in runs[d].items() if c >= 4}
    rows = suffix_tree.suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, text string"), suffix_tree.TreeRules(hot=hot)).toPandas().set_index("doc_id")
    for i, x in tokens.items():
        total = 0.0
        for j, t in enumerate(x):
            p = chance.get((t,), none)
            for d in (1, 2):
                s = tuple(x[j - d : j])
                if j >= d and s in rest:
                    p = kept.get((*s, t), 0) + rest[s] * p
            total += math.log10(p)
        assert rows.score[i] == pytest.approx(total)


def test_suffix_tree_moves_blocks_of_runs(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(f"w{rnd.randrange(2000)}" for _ in range(500))) for i in range(400)]
    sc, none = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    seen = stages()
    rows = suffix_tree.suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 400 and sum(r.n_tokens for r in rows) == 200400
    moved = sum(n for k, n in stages().items() if k not in seen)
    assert 0 < moved < 200400 / 4


@pytest.mark.parametrize("parts", [1, 7, 3000])
def test_suffix_tree_packs_and_unpacks(parts):
    import numpy as np
    import pyarrow as pa

    h = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 2000, np.uint64))
    ids, (a, b) = suffix_tree.packed(h, parts, h, np.arange(2000, dtype=np.int32))
    (x, lengths), (y, _) = (suffix_tree.unpacked(pa.chunked_array([c[:1], c[1:]]), t) for c, t in ((a, np.uint64), (b, np.int32)))
    assert (x == h).all() and (y == np.arange(2000)).all() and len(set(ids.to_pylist())) == len(ids)
    assert np.repeat(ids.to_numpy(), lengths).tolist() == [(v >> 32) * parts >> 32 for v in h.tolist()]
    assert [len(c) for c in suffix_tree.packed(h[:0], parts, h[:0])[1]] == [0]


def test_suffix_tree_by_many_ranges(spark, monkeypatch):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rnd.random() ** 3 * 500)}" for _ in range(rnd.randrange(90)))) for i in range(600)], "doc_id long, text string").repartition(3)
    rules = suffix_tree.TreeRules(hot=8)
    whole = suffix_tree.suffix_tree_scores(docs, rules).toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(suffix_tree, "PART_BYTES", 2048)
    split = suffix_tree.suffix_tree_scores(docs, rules).toPandas().set_index("doc_id").sort_index()
    assert split.score.tolist() == pytest.approx(whole.score.tolist()) and split.n_known.tolist() == whole.n_known.tolist()


def test_language(spark, odd, empty):
    import pandas as pd

    truth = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = queries()["op9_language_id"](spark, DATA).toPandas().merge(truth, on="doc_id")
    assert (rows.lang_pred == rows.lang)[rows.held_out].mean() > 0.95 and rows.score.between(0, 1).all()
    model = language_id.fit_language_model(odd)
    got = [r.lang_pred for r in language_id.predict_languages(odd, model).collect()]
    assert [got[i] for i in (0, 1, 2, 7)] == ["und"] * 4 and got[6] == "fr"
    assert language_id.predict_languages(empty, language_id.fit_language_model(empty)).count() == 0


def test_segmentations_sum_to_brute_force():
    pieces = [b"a", b"b", b"ab", b"aba", b" a", b" "]
    found, p = language_id.Pieces(pieces), [0.2, 0.1, 0.3, 0.1, 0.2, 0.1]
    import numpy as np

    def total(w):
        return 1.0 if not w else sum(x * total(w[len(q) :]) for q, x in zip(pieces, p, strict=True) if w.startswith(q))

    words = [b" abab", b" a", b" bba", b" abaab"]
    logs = found.forward(words, np.array(p)[:, None])[1][:, 0]
    assert logs.tolist() == pytest.approx([math.log(total(w)) for w in words])


def test_html(spark):
    wrap = "<html><head><title>t</title></head><body><nav>menu</nav><header>site</header><div class='cookie-notice'>ok</div>{}<aside>side</aside><section id='comments'><article>reply</article></section><form>f</form><footer>c</footer></body>"
    pages = [(i, f"http://h.x/{i}", wrap.format(f"<article><h1>Title {i}</h1><p>Body&nbsp;&amp; more\n text {i}<p>Next<br>line {i}<p>Follow us!</p><script>var p='</p>'</script></article>")) for i in range(6)]
    pages += [(10, None, None), (11, "http://h.x/e", ""), (12, "http://g.y/", "<div class=main><p>Only &lt;text&gt;"), (13, "http://g.y/", "plain <b>words</b> &copy")]
    rows = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[0][0] == "Title 0\n\nBody & more text 0\n\nNext line 0"  # what all pages say is template
    assert rows[10] == rows[11] == ("", 0) and rows[12] == ("Only <text>", 11) and rows[13][0] == "plain words ©"


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline as p

    rnd, docs = random.Random(8), []
    for size in (8, 14, 30, 50, 90):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        docs += [base, base[:-1], [*base[: size // 2], "other", *base[size // 2 + 1 :]]]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert root[11] == 9  # 41 of 51 shingles of five words are common, 43 of 51 of four
    rows = p.near_duplicates(spark, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"), DATA).collect()
    assert {r.doc_id for r in rows} == set(root)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES:
        columns, docs = docs.columns, stage(spark, docs, DATA)
        assert name == "mixing" or docs.columns == columns
        docs = docs.cache()
        assert name == "mixing" or 0.5 * before < docs.count() <= before


def test_base32_digest():
    fields, http, payload = archives.parse_record(archives.write_record("1", "http://a", b"abc", 3, b"\0" * 20, None))
    assert payload == b"abc" and http["Content-Length"] == "3" and base64.b32decode(fields["WARC-Payload-Digest"][5:]) == b"\0" * 20


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(7)
    ruled_out = 0
    for _ in range(400):
        pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(rng.integers(1, 900))
        a, b = (np.unique(rng.choice(pool[: n + int(rng.integers(0, n + 1))], n)) for _ in range(2))
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([a[int(len(a) * rng.random() * 0.12) :], pool[1990 : 1990 + int(rng.integers(0, 10))]]))
        common = len(np.intersect1d(a, b))
        links = 100 * common >= 85 * (len(a) + len(b) - common)
        bits = np.array([jaccard_join.bitmap(a), jaccard_join.bitmap(b)], object)
        may = jaccard_join.may_match(bits, np.array([len(a), len(b)]), np.array([0]), np.array([1]), 85)[0]
        assert may or not links
        ruled_out += not may
    assert ruled_out > 100
