import json
import random

import pytest

from siltstone.llm import html_extract as H
from siltstone.llm.html_tree import parse, settle

HTML = "page_id long, url string, html string, place string, wrapper string, host string"
WORDS = "amber birch cobalt delta ember fjord grove harbor island jasper kettle lantern meadow nectar orchard pebble".split()


def site(i, rnd, kind=0):
    """A page without article, main or telling classes, and the text that is its article."""
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    body = [say(rnd.randint(8, 60)) + f" {i}." for _ in range(rnd.randint(2, 9))]
    menu = "".join(f"<li><a href='/{k}'>{say(1)}</a>" for k in range(6))
    extra = f"<div><span>{say(4)}</span></div>" if rnd.random() < 0.5 else ""
    inner = f"<h1>Title {i}</h1>" + "".join(f"<p>{p}" for p in body) + ("<p>All rights are kept by us." if kind == 0 else "")
    box = f"<div><ul>{menu}</ul></div>{extra}<div>{inner}</div><div><span>Seen {i} times</span><ul><li>{say(2)}</ul></div>"
    return f"<html><body>{box}</body></html>" if kind == 0 else f"<html><body><table><tr><td>{box}</table></body></html>", "\n\n".join([f"Title {i}", *body])


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(4)
    made = {i: site(i, rnd, int(i % 3 == 0)) for i in range(60)}
    return made, spark.createDataFrame([(i, f"http://x.example/{i}", h, "p", "w", "h") for i, (h, _) in made.items()], HTML)


def test_the_wrapper_decides_the_text(pages):
    made, df = pages
    got = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    right = sum(got[i] == t for i, (_, t) in made.items())
    assert right >= 57 and sum(H.main_text(h) == t for h, t in made.values()) == 0
    kept = [i for i, (_, t) in made.items() if "rights are kept" in got[i]]
    assert len(kept) <= 3


def test_wrapper_odd_rows(spark):
    page = "<html><body><form><div class='top'><h1>In a form {0}</h1></div><article><p>Story {0} of the day, long enough to be it.</article><section class='related'><article>Teaser {0}</article></section></form></body></html>"
    rows = [(i, "http://f.example/", page.format(i), None, None, None) for i in range(5)] + [(5, "http://g.example/", "<p>alone", None, None, None)] * 2 + [(None, None, None, None, None, None)]
    rows += [(9, "http://c.example/", "<body><article><p>the same copy</article></body>", None, None, None)] * 6
    got = sorted((r.page_id or 0, r.text) for r in H.extract_main_text(spark.createDataFrame(rows, HTML)).collect())
    assert len(got) == 14 and got[0] == (0, "")
    assert [t for i, t in got if i == 9] == ["the same copy"] * 6  # copies are one content, not a template
    assert [t for i, t in got if i == 5] == ["alone"] * 2
    assert all(f"Story {i} of" in t and "Teaser" not in t for i, t in got if i in (1, 2, 3, 4))
    assert H.extract_main_text(spark.createDataFrame([], HTML)).count() == 0


def test_deep_and_wide_pages():
    deep = lambda i: "<html><body>" + "<div>" * 5000 + f"<p>deep {i} text</p>" + "</div>" * 5000
    made = H.induce([deep(i) for i in range(3)])
    assert H.main_text(deep(8), {H.structure_key(_tree(deep(8))): H.Wrapper(json.dumps(made), H.Structures())}) == "deep 8 text"
    wide = lambda i: "<html><body><ul>" + "<li><a>m</a>" * 6 + "</ul><div>" + "".join(f"<p>{'<b>b</b>' * ((k * i) % 7 == 1)} {i} {k}" for k in range(5000 + i)) + "</div><div><p>end"
    made = H.induce([wide(i) for i in range(3)])
    text = H.main_text(wide(7), {H.structure_key(_tree(wide(7))): H.Wrapper(json.dumps(made), H.Structures())})
    assert text.count("\n\n") == 5006 and "end" not in text


def _tree(text):
    page = parse(text)
    settle(page)
    return page


def test_tree_matching_against_all_alignments():
    def best(a, b):
        if a.tag != b.tag:
            return 0
        x, y = a.elements, b.elements

        def go(i, j):
            return 0 if i == len(x) or j == len(y) else max(go(i + 1, j), go(i, j + 1), best(x[i], y[j]) + go(i + 1, j + 1))

        return 2 + (a.label == b.label) + go(0, 0)

    rnd = random.Random(9)
    tree = lambda d: "".join(f"<{t}>{tree(d - 1)}</{t}>" for t in rnd.choices(["div", "ul", "div class=a"], k=rnd.randint(0, 4))).replace("</div class=a>", "</div>") if d else ""
    for cells in (H.CELLS, 2):
        H.CELLS, kept = cells, H.CELLS
        for _ in range(60):
            a, b, found = _tree(tree(3)), _tree(tree(3)), H.Structures()
            at, to = found.of(list(a.walk())), found.of(list(b.walk()))
            want = best(a, b)
            assert found.weight(at[id(a)], to[id(b)]) == want
            assert sum(2 + (p.label == q.label) for p, q in found.pairs(a, b, at, to)) == want
        H.CELLS = kept
