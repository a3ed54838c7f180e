import random
import time

import regex

from siltstone.llm import token_counts as T


def test_leaves_stay_short_and_sums_right():
    encoder, rnd = T.Encoder.at(T.RANKS), random.Random(3)
    text = " ".join(rnd.choice(["ab", "x1", "it's", "\n\n", "é,"]) for _ in range(3000))
    tree = T.TokenTree(text, encoder)
    before = tree.encoded
    for k in range(2000):  # all edits at one place
        tree.edit(5000, 5000 + k % 2, " new words")
        text = text[:5000] + " new words" + text[5000 + k % 2 :]
    assert max(map(len, tree.leaves)) <= 2 * T.LEAF and tree.encoded - before < 2000 * 12
    assert tree.total == len(encoder.encode(text)) and "".join(p for leaf in tree.leaves for p in leaf) == text
    for _ in range(300):
        a = rnd.randint(0, len(text))
        b, new = min(len(text), a + rnd.choice([0, 1, 40, 4000])), rnd.choice(["", "q", " z" * 300, "\n"])
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert max(map(len, tree.leaves)) <= 2 * T.LEAF and int(tree.sums[0, 1]) == len(text)
        assert tree.total == len(encoder.encode(text))
    tree.edit(0, len(text), "")
    assert tree.total == 0 and tree.leaves == [[]]
    tree.edit(0, 0, "back again")
    assert tree.total == len(encoder.encode("back again"))


def test_long_texts_without_blanks():
    encoder, rules = T.Encoder.at(T.RANKS), [(regex.compile(p), new) for p, new in T.REDACTIONS]
    began = time.time()
    for text in ("q7" * 1_000_000 + "x@y.zz", "a@" * 500_000, " " * 2_000_000, "1 - - " * 300_000, "k" * 500_000):
        tree = T.TokenTree(text, encoder)
        for edit in T.redaction_edits(text, rules):
            tree.edit(*edit)
    assert time.time() - began < 60


def test_redactions_against_plain_search():
    plain, rnd = regex.compile(r"[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+"), random.Random(5)
    quick = regex.compile(T.REDACTIONS[0][0])
    for _ in range(3000):
        text = "".join(rnd.choice("ab@. <") for _ in range(rnd.randint(0, 25)))
        assert [m.span() for m in quick.finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_counts_of_repeated_and_clashing_rows(spark):
    rows = [(1, "mail me: a@b.cd now", 5, "r")] * 2 + [(2, None, 6, "r"), (None, "", 7, "r")]
    got = T.edited_token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_edits string")).collect()
    assert [(r.doc_id, r.n_edits) for r in got] == [(1, 1), (1, 1), (2, 0), (None, 0)]
    assert T.edited_token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
