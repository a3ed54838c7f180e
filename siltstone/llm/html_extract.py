"""Main text of HTML pages by wrapper induction.

Pages of a host that are built alike, unlike in content, are aligned by simple tree matching. Elements that
align in most of them are the template; the text in them that varies is in slots, and the deepest template
element that holds nearly all slot text is the content. A page is aligned with its template to find that
element, and its blocks are the text but for constant ones, which most pages of the host that have their
path say alike; they are counted over all pages. Declared roles only narrow what the wrapper has found: to a
``main`` or ``article`` inside it, and without menus, comments and the like inside that.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from siltstone.llm._io import discard, materialize
from siltstone.llm._text import pieces
from siltstone.llm.html_tree import ARTICLE, HEADING, HEADINGS, TITLE, Node, blocks, parse, settle
from siltstone.llm.url_filter import host_and_path

HIDDEN = frozenset("head title script style noscript template iframe noembed xmp object svg canvas".split())
DROPPED = HIDDEN | frozenset("nav aside footer form button select textarea input menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommended share sharing social comment comments reply replies discussion disqus cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login footer header masthead toolbar copyright pagination pager".split())
#: Those of them that may hold articles, none of which is the page's.
OTHERS = frozenset("comment comments reply replies discussion disqus related recommended sidebar".split())
#: Above so many pairs, lists of children are aligned in halves.
CELLS = 4_000_000


@dataclass(frozen=True)
class WrapperRules:
    """``pages``: how many pages of a host and structure are aligned, each of other content. ``common``: the share of
    pages that makes an element template and a block constant; ``least``: in how many contents a constant block is at
    least. ``content``: the share of slot text that the content holds; ``title``: what a character of an h1 counts."""

    pages: int = 8
    common: float = 0.6
    least: int = 3
    content: float = 0.8
    title: int = 10


def hidden(node: Node) -> bool:
    return node.tag in HIDDEN or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true"


def not_article(node: Node) -> bool:
    """Whether an element declares itself to be something else than the article. What holds the article stays,
    and so does a form that holds a title: some sites wrap whole pages in one."""
    if hidden(node):
        return True
    if node.tag in ("html", "body", "main") or node.tag == "form" and node.holds & TITLE:
        return False
    words = MARKS & node.words if node.attrs else frozenset()
    if node.holds & ARTICLE:
        return node.tag in ("nav", "aside", "footer") or bool(words & OTHERS and not node.holds & TITLE)
    if node.tag == "header":
        up = node.parent
        while up is not None and not up.is_article:
            up = up.parent
        return up is None or not node.holds & HEADING
    return node.tag in DROPPED or bool(words) or node.attrs.get("role", "").lower() in ROLES


def regions(page: Node) -> list[Node]:
    """Where the article is declared inside ``page``: main, else article elements, else all of it."""
    for wanted in (lambda n: n.tag == "main" or n.attrs.get("role") == "main", lambda n: n.tag == "article"):
        found, stack = [], [page]
        while stack:
            node = stack.pop()
            if wanted(node) and not not_article(node):
                found.append(node)
                continue
            stack.extend(c for c in reversed(node.elements) if not not_article(c))
        if found:
            return found
    return [page]


class Structures:
    """Equal trees of elements as one number, and simple tree matching between numbers.

    Equal tags match, equal labels (classes) a little better, and children match in order so that most
    weight matches in all. Lists are matched whole: equal ends first, then by dynamic programming, in
    halves where its table would be large.
    """

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.label, self.tag, self.kids, self.whole = [], [], [], []
        self.memo: dict[tuple[int, int], int] = {}

    def of(self, order: list[Node]) -> dict[int, int]:
        """The number of each element; ``order`` has parents before children."""
        at: dict[int, int] = {}
        for n in reversed(order):
            kids = tuple(at[id(c)] for c in n.elements)
            key = n.label, kids
            if key not in self.ids:
                self.ids[key] = len(self.ids)
                self.label.append(n.label)
                self.tag.append(n.tag)
                self.kids.append(kids)
                self.whole.append(3 + sum(self.whole[k] for k in kids))
            at[id(n)] = self.ids[key]
        return at

    def weight(self, a: int, b: int) -> int:
        memo, stack = self.memo, [(a, b)]
        while stack:
            a, b = pair = stack[-1]
            if pair in memo:
                stack.pop()
            elif a == b or self.tag[a] != self.tag[b]:
                memo[pair] = self.whole[a] if a == b else 0
            else:
                head, x, y, tail = self.trimmed(self.kids[a], self.kids[b])
                need = [(p, q) for p in set(x) for q in set(y) if (p, q) not in memo]
                if need:
                    stack.extend(need)
                    continue
                ends = sum(self.whole[k] for k in (*self.kids[a][:head], *self.kids[a][len(self.kids[a]) - tail :]))
                memo[pair] = 2 + (self.label[a] == self.label[b]) + ends + (int(self.last_row(x, y)[-1]) if x and y else 0)
        return memo[pair]

    @staticmethod
    def trimmed(x: tuple, y: tuple) -> tuple[int, tuple, tuple, int]:
        """How many equal ones both lists begin with, what is between, and how many they end with."""
        most = min(len(x), len(y))
        head = next((i for i in range(most) if x[i] != y[i]), most)
        tail = next((i for i in range(most - head) if x[-1 - i] != y[-1 - i]), most - head)
        return head, x[head : len(x) - tail], y[head : len(y) - tail], tail

    def weights(self, x: tuple, y: tuple) -> np.ndarray:
        """The rows of weights of distinct numbers, and each one's row."""
        (u, i), (v, j) = (np.unique(np.array(z, np.int64), return_inverse=True) for z in (x, y))
        table = np.array([[self.weight(int(p), int(q)) for q in v] for p in u], np.int64)
        return table[:, j], i

    def rows(self, x: tuple, y: tuple) -> Iterator[np.ndarray]:
        table, i = self.weights(x, y)
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for k in i:
            new = row.copy()
            np.maximum(new[1:], row[:-1] + table[k], out=new[1:])
            row = np.maximum.accumulate(new)
            yield row

    def last_row(self, x: tuple, y: tuple) -> np.ndarray:
        for row in self.rows(x, y):
            pass
        return row

    def matched(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        """Which places of two lists of children match."""
        head, p, q, tail = self.trimmed(x, y)
        out = [(i, i) for i in range(head)] + [(len(x) - 1 - i, len(y) - 1 - i) for i in range(tail)]
        if p and q and len(p) > 1 and len(p) * len(q) > CELLS:
            half = len(p) // 2
            cut = int((self.last_row(p[:half], q) + self.last_row(p[:half - 1 : -1], q[::-1])[::-1]).argmax())
            out += [(head + i, head + j) for i, j in self.matched(p[:half], q[:cut])]
            out += [(head + half + i, head + cut + j) for i, j in self.matched(p[half:], q[cut:])]
        elif p and q:
            table = list(self.rows(p, q))
            i, j = len(p), len(q)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((head + i, head + j))
        return out

    def pairs(self, a: Node, b: Node, at: dict[int, int], to: dict[int, int]) -> Iterator[tuple[Node, Node]]:
        """The aligned elements of two trees whose numbers are ``at`` and ``to``."""
        stack = [(a, b)] if a.tag == b.tag else []
        while stack:
            a, b = stack.pop()
            yield a, b
            x, y = a.elements, b.elements
            for i, j in self.matched(tuple(at[id(c)] for c in x), tuple(to[id(c)] for c in y)):
                if x[i].tag == y[j].tag:
                    stack.append((x[i], y[j]))


def block_key(owner: Node, text: str) -> int:
    """A block's identity: its text at its path."""
    return xxhash.xxh64_intdigest(text, owner.path) >> 1


def structure_key(page: Node) -> int:
    """The kind of page by its topmost elements, repeats as one: four levels, which are html, body and two in it."""
    top, level = set(), [page]
    for _ in range(4):
        level = [c for n in level for c in n.elements if c.tag not in HIDDEN]
        top |= {n.path for n in level}
    return xxhash.xxh64_intdigest(np.array(sorted(top), np.uint64).tobytes()) >> 1


def induce(texts: list[str], constant: set[int] = frozenset(), rules: WrapperRules = WrapperRules()) -> dict | None:
    """The wrapper of pages that are built alike: the template's elements (label, parent) with the content's place, or
    None where the pages have no element in common that holds their varying text."""
    found = Structures()
    pages = [parse(t) for t in texts]
    orders = [settle(p) for p in pages]
    numbers = [found.of(o) for o in orders]
    if len(pages) < 2:
        return None
    fit = lambda i: sum(found.weight(numbers[i][id(pages[i])], numbers[j][id(pages[j])]) for j in range(len(pages)) if j != i)
    best = max(range(len(pages)), key=lambda i: (fit(i), -i))
    anchor, support, slot = orders[best], Counter(), Counter()
    for page, order, number in zip(pages, orders, numbers, strict=True):
        to = {id(b): a for a, b in found.pairs(pages[best], page, numbers[best], number)}
        support.update(id(a) for a in to.values())
        for owner, t, links in blocks(page, not_article):
            if block_key(owner, t) not in constant:
                up = owner
                while id(up) not in to:
                    up = up.parent
                slot[id(to[id(up)])] += len(t) * (1 - links) * (rules.title if owner.tag == "h1" else 1)
    for n in reversed(anchor):
        if n.parent is not None:
            slot[id(n.parent)] += slot[id(n)]
    content, total = pages[best], slot[id(pages[best])]
    while total > 0:
        into = [c for c in content.elements if slot[id(c)] >= rules.content * total and support[id(c)] >= rules.common * len(pages) and c.tag != "p" and c.tag not in HEADINGS]
        if not into:
            break
        content = into[0]
    if total <= 0 or content is pages[best]:
        return None
    kept: dict[int, int] = {}
    rows, inside = [], {id(content)}
    for n in anchor:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        if n.parent is None or id(n.parent) in kept and (id(n) in inside or support[id(n)] >= rules.common * len(pages)):
            kept[id(n)] = len(rows)
            rows.append([n.label, kept[id(n.parent)] if n.parent is not None else -1])
    return {"rows": rows, "content": kept[id(content)]}


class Wrapper:
    """A template as a tree, ready to be aligned with pages."""

    def __init__(self, source: str | None, found: Structures):
        self.found, self.root, self.content = found, None, None
        if source:
            made: list[Node] = []
            spec = json.loads(source)
            for label, parent in spec["rows"]:
                tag, *words = label.split(".")
                node = Node(tag, {"class": " ".join(words)} if words else {}, made[parent] if parent >= 0 else None)
                if parent >= 0:
                    made[parent].children.append(node)
                made.append(node)
            self.root, self.content, self.numbers = made[0], made[spec["content"]], found.of(made)
            self.line, up = set(), self.content
            while up is not None:
                self.line.add(id(up))
                up = up.parent

    def place(self, page: Node, order: list[Node]) -> Node | None:
        """The page's element that aligns with the content."""
        if self.root is None:
            return None
        numbers = self.found.of(order)
        a, b = self.root, page
        while a is not self.content:
            x, y = a.elements, b.elements
            i = next(i for i, c in enumerate(x) if id(c) in self.line)
            to = dict(self.found.matched(tuple(self.numbers[id(c)] for c in x), tuple(numbers[id(c)] for c in y))).get(i)
            if to is None or x[i].tag != y[to].tag:
                return None
            a, b = x[i], y[to]
        return b


def main_text(html: str, wrappers: dict[int, Wrapper] | None = None, constant: set[int] = frozenset()) -> str:
    """The text of a page by the wrapper of its structure and without the constant blocks."""
    page = parse(html)
    order = settle(page)
    wrapper = wrappers.get(structure_key(page)) if wrappers else None
    inside = wrapper.place(page, order) if wrapper is not None else None
    found = [x for r in regions(page if inside is None else inside) for x in blocks(r, not_article)]
    return "\n\n".join(t for owner, t, _ in found if not constant or block_key(owner, t) not in constant)


def survey(hosted: DataFrame) -> DataFrame:
    """Of each page one row for its structure (kind 0: structure), and one for each distinct block (kind 1: path, block),
    all with the host and a key of the page's content, its longest block: copies of an article count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            out: list[list] = [[], [], [], [], []]
            for row, text in enumerate(part["html"].to_pylist()):
                settle(page := parse(text or ""))
                said = [(o, t) for o, t, _ in blocks(page, hidden)]
                key = xxhash.xxh64_intdigest(max((t for _, t in said), key=lambda t: (len(t), t), default="")) >> 1
                rows = {(1, o.path >> 1, block_key(o, t)) for o, t in said} | {(0, 0, structure_key(page))}
                for to, values in zip(out, zip(*((row, key, *r) for r in rows), strict=True), strict=True):
                    to.extend(values)
            row, key, kind, path, value = out
            yield pa.RecordBatch.from_arrays([part["host"].take(pa.array(row, pa.int64())), part["place"].take(pa.array(row, pa.int64())), pa.array(key, pa.int64()), pa.array(kind, pa.int8()), pa.array(path, pa.int64()), pa.array(value, pa.int64())], names=["host", "place", "key", "kind", "path", "value"])

    return hosted.select("host", "place", "html").mapInArrow(run, "host string, place long, key long, kind byte, path long, value long")


def constant_blocks(rows: DataFrame, rules: WrapperRules) -> DataFrame:
    """(host, constant): the blocks that ``common`` of all contents of the host that have their path say, and ``least`` of them."""
    said = rows.where("kind = 1").select("host", "path", "value", "key").distinct()
    counts = said.groupBy("host", "path", "value").agg(F.count("*").alias("n")).where(F.col("n") >= rules.least)
    of_path = rows.where("kind = 1").select("host", "path", "key").distinct().groupBy("host", "path").agg(F.count("*").alias("m"))
    common = counts.join(of_path, ["host", "path"]).where(F.col("n") >= F.lit(rules.common) * F.col("m"))
    return materialize(common.groupBy("host").agg(F.sort_array(F.collect_set("value")).alias("constant")), "constant")


def host_wrappers(hosted: DataFrame, rows: DataFrame, constant: DataFrame, rules: WrapperRules) -> DataFrame:
    """(host, structure, wrapper as JSON) by aligning up to ``pages`` pages of each host and structure."""
    kinds = rows.where("kind = 0").groupBy("host", F.col("value").alias("structure"), "key").agg(F.min("place").alias("place"))
    few = kinds.withColumn("salt", F.pmod("key", F.lit(64)))  # a host may hold a third of all pages
    for deal in (["host", "structure", "salt"], ["host", "structure"]):
        few = few.withColumn("k", F.row_number().over(W.partitionBy(*deal).orderBy("key"))).where(F.col("k") <= rules.pages)
    picked = materialize(few.select("host", "structure", "place"), "picked")
    few = F.broadcast(picked) if picked.count() <= 500_000 else picked
    sample = hosted.join(few, ["host", "place"]).select("host", "structure", "place", "html").dropDuplicates(["host", "structure", "place"]).join(constant, "host", "left")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        made = induce([h or "" for h in group["html"].to_pylist()], set(group["constant"][0].as_py() or ()), rules)
        return pa.table({"host": group["host"][:1], "structure": group["structure"][:1], "wrapper": pa.array([json.dumps(made, separators=(",", ":")) if made else None], pa.string())})

    return materialize(sample.groupBy("host", "structure").applyInArrow(run, "host string, structure long, wrapper string").where("wrapper is not null"), "wrappers")


def _sized(table: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """The table, to be broadcast where all its values take ``limit`` bytes at most."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def extract_main_text(pages: DataFrame, rules: WrapperRules = WrapperRules()) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty html, or a page without an article's text, gives an empty text. Pages whose url is null or
    has no host are a host of their own. A page that aligns with no wrapper (its host has one page of its kind,
    or copies of one) is read by its declared main or article, else whole. Where two pages fit the others
    equally well, the first by place, a hash of id and url, is the template. Repeated rows are extracted each;
    an empty table gives no rows; other columns are not read. Depth and length of a page are not bounded.
    """
    hosted = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"), F.xxhash64("page_id", "url").alias("place"))
    rows = materialize(survey(hosted), "survey")
    constant = constant_blocks(rows, rules)
    wrappers = host_wrappers(hosted, rows, constant, rules)
    kinds = wrappers.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("structure", "wrapper"))).alias("wrappers"))
    joined = hosted.join(_sized(materialize(kinds.join(constant, "host", "full_outer"), "hosts")), "host", "left").select("page_id", "url", "html", "host", "wrappers", "constant")
    discard(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        found = Structures()
        for part in pieces(batches, "html"):
            texts = []
            for i, (h, host) in enumerate(zip(part["html"].to_pylist(), part["host"].to_pylist(), strict=True)):
                if len(found.ids) > 200_000:
                    found = Structures()
                    known.clear()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = {k: Wrapper(w, found) for k, w in part["wrappers"][i].as_py() or ()}, set(part["constant"][i].as_py() or ())
                texts.append(main_text(h or "", *known[host]))
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

