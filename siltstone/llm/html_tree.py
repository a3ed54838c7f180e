"""A small HTML parser: tags to trees, and trees to blocks of text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import xxhash

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANK = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag of the key closes, if it is open within the bounds of the other set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("article aside blockquote body div footer form header html li main nav section table td th".split())


#: Bits of Node.holds: what lies below an element.
ARTICLE, HEADING, TITLE = 1, 2, 4


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "label", "path", "holds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.label = tag if "class" not in attrs else ".".join([tag, *sorted(w for w in attrs["class"].lower().split() if w.isalpha())])

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def is_article(self) -> bool:
        return self.tag in ("article", "main") or self.attrs.get("role") == "main"

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    @property
    def words(self) -> set[str]:
        return {w for k in ("class", "id") for w in re.split(r"[^a-z0-9]+", self.attrs.get(k, "").lower()) if w}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def parse(text: str) -> Node:
    """The tree of a page, whole or cut off; tags that are not closed are closed where HTML says so."""
    root = at = Node("#page", {}, None)
    place, lower = 0, None
    while True:
        m = TOKEN.search(text, place)
        end = m.start() if m else len(text)
        if end > place:
            at.children.append(html.unescape(text[place:end]))
        if not m:
            return root
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = at
            while node is not root and node.tag != tag and not (tag == "p" and node.tag in HOLDS_P):
                node = node.parent
            if node is not root and node.tag == tag:
                at = node.parent
            continue
        if text[m.end() - 1 : m.end()] != ">":
            continue  # a tag that the end of the page cuts off
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            node = at
            while node is not root and node.tag not in closed and node.tag not in bound:
                node = node.parent
            if node.tag in closed:
                at = node.parent
        elif tag not in INLINE and tag not in RAW:
            node = at
            while node is not root and node.tag != "p" and node.tag not in HOLDS_P:
                node = node.parent
            if node.tag == "p":
                at = node.parent
        node = Node(tag, _attributes(m[3]), at)
        at.children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else re.sub("[A-Z]", lambda x: x[0].lower(), text)
            stop = lower.find(f"</{tag}", place)
            stop = len(text) if stop < 0 else stop
            node.children.append(text[place:stop])
            place = text.find(">", stop) + 1 or len(text)
        elif tag not in VOID:
            at = node


def settle(page: Node) -> list[Node]:
    """All elements, parents first, each with its path's hash and what lies below it. Any depth: nothing recurses."""
    order = list(page.walk())
    for n in order:
        n.path, n.holds = xxhash.xxh64_intdigest(f"{n.parent.path if n.parent else ''}/{n.label}"), 0
    for n in reversed(order):
        if n.parent is not None:
            n.parent.holds |= n.holds | ARTICLE * n.is_article | HEADING * (n.tag in HEADINGS) | TITLE * (n.tag == "h1")
    return order


def blocks(node: Node, skip) -> Iterator[tuple[Node, str, float]]:
    """(block element, text, share of it in links) in page order: text between the bounds of block elements,
    white space as one space."""
    held: list[str] = []
    owner, linked, links = node, 0, 0

    def flush() -> Iterator[tuple[Node, str, float]]:
        nonlocal linked
        whole = "".join(held)
        text, share = BLANK.sub(" ", whole).strip(), linked / max(1, len(whole))
        held.clear()
        linked = 0
        if text:
            yield owner, text, share

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, i = stack.pop()
        if i < len(at.children):
            stack.append((at, i + 1))
            child = at.children[i]
            if isinstance(child, str):
                held.append(child)
                linked += len(child) * (links > 0)
            elif child.tag == "br":
                held.append(" ")
            elif not skip(child):
                if child.tag not in INLINE:
                    yield from flush()
                    owner = child
                links += child.tag == "a"
                stack.append((child, 0))
            elif child.tag not in INLINE:
                yield from flush()
        elif at.tag == "a":
            links -= 1
        elif at.tag not in INLINE:
            yield from flush()
            owner = stack[-1][0] if stack else node
            while owner.tag in INLINE and owner.parent is not None:
                owner = owner.parent
