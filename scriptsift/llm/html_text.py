"""Main text of web pages by composite text density.

Every node gets a density: its characters per tag, lowered where much of the
text stands in links, compared with the link share of the whole page.  The node
whose children's densities add up to most is the core of the page.  The
smallest density on the path from the core up to the body is the threshold for
other content: every node that reaches it contributes the subtree of its
largest density sum, and the extract is the smallest subtree around all of
these.

Parts that are never text (scripts, forms, menus, marked notices and so on) are
cut before densities are computed, as their tag, class or role says what they
are.  A class or role says so only as a whole, when it is made of nothing but such
words: ``cookie-notice`` is a notice, ``side-effects`` and ``search-results`` are
text.  Ids and labels say nothing.  Everything else is left to the densities.

Where the extract lies in an article or main part, that part is the extract: these
tags name the main text of a page, and of several the densities choose one.

Parsing is linear in the page: what a tag needs to know of the tags around it
stands on its parent, and an end tag without an open one costs nothing.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
SKIPPED = RAW | frozenset(
    "head nav footer aside form button select option svg canvas object audio video dialog menu map input label fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr input label "
    # Formulas stand in a line with the text around them.
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle semantics".split())
# Words of which the class or role of a part without main text is made.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer "
    "foot header masthead topbar comment comments commentlist reply replies respond discussion disqus share sharing social "
    "related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar widget "
    "search searchbox form hidden complementary contentinfo dialog skip disclaimer".split())
WHOLE = frozenset("html body article main".split())
# A start tag of these ends an open paragraph; the others end their own kind.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDS_OWN = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
             "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
             "option": ("option", ("select",))}
# What an open paragraph is not looked for beyond.
_SCOPE = frozenset("html body article main section div table td th li ul ol dl blockquote aside nav header footer form".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I | re.S)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")


class Node:
    """``inside``: within an article or main part.  ``paragraph``: the open paragraph an end tag can reach.
    ``inlines``: open inline tags of the block the node stands in, by name."""

    __slots__ = (
        "tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut", "inside", "paragraph", "inlines")

    def __init__(self, tag: str, parent: "Node | None", cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.paragraph = self if tag == "p" else None if tag in _SCOPE or parent is None else parent.paragraph
        self.inlines = parent.inlines if tag in INLINE and parent is not None else {}


def _marks(value: str) -> bool:
    """Whether some class or role consists of marking words only."""
    for token in value.split():
        words = [w.lower() for w in _SPLIT.split(token) if w]
        if words and all(w in MARKS for w in words):
            return True
    return False


def _is_cut(tag: str, attributes: str, parent: Node) -> bool:
    if parent.cut or tag in SKIPPED or tag == "header" and not parent.inside:
        return True
    if tag in WHOLE or not attributes:
        return False
    heading = parent.inside and tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6")
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "role") and not heading and _marks(value):
            return True
    return False


def parse(page: str) -> Node:
    """Tree of a page; text is kept as strings between child nodes.  Bad nesting is closed as browsers do."""
    root = node = Node("html", None, False)
    at = 0
    opened: dict[str, int] = {}

    def leave(top):
        """Close everything up to and with ``top``."""
        nonlocal node
        while True:
            opened[node.tag] -= 1
            if node.tag in INLINE:
                node.inlines[node.tag] -= 1
            if node is top:
                node = node.parent
                return
            node = node.parent

    def enter(child):
        nonlocal node
        node = child
        opened[child.tag] = opened.get(child.tag, 0) + 1
        if child.tag in INLINE:
            child.inlines[child.tag] = child.inlines.get(child.tag, 0) + 1

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at and not node.cut:
            node.children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p":
                if node.paragraph is not None:
                    leave(node.paragraph)
            elif tag in INLINE and node.inlines.get(tag) or tag not in INLINE and tag not in ("html", "body") and opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.cut:
                top = node
                while top.parent.cut:
                    top = top.parent
                leave(top)
            if tag == "body" and node is root:
                body = Node("body", root, False)
                root.children.append(body)
                enter(body)
            continue
        if tag in _ENDS_P and node.paragraph is not None:
            leave(node.paragraph)
        if tag in _ENDS_OWN:
            own, stops = _ENDS_OWN[tag]
            own = own.split()
            if any(opened.get(t) for t in own):
                up = node
                while up is not root and up.tag not in stops:
                    if up.tag in own:
                        leave(up)
                        break
                    up = up.parent
        child = Node(tag, node, _is_cut(tag, m[3], node))
        node.children.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        enter(child)
    if at < len(page) and not node.cut:
        node.children.append(html.unescape(page[at:]))
    return root


def _ordered(root: Node) -> list[Node]:
    """Kept nodes, parents before children."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return out


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, densities and density sums; returns the kept nodes."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_WHITE.sub("", c))
            elif not c.cut:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    page_chars, page_links = max(root.chars, 1), root.link_chars
    for node in nodes:
        if not node.chars:
            continue
        tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
        link, plain = max(node.link_chars, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + page_links / page_chars * node.chars + math.e)
        node.density = node.chars / tags * math.log(max(node.chars / link * tags / link_tags, 1.0) + 1) / base
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
        if any(isinstance(c, str) and c.strip() for c in node.children) or not node.total:
            node.total = max(node.total, node.density)
    return nodes


def _core(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: n.total)


def _subtree(nodes: list[Node], top: Node) -> list[Node]:
    inside = {id(top)}
    return [n for n in nodes if id(n) in inside or id(n.parent) in inside and not inside.add(id(n))]


def main_node(root: Node) -> Node:
    """Smallest subtree around all content above the body-path threshold."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if body.chars < root.chars:
        body = root
    nodes = _subtree(nodes, body)
    core = _core(nodes)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    # The largest density sum below every node, found from the leaves up.
    best = {}
    for node in reversed(nodes):
        below = [best[id(c)] for c in node.children if isinstance(c, Node) and not c.cut]
        best[id(node)] = max([node, *below], key=lambda n: n.total)
    marked = {id(best[id(n)]) for n in nodes if n.density >= threshold and n.chars} | {id(core)}
    # Path of every marked node; the deepest node on all of them is the extract.
    held = {}
    for node in reversed(nodes):
        held[id(node)] = (id(node) in marked) + sum(held[id(c)] for c in node.children if isinstance(c, Node) and not c.cut)
    top = body
    while id(top) not in marked:
        deeper = [c for c in top.children if isinstance(c, Node) and not c.cut and held[id(c)] == len(marked)]
        if not deeper:
            break
        top = deeper[0]
    article = top
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    return article if article is not None and article is not root else top


def blocks(top: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order; inline tags do not end a block."""
    out, parts = [], []

    def flush():
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
        parts.clear()

    rest: list = [top]
    while rest:
        item = rest.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.cut:
            if item.tag not in INLINE:
                flush()
                rest.append(None)
            rest.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages."""
    if not page:
        return ""
    root = parse(page)
    return "\n\n".join(blocks(main_node(root))) if root.children else ""


def extracted(page):
    """Column of main texts of a column of pages."""
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())
    return extract.asNondeterministic()(page)


def extract_pages(pages: DataFrame, content: str = "html", name: str = "text") -> DataFrame:
    """``pages`` plus the main text of each, and its length in code points.

    Pages are handled one by one: null and empty pages have an empty text, broken
    nesting is closed, repeated rows agree, ties between nodes go to the first.
    Columns called ``name`` and ``n_chars`` are replaced.
    """
    small_batches(pages.sparkSession)
    return pages.withColumn(name, extracted(F.col(content))).withColumn("n_chars", F.length(name).cast("long"))
