"""Main text of HTML pages by composite text density.

The page is read into a tree of elements. Every element has a density: its characters for each tag, lowered where much of its
text is in links. Elements that call themselves a menu, an advert, a form, readers' comments and so on (by tag, role or class)
have a density of nought and count for nothing above them. The sum of the densities of its children says how much running
text an element gathers; the subtree with the largest sum is the heart of the article, whatever its tags are called. The
threshold is the least density on the path from the body to it. Beside the heart every block at or above the threshold is
kept too, unless it is mostly links, and so is text that stands between blocks, and a heading whose next block is kept.
Within the heart, blocks without density and blocks below the threshold that are mostly links go.

Pages are read in one pass whose time grows with their length also where tags, quotes and comments are broken: no search
goes back, and elements know the ancestors that end tags and list items look for.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .runtime import map_arrow

_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
#: Attributes up to the end of the tag. A quote counts only after an equals sign, and only if it is closed; never fails.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+")
_ATTR = re.compile(r"(?P<key>class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CUT = set("script style noscript template iframe button select option textarea input svg canvas object embed applet audio video map head title".split())
_BARE = set("nav footer aside form label fieldset dialog menu".split())
_BARE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_BARE_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist
cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager
pagination popup promo promos promotion promoted recommended related respond replies reply share sharing sidebar side sidebars signup social sponsor
sponsored sponsors subscribe subscription subscriptions toolbar topbar widget widgets""".split())
#: Words that name the article also where another word speaks against it (such as "post-header").
_KEEP_WORDS = {"article", "content", "entry", "main", "post", "story"}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "legend"}
#: What an item closes among its open ancestors, and what it doesn't look beyond.
_PEERS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_ITEMS = {x for group, stop in _PEERS.values() for x in group | stop}
_PARAGRAPH_SCOPE = {"p", "td", "th", "table", "li", "div", "article", "section", "body", "blockquote"}
_WALLS = {"#page", "article", "main", "body", "table"}
_THROUGH_WALLS = {"article", "main", "body", "html", "table", "div", "section"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WHITE = re.compile(r"\s+")


class _Node:
    __slots__ = ("bare", "chars", "children", "cut", "density", "inside", "item", "link_chars", "link_tags", "name", "open", "parent", "parts", "scope", "tags", "wall")

    def __init__(self, name: str, parent: _Node | None, cut: bool = False, bare: bool = False):
        self.name, self.parent = name, parent
        self.cut, self.bare = cut, bare  # never text; text but not the article's
        self.parts: list = []  # texts and nodes in page order
        self.children: list[_Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        # The nearest of this and its ancestors that can end a paragraph, that items look for, and that end tags stop at
        self.scope: _Node | None = self if name in _PARAGRAPH_SCOPE or parent is None else parent.scope
        self.item: _Node | None = self if name in _ITEMS or parent is None else parent.item
        self.wall: _Node = self if name in _WALLS or parent is None else parent.wall
        self.inside: bool = name in ("article", "main") or (parent is not None and parent.inside)
        self.open: dict[str, int] = {}  # of a wall: how many elements of each name are open up to the next one


def _kind(name: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is cut, and whether it is bare."""
    if name in _CUT:
        return True, False
    bare = name in _BARE or (name == "header" and not inside_article)
    if not attrs or name in ("html", "body", "article", "main"):
        return False, bare
    for m in _ATTR.finditer(attrs):
        key = m["key"].lower()
        value = (m["a"] or m["b"] or m["c"] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True, False
        if key == "role":
            bare = bare or value.strip() in _BARE_ROLES
        elif key in ("class", "id"):
            parts = set(re.split(r"[\s_\-]+", value))
            bare = bare or bool(parts & _BARE_WORDS and not (parts & _KEEP_WORDS and not parts & {"ad", "ads", "comments", "comment", "sidebar", "related", "share"}))
    return False, bare


def _tree(page: str) -> _Node:
    root = _Node("#page", None)
    node, at, n = root, 0, len(page)
    everywhere: dict[str, int] = {}
    seen: set[str] = set()

    def closed(upto: _Node) -> _Node:
        """What stands around ``upto`` once it and all open in it are closed."""
        nonlocal node
        while True:
            everywhere[node.name] -= 1
            outer = node.parent.wall
            outer.open[node.name] -= 1
            last, node = node is upto, node.parent
            if last:
                return node

    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        name = m["name"]
        if m["comment"]:
            end = _COMMENT_END.search(page, m.end())
            at = end.end() if end else n
            continue
        if name is None or m["close"]:
            at = page.find(">", m.end()) + 1 or n
            name = name and name.lower()
            if name and (everywhere if name in _THROUGH_WALLS else node.wall.open).get(name):
                seek = node
                while seek.name != name:
                    seek = seek.parent
                closed(seek)
            elif name and node.wall.name == name and node.wall is not root:
                closed(node.wall)
            continue
        name = name.lower()
        attrs = _ATTRIBUTES.match(page, m.end())
        at, attributes = min(n, attrs.end() + 1), attrs[0]
        if name in _CLOSES_P and node.scope.name == "p":
            closed(node.scope)
        if name in _PEERS:
            group, stop = _PEERS[name]
            seek = node.item
            while seek is not root and seek.name not in stop and seek.name not in group:
                seek = seek.parent.item
            if seek.name in group:
                closed(seek)
        if name in ("html", "body"):
            if name in seen:
                continue
            seen.add(name)
        cut, bare = _kind(name, attributes, node.inside)
        child = _Node(name, node, node.cut or cut, node.bare or bare)
        node.parts.append(child)
        node.children.append(child)
        if name in _VOID or (attributes.endswith("/") and name in ("svg", "path", "use", "circle", "rect")):
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if not child.cut:
                child.parts.append(page[at : end.start() if end else n])
            at = (page.find(">", end.end()) + 1 or n) if end else n
            continue
        everywhere[name] = everywhere.get(name, 0) + 1
        node.wall.open[name] = node.wall.open.get(name, 0) + 1
        node = child
    return root


def _path(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _order(root: _Node) -> list[_Node]:
    """The node and all below it, parents first, without what is cut off."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.cut:
            continue
        out.append(node)
        todo += reversed(node.children)
    return out


def _densities(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        link = node.name == "a"
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part) - part.count(" ") - part.count("\n")
            elif not part.cut and (node.bare or not part.bare):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
        if link:
            node.link_chars = node.chars
    ratio = _ratio(nodes[0])
    for node in nodes:
        if node.chars and not node.bare:
            node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)


def _ratio(whole: _Node) -> float:
    return whole.link_chars / whole.chars if whole.chars else 0.0


def _density(c: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    free = max(1, c - link_chars)
    base = math.log(c / free * link_chars + ratio * c + math.e)
    return c / t * max(0.0, math.log(c / lc * t / lt + 1) / math.log(max(base, 1.0 + 1e-9) + 1))


def _blocks(start: _Node, top: _Node, threshold: float, ratio: float) -> list[str]:
    """Texts of the blocks of ``start`` that are kept: all of ``top``, and the dense ones elsewhere."""
    blocks: list[str] = []
    line: list[str] = []
    counts = [0, 0, 0, 0]  # of the line: characters, tags, those of links
    path = {id(x) for x in _path(top)} - {id(top)}
    heads: set[int] = set()

    def dense(node: _Node) -> bool:
        return node.chars > 0 and id(node) not in path and node.density > 0 and node.density >= threshold and node.link_chars <= 0.8 * node.chars

    def flush(whole: bool) -> None:
        text = _WHITE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        c, _, lc, _ = counts
        if text and (whole or (lc <= 0.8 * c and _density(*counts, ratio) >= threshold)):
            blocks.append(text)
        counts[:] = [0, 0, 0, 0]

    def opened(node: _Node, whole: bool) -> None:
        if not whole:  # headings whose next block is kept
            kept = False
            for child in reversed(node.children):
                if child.cut or child.name not in _BLOCK:
                    continue
                if _heading(child) and not dense(child):
                    if kept and child.density > 0 and child.link_chars <= 0.8 * child.chars:
                        heads.add(id(child))
                else:
                    kept = child is top or id(child) in path or dense(child)
        todo.extend((part, whole, link) for part in reversed(node.parts))

    todo: list = []
    link = False
    whole = start is top
    opened(start, whole)
    while todo:
        part, whole, link = todo.pop()
        if part is None:
            flush(whole)
        elif isinstance(part, str):
            line.append(part)
            size = len(part) - part.count(" ") - part.count("\n")
            counts[0] += size
            counts[2] += size * link
        elif part.cut or (part.chars and part.density <= 0) or (whole and part.density < threshold and part.name in _BLOCK and part.chars and part.link_chars > 0.8 * part.chars):
            if part.name in _BLOCK:
                flush(whole)
        elif part.name == "br":
            line.append(" ")
        elif part.name in _BLOCK:
            flush(whole)
            todo.append((None, whole or part is top or id(part) in heads or dense(part), False))
            link = False
            opened(part, todo[-1][1])
        else:
            link = link or part.name == "a"
            counts[1] += 1
            counts[3] += part.name == "a"
            opened(part, whole)
    flush(whole if start is top else False)
    return blocks


def _heading(node: _Node) -> bool:
    """Whether an element is a heading, or holds one and nothing else."""
    while node.name not in _HEADS:
        inner = [x for x in node.children if x.chars and not x.cut]
        if len(inner) != 1 or inner[0].chars < node.chars or node.name == "p":
            return False
        node = inner[0]
    return True


def main_text(page: str | None) -> str:
    """The article of a page; empty where there is none. Never fails: broken markup is read as far as it goes."""
    if not page:
        return ""
    root = _tree(page)
    nodes = _order(root)
    start = next((x for x in nodes if x.name == "body"), root)
    _densities(nodes)
    inner = _order(start)
    sums = {id(x): sum(c.density for c in x.children if not c.cut) for x in inner}
    top = max(inner, key=lambda x: sums[id(x)], default=start)
    # A line of text is no subtree: without inner elements, or where the parent is one block, the parent is the heart
    while top is not start and (sums[id(top)] == 0 or top.name not in _BLOCK or top.name in ("p", "li")):
        top = top.parent
    threshold = min((x.density for x in _path(top) if x.density > 0), default=0.0)
    return "\n\n".join(_blocks(start, top, threshold, _ratio(root)))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the markup, with ``text`` (empty if there is none) and ``n_chars`` (its code points).

    A null or empty page has an empty text. Rows, repeated ones too, stay; columns of these two names are replaced.
    """
    added = [StructField("text", StringType()), StructField("n_chars", LongType())]
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(html_column)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, [f.name for f in kept + added])

    return map_arrow(pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_column)), run, StructType(kept + added))
