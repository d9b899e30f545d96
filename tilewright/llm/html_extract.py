"""Main text of web pages by scoring their element tree.

Paragraphs pass points for their length and commas to the container they lie in, and on to its ancestors, half
as many with each level; a container's points are discounted by the share of its text that lies in links.  The
best container is kept (the whole ``article`` or ``main`` element if it lies in one), with those siblings that
read like text too.

Scripts, styles, menus, footers, sidebars, form controls and hidden elements are cut from the tree beforehand.
Containers that a name marks as adverts are cut too, and those that a name marks as notices, forms, reader
comments and the like, unless they hold most of the page's text and every ``article`` and ``main`` element.  A name marks an element if it is one of the marking words, or is made of one and of words
that tell no more (``comment-list``); other compounds (``related-work``) mark nothing, and paragraphs, headings
and inline elements are not judged by their names (but for adverts').

Null and empty pages, and pages without text, give an empty text.  Character references are decoded, white
space in a block becomes one space, blocks are joined by line ends in page order.  The time is linear in the
page, however deep its elements nest.  Rows are independent: repeated rows repeat, extra columns are ignored,
an empty table stays empty.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.sources.scratch import lean

SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
#: Elements whose whole content goes.
CUT = frozenset("script style title textarea noscript template iframe object svg math canvas audio video nav footer aside button select option datalist menu dialog head".split())
#: Words of class or id that mark a container as no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar aside rail footer masthead header topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog"
    " newsletter subscribe subscription signup login form search share sharing social related recommended recommendations trending popular"
    " comment comments commentlist reply replies respond disqus discussion pagination pager skip widget widgets hidden".split()
)
#: Words that tell no more beside a marking one.
NEUTRAL = frozenset(
    "list section box area container wrapper wrap block slot unit left right top bottom inner outer bar panel group item items link links button buttons post posts articles"
    " message site page primary secondary global sticky fixed thread text title".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored promo".split())
COMMENTS = frozenset("comment comments commentlist reply replies disqus".split()) | ADVERTS
#: Elements that a name can mark.
CONTAINERS = frozenset("div section ul ol dl dir table tbody tr td center details fieldset figure header hgroup form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A start tag of the first closes an open element of the second, unless one of the third lies between.
IMPLIED = {
    "p": (frozenset({"p"}), frozenset("table td th caption".split())),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
KINDS = {kind: i for i, kind in enumerate(IMPLIED)} | {"dd": 2, "th": 4}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*+)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s>/])[^>]*>|\Z", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """``cut``: its text goes; ``marked``: it goes if it's but a part of the page; ``near``: for each kind of
    IMPLIED the depth of the element that a start tag of the kind closes, 0 for none."""

    __slots__ = ("tag", "parent", "cut", "marked", "in_main", "near", "children", "score", "length", "linked", "total", "total_linked")

    def __init__(self, tag: str, parent: Node | None, cut: bool, marked: bool, depth: int):
        self.tag, self.parent, self.cut, self.marked = tag, parent, cut, marked
        self.in_main = tag in ("article", "main") or parent is not None and parent.in_main
        self.near = parent.near if parent else (0,) * len(IMPLIED)
        if tag in _TOUCHED:
            self.near = tuple(depth if tag in ends else 0 if tag in until else n for n, (ends, until) in zip(self.near, IMPLIED.values()))
        self.children: list[Node] = []
        self.score, self.length, self.linked = 0.0, 0, 0

    @property
    def density(self) -> float:
        return self.total_linked / max(1, self.total)

    @property
    def worth(self) -> float:
        return self.score * (1 - self.density)


_TOUCHED = frozenset().union(*(x for pair in IMPLIED.values() for x in pair))


def _marks(names: str, words: frozenset[str], neutral: frozenset[str] = NEUTRAL) -> bool:
    """Whether one of the names is a marking word, or made of such and neutral ones."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = _WORD.findall(name)
        if parts and not words.isdisjoint(parts) and all(x in words or x in neutral for x in parts):
            return True
    return False


def _judge(tag: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """(cut, marked) of an element by its tag and attributes."""
    if tag in CUT:
        return True, False
    marked = tag == "form" or tag == "header" and not parent.in_main  # an article's own header holds its title
    if not attributes:
        return False, marked
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True, False
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in ("article", "main"):
        return False, _marks(names, COMMENTS)
    if tag in CONTAINERS:
        if _marks(names, ADVERTS):
            return True, False
        marked |= found.get("role", "").lower() in ROLES or _marks(names, MARKS - {"header", "masthead"} if parent.in_main else MARKS)
    elif tag in BLOCK:
        return _marks(found.get("class", ""), ADVERTS, frozenset()), marked
    return False, marked


def _parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and in page order the blocks of text with the element each lies in."""
    root = Node("html", None, False, False, 0)
    stack, blocks = [root], []
    opened: Counter[str] = Counter()
    held: list[str] = []
    links, linked, cut_inline = 0, 0, []

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                node = stack[-1]
                blocks.append((node, text))
                node.length += len(text)
                node.linked += min(linked, len(text))
        linked = 0

    def close(to: int) -> None:
        flush()
        for node in stack[to:]:
            opened[node.tag] -= 1
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not stack[-1].cut and not cut_inline:
            held.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name == "p":
                if stack[-1].near[0]:
                    close(stack[-1].near[0])
            elif name in BLOCK or name in CUT:
                if opened[name]:  # what is looked at is closed
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            elif name == "a":
                links = max(0, links - 1)
            elif name == "br":
                held.append(" ")
            if cut_inline and cut_inline[-1] == name:
                cut_inline.pop()
            continue
        attributes = m[3] or m[6] or ""
        if name in ("html", "body"):
            continue
        if name in RAW:
            if name in BLOCK or name in CUT:
                flush()
            at = _RAW_END[name].search(page, at).end()
        elif name in BLOCK or name in CUT:
            if name in BLOCK:
                flush()
                links = 0
                cut_inline.clear()
                if stack[-1].near[0]:  # a block ends an open paragraph
                    close(stack[-1].near[0])
            if name in KINDS and stack[-1].near[KINDS[name]]:
                close(stack[-1].near[KINDS[name]])
            if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
                continue
            flush()
            cut, marked = _judge(name, attributes, stack[-1])
            node = Node(name, stack[-1], stack[-1].cut or cut, marked, len(stack))
            stack[-1].children.append(node)
            stack.append(node)
            opened[name] += 1
        elif name == "a":
            links = 1
        elif name == "br":
            held.append(" ")
        elif name not in VOID and attributes and _judge(name, attributes, stack[-1])[0]:
            cut_inline.append(name)
    flush()
    return root, blocks


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _totals(order: list[Node]) -> None:
    """Text and links of whole subtrees without what is cut; ``order`` has parents before children."""
    for n in order:
        n.total, n.total_linked = (0, 0) if n.cut else (n.length, n.linked)
    for n in reversed(order[1:]):
        n.parent.total += n.total
        n.parent.total_linked += n.total_linked


def _score(order: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """A paragraph's points go to its container, half of them to the container's parent, and so on."""
    for node, text in blocks:
        if node.cut or len(text) < 25 or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th") and len(text) < 80:
            continue
        to = node.parent if node.tag in ("p", "pre", "blockquote", "li", "dd", "td") and node.parent else node
        to.score += _points(text) * (1 - node.linked / max(1, node.length))
    for n in reversed(order[1:]):
        n.parent.score += n.score / 2


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root, blocks = _parse(page)
    order: list[Node] = [root]
    for n in order:
        order.extend(n.children)
    _totals(order)
    mains = {id(n): n.tag in ("article", "main") and not n.cut and not n.marked for n in order}
    for n in reversed(order[1:]):
        mains[id(n.parent)] += mains[id(n)]
    for n in order[1:]:  # parents come first
        n.cut = n.cut or n.parent.cut or n.marked and (2 * n.total <= root.total or mains[id(n)] < mains[id(root)])
    _totals(order)
    blocks = [b for b in blocks if not b[0].cut]
    if not blocks:
        return ""
    _score(order, blocks)
    best = max(order, key=lambda n: n.worth)
    if best.worth <= 0:
        named = [n for n in order if n.tag in ("article", "main") and n.total]
        best = max(named, key=lambda n: n.total - n.total_linked) if named else root
    for wanted in ("article", "main"):
        up = best
        while up is not None and up.tag != wanted:
            up = up.parent
        if up is not None:
            best = up
            break
    kept = {id(best)}
    if best.parent is not None and best.tag not in ("article", "main"):
        least = max(10.0, 0.2 * best.worth)
        for n in best.parent.children:
            if n is best or n.cut:
                continue
            paragraph = n.tag == "p" and (n.total > 80 and n.density < 0.25 or 0 < n.total <= 80 and not n.total_linked)
            if n.worth >= least or paragraph or n.tag in ("h1", "h2", "h3") and n.total and n.density < 0.25:
                kept.add(id(n))
    inside: dict[int, bool] = {}
    for n in order:
        inside[id(n)] = id(n) in kept or (n.parent is not None and inside[id(n.parent)])
    return "\n".join(text for node, text in blocks if inside[id(node)])


def html_extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return lean(pages).select("page_id", "url", "html").mapInArrow(run, SCHEMA)
