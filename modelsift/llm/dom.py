"""A tolerant reader of web pages: a tree of blocks whose leaves are runs of text.

Inline tags only count for statistics; a line break is white space; scripts, styles, form controls and markup leave no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values: element kinds of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
SILENT = frozenset("script style textarea title xmp head noscript template iframe svg math select option optgroup datalist button object audio video canvas map".split())
IN_HEAD = frozenset("html head base link meta title noscript noframes style script template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = frozenset("article aside body button caption div fieldset figure footer form header html main nav section table td th".split())
# an open element of the first kind ends where one of the second starts
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

#: words of class, id and role attributes by what they hint at
HINTS = {
    "content": "article articles content contents main post entry story body text blog news paragraph prose maincontent postbody articlebody",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager links sitemap submenu topnav",
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion adsense dfp adslot adbox commercial",
    "side": "sidebar aside side widget widgets related recommended recommendations rail trending popular more teaser teasers complementary also",
    "comment": "comment comments commentlist reply replies disqus discussion respond responses feedback reviews thread reader",
    "foot": "footer foot copyright legal bottom colophon imprint disclaimer contentinfo",
    "head": "header masthead logo top brand site tagline hero topbar sitename",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy warning toast dialog message",
    "form": "form forms share sharing social subscribe subscription newsletter signup login search contact register poll survey follow",
}
HINT_NAMES = list(HINTS)
_HINT = {w: 1 << i for i, words in enumerate(HINTS.values()) for w in words.split()}


class Node:
    """A block element, or a run of text when ``tag`` is empty."""

    __slots__ = ("tag", "parent", "kids", "hints", "depth", "text", "chars", "words", "linked", "stops", "upper", "digits", "leaves", "tags", "paragraphs", "items", "inputs", "links", "start", "hidden")

    def __init__(self, tag: str, parent: Node | None, hints: int = 0, hidden: bool = False):
        self.tag, self.parent, self.hints, self.hidden = tag, parent, hints, hidden
        self.kids: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = ""
        self.chars = self.words = self.linked = self.stops = self.upper = self.digits = self.leaves = self.tags = self.paragraphs = self.items = self.inputs = self.links = self.start = 0


def hints_of(attributes: str, known: dict[str, int]) -> int:
    found = known.get(attributes)
    if found is None:
        found = 0
        for value in ATTRIBUTE.findall(attributes):
            for token in TOKEN.findall(value):
                found |= _HINT.get(token.lower(), 0)
        if len(known) < 50_000:
            known[attributes] = found
    return found


def parse(html: str | None, known: dict[str, int] | None = None) -> Node:
    """The root of the page's blocks, with statistics of each subtree.  A null or empty page is a root without children."""
    html, known = html or "", {} if known is None else known
    root = Node("body", None)
    stack: list[tuple[str, Node]] = []   # open elements, and the block each stands in
    where: dict[str, list[int]] = {}     # the depths at which an element of each name is open
    here, run, linked, link, silent = root, [], 0, 0, 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text and not silent:
                leaf = Node("", here)
                leaf.text = text
                leaf.linked = min(len(text), linked)
                here.kids.append(leaf)
            run, linked = [], 0

    def close(depth: int) -> None:
        nonlocal here, link, silent
        while len(stack) > depth:
            name, block = stack.pop()
            where[name].pop()
            if name == "a":
                link -= 1
            if name in SILENT:
                flush_silent()
                silent -= 1
            if name not in INLINE:
                flush()
                here = block

    def flush_silent() -> None:
        run.clear()

    def deepest(names: Iterable[str]) -> int:
        """Depth of the innermost open element of one of the names, -1 without any."""
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def close_within(names: Iterable[str], limits: Iterable[str]) -> None:
        """Close the innermost element of the names unless one of the limits is open inside it."""
        d = deepest(names)
        if d >= 0 and d >= deepest(limits):
            close(d)

    def close_head() -> None:
        close_within(("head",), ("template",))

    while at < end:
        m = TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if silent and stack[-1][0] == "head" and piece.strip():  # the end tag of a head may be left out
            close_head()
        if piece and not silent:
            piece = unescape(piece) if "&" in piece else piece
            run.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name, attributes = (m[1] or m[3] or "").lower(), m[2] or m[4] or ""
        if name:
            if name == "body" or (silent and stack[-1][0] == "head" and name not in IN_HEAD):
                close_head()
            if name == "br" or name == "hr":
                run.append(" ")
            if name in VOID:
                here.tags += 1
                here.inputs += name == "input"
                if name == "hr":
                    flush()
                continue
            if name in ENDS:
                close_within(ENDS[name], LIMITS[name])
            elif name in CLOSES_P:
                if where.get("p"):
                    close_within(("p",), BARRIER)
                if name == "hr":
                    continue
            if name == "a" and link:  # links do not nest
                close_within(("a",), ())
            if name in SILENT:
                flush()
                silent += 1
            if name in ("html", "body"):
                continue
            where.setdefault(name, []).append(len(stack))
            stack.append((name, here))
            if name in INLINE:
                here.tags += 1
                here.links += name == "a"
                link += name == "a"
            elif name not in SILENT:
                flush()
                node = Node(name, here, hints_of(attributes, known) if "=" in attributes else 0, bool(attributes) and HIDDEN.search(attributes) is not None)
                if not silent:
                    here.kids.append(node)
                here = node
            if name in RAW:
                close_at = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                close(len(stack) - 1)
                at = close_at.end() if close_at else end
        elif m[5]:
            name = m[5].lower()
            if name in ("html", "body"):
                close_head()
            if name == "p" and not where.get("p"):
                flush()
            if where.get(name):
                close_within((name,), BARRIER if name in INLINE else ())
    close(0)
    flush()
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Sum the statistics of each subtree; ``start`` counts the characters of all text before a node."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.kids)
    seen = 0
    for node in order:
        node.start = seen
        if not node.tag:
            t = node.text
            node.chars, node.words, node.leaves = len(t), t.count(" ") + 1, 1
            node.stops = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            node.upper = t[:1].isupper()
            node.digits = any(c in t for c in "©|»›")
            seen += len(t)
    for node in reversed(order):
        up = node.parent
        if up:
            for f in ("chars", "words", "linked", "stops", "leaves", "tags", "inputs", "links", "upper", "digits"):
                setattr(up, f, getattr(up, f) + getattr(node, f))
            up.tags += bool(node.tag)
            up.paragraphs += node.paragraphs + (node.tag == "p")
            up.items += node.items + (node.tag == "li")


def walk(root: Node) -> list[Node]:
    """Nodes that hold text, parents first and in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.chars:
            out.append(node)
            todo += reversed(node.kids)
    return out
