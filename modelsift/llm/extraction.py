"""HTML extraction: boosted trees over DOM nodes and a hierarchical decoding.

Every block and every run of text is a node with features of its subtree (density of text, links, punctuation and tags), its
attributes' words and those around it, its depth, place and siblings.  One model tells main text from the rest, another whether
a block holds both.  Decoding picks for each block "all main", "nothing" or "look inside" so that the sum of log-chances over the
tree is largest: an ancestor that is kept or dropped decides for all below it, so choices never contradict each other.

Pages carry no labels.  The models are trained here on pages built from many layouts whose truth is known, filled with words of a
bounded sample of the input, so that spelling and length of words are those of the corpus.
"""

from __future__ import annotations

import json
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .boosting import Boosted, train
from .dom import HINT_NAMES, Node, parse, walk
from .tokens import worker_store

SAMPLE_PAGES = 200    # pages of the input whose words fill the training pages
TRAIN_PAGES = 900     # built pages the models are trained on
SEED = 11
_MAIN = ""      # marks main text in a built page

_KINDS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "tr", "td", "th", "thead", "tfoot", "caption"), ("div", "center"), ("section",), ("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("blockquote", "pre", "figure", "figcaption", "details"), ("body",), ("",)]
_KIND = {t: i for i, ts in enumerate(_KINDS) for t in ts}
_AROUND = ("nav", "header", "footer", "aside", "form", "article", "main")


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node of ``walk``'s list."""
    total = max(1, nodes[0].chars) if nodes else 1
    around: dict[int, tuple[int, int]] = {}
    families: dict[int, tuple[list[Node], dict[int, int], Counter]] = {}  # a parent's children with text, the place of each, their tags
    rows = []
    for node in nodes:
        up = node.parent
        above, tags = around.get(id(up), (0, 0)) if up else (0, 0)
        around[id(node)] = (above | node.hints, tags | (1 << _AROUND.index(node.tag) if node.tag in _AROUND else 0))
        c, w = node.chars, node.words
        if id(up) not in families:
            sibs = [k for k in up.kids if k.chars] if up else [node]
            families[id(up)] = sibs, {id(k): i for i, k in enumerate(sibs)}, Counter(k.tag for k in sibs)
        sibs, places, alike = families[id(up)]
        n, place = len(sibs), places[id(node)]
        before, after = sibs[place - 1] if place else None, sibs[place + 1] if place + 1 < n else None
        rows.append(
            [
                _KIND.get(node.tag, 5), node.hints & 511, above & 511, tags, node.depth,
                np.log1p(c), np.log1p(w), node.linked / c, node.stops / w, w / node.leaves, np.log1p(node.leaves), 1000 * node.tags / c, node.paragraphs / node.leaves, node.items / node.leaves,
                node.inputs, 1000 * node.links / c, node.upper / node.leaves, node.digits > 0, c / total, node.start / total, (node.start + c) / total, node.hidden,
                np.log1p(n), place / n, alike[node.tag] / n, c / max(1, up.chars) if up else 1.0, (up.linked / max(1, up.chars)) if up else 0.0, np.log1p(up.chars / n) if up else 0.0, _KIND.get(up.tag, 5) if up else -1,
                before.linked / before.chars if before else -1.0, np.log1p(before.chars) if before else -1.0, _KIND.get(before.tag, 5) if before else -1,
                after.linked / after.chars if after else -1.0, np.log1p(after.chars) if after else -1.0, _KIND.get(after.tag, 5) if after else -1, len(node.text) if not node.tag else -1,
            ]
        )
    x = np.array(rows, np.float64).reshape(len(rows), 36)
    kinds = x[:, [0]] == np.arange(len(_KINDS))
    own = (x[:, [1]].astype(np.int64) >> np.arange(len(HINT_NAMES))) & 1
    above = (x[:, [2]].astype(np.int64) >> np.arange(len(HINT_NAMES))) & 1
    tags = (x[:, [3]].astype(np.int64) >> np.arange(len(_AROUND))) & 1
    return np.concatenate((x[:, 4:], kinds, own, above, tags), axis=1)


def decode(nodes: list[Node], main: np.ndarray, mixed: np.ndarray) -> list[bool]:
    """Whether each node is kept, from the log-odds of being main text and of holding both."""
    soft = lambda z: -np.logaddexp(0, -z)
    number = {id(n): i for i, n in enumerate(nodes)}
    leaf = np.array([not n.tag for n in nodes])
    pure = np.where(leaf, 0.0, soft(-mixed))
    keep, drop = soft(main) + pure, soft(-main) + pure
    inside = np.where(leaf, -np.inf, soft(mixed))
    kids = [[number[id(k)] for k in n.kids if k.chars] for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        for k in kids[i]:
            keep[i] += keep[k]
            drop[i] += drop[k]
            inside[i] += max(keep[k], drop[k], inside[k])
    state = [2] * len(nodes)  # 0 drop, 1 keep, 2 look inside
    for i in range(len(nodes)):
        if state[i] == 2:
            state[i] = int(np.argmax((drop[i], keep[i], inside[i])))
        for k in kids[i]:
            state[k] = state[i]
    return [s == 1 for s in state]


class Extractor:
    """Two boosted models; ``text`` gives the main text of a page."""

    def __init__(self, main: Boosted, mixed: Boosted):
        self.main, self.mixed, self.known = main, mixed, {}

    def to_json(self) -> str:
        return json.dumps([{"base": m.base, "depth": m.depth, "cuts": [c.tolist() for c in m.cuts], "trees": [[a.tolist() for a in t] for t in m.trees]} for m in (self.main, self.mixed)])

    @classmethod
    def from_json(cls, text: str) -> Extractor:
        read = lambda m: Boosted(m["base"], [np.array(c) for c in m["cuts"]], m["depth"], [(np.array(a), np.array(b), np.array(c)) for a, b, c in m["trees"]])
        return cls(*map(read, json.loads(text)))

    @classmethod
    def shared(cls, text: str) -> Extractor:
        store = worker_store("extractors")
        if text not in store:
            store.clear()
            store[text] = cls.from_json(text)
        return store[text]

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [walk(parse(p, self.known)) for p in pages]
        x = [features(t) for t in trees]
        every = np.concatenate(x) if x else np.empty((0, 1))
        if not len(every):
            return ["" for _ in pages]
        main, mixed = self.main.margin(every), self.mixed.margin(every)
        out, at = [], 0
        for nodes in trees:
            n = len(nodes)
            kept = decode(nodes, main[at : at + n], mixed[at : at + n]) if n else []
            out.append(" ".join(node.text for node, k in zip(nodes, kept) if k and not node.tag))
            at += n
        return out


def _label(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a built page without its marks, with 1 for all main, 0 for nothing, 2 for both."""
    marked = iter([_MAIN in n.text for n in walk(parse(page)) if not n.tag])
    nodes = walk(parse(page.replace(_MAIN, "")))
    number = {id(n): i for i, n in enumerate(nodes)}
    main, other = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if not node.tag:
            main[i] = next(marked)
            other[i] = not main[i]
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.parent and id(node.parent) in number:
            up = number[id(node.parent)]
            main[up] |= main[i]
            other[up] |= other[i]
    return nodes, np.where(main & other, 2, main.astype(int))


def learn(words: list[str], pages: int = TRAIN_PAGES, seed: int = SEED) -> Extractor:
    """Train both models on built pages filled with the given words (a plain list if there are none)."""
    rng = random.Random(seed)
    words = words or "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()
    x, y, leaf = [], [], []
    for _ in range(pages):
        nodes, label = _label(build_page(rng, words))
        x.append(features(nodes))
        y.append(label)
        leaf.append(np.array([not n.tag for n in nodes]))
    x, y, leaf = np.concatenate(x), np.concatenate(y), np.concatenate(leaf)
    pure = y < 2
    return Extractor(train(x[pure], y[pure].astype(float)), train(x[~leaf], (y[~leaf] == 2).astype(float)))


# ---- built pages

_NAMES = {
    "main": ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "blog-post", "text", "news-article"],
    "nav": ["nav", "navbar", "main-menu", "menu", "navigation", "top-nav", "breadcrumb"],
    "head": ["header", "site-header", "masthead", "logo", "top-bar", "branding"],
    "foot": ["footer", "site-footer", "bottom", "copyright", "legal"],
    "side": ["sidebar", "aside", "widget", "related-posts", "recommended", "rail", "popular", "trending"],
    "ad": ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement"],
    "comment": ["comments", "comment-list", "replies", "discussion", "disqus_thread", "responses"],
    "notice": ["cookie-notice", "cookie", "consent", "gdpr-banner", "alert", "popup", "modal", "notice"],
    "form": ["newsletter", "subscribe", "search-form", "signup", "contact-form", "social-share", "share", "login"],
    "": ["wrap", "container", "row", "col-8", "inner", "grid", "box", "c1"],
}


def build_page(rng: random.Random, words: list[str]) -> str:
    """A page of random layout; runs of main text hold a mark."""
    plain = rng.random() < 0.2  # a page without telling names

    def name(kind: str, share: float = 0.85) -> str:
        if plain or rng.random() > share:
            return rng.choice(["", "", f' class="x{rng.randrange(999)}"', f' class="{rng.choice(_NAMES[""])}"'])
        return f' {rng.choice(["class", "class", "class", "id"])}="{rng.choice(_NAMES[kind])}"'

    def some(a: int, b: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    def sentences(n: int) -> str:
        return " ".join(some(3, 22).capitalize() + rng.choice(".....!?") for _ in range(n))

    def link(a: int, b: int) -> str:
        return f'<a href="/{rng.randrange(9999)}">{some(a, b)}</a>'

    def inline(text: str) -> str:
        for tag in rng.sample(["b", "i", "em", "strong", "a", "span", "br", "code"], rng.choice([0, 0, 1, 2])):
            w = text.split(" ")
            i = rng.randrange(len(w))
            w[i] = "<br>" + w[i] if tag == "br" else f'<a href="/y">{w[i]}</a>' if tag == "a" else f"<{tag}>{w[i]}</{tag}>"
            text = " ".join(w)
        return text

    def m(text: str) -> str:
        return _MAIN + text

    def links(n: int, wrap: str = "") -> str:
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{link(1, 3)}</li>" for _ in range(n)) + "</ul>"
        if style < 0.8:
            return " | ".join(link(1, 3) for _ in range(n))
        return "".join(f"<div>{link(1, 4)}</div>" for _ in range(n))

    def main_block() -> str:
        r = rng.random()
        if r < 0.62:
            body = inline(sentences(rng.choice([1, 1, 2, 3, 5, 9])))
            return f"<p>{m(body)}</p>" if rng.random() < 0.85 else f"<p><b>{m(body)}<br>"
        if r < 0.70:
            return f"<h{rng.choice('2234')}>{m(some(1, 8).capitalize())}</h2>".replace("</h2>", "") if rng.random() < 0.1 else f"<h2>{m(some(1, 8).capitalize())}</h2>"
        if r < 0.78:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{m(inline(some(2, 20)))}{rng.choice(['</li>', ''])}" for _ in range(rng.randint(2, 8))) + f"</{t}>"
        if r < 0.83:
            return f"<blockquote>{rng.choice(['', '<p>'])}{m(sentences(2))}</blockquote>"
        if r < 0.87:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m(some(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 6))) + "</table>"
        if r < 0.90:
            return f"<pre>{m(some(5, 40))}</pre>"
        if r < 0.93:
            return f"<figure><img src=x><figcaption>{m(some(3, 12))}</figcaption></figure>"
        if r < 0.97:
            return f"<div{name('', 1)}><p>{m(sentences(3))}</p><p>{m(sentences(2))}</p></div>"
        return f"<div>{m(sentences(3))}<br><br>{sentences(2)}</div>"

    def ad() -> str:
        t = rng.choice(["div", "div", "div", "aside", "section", "p"])
        body = rng.choice([some(2, 9), sentences(1), sentences(2), link(2, 8), f"<p>{some(3, 12)}</p>{link(1, 3)}"])
        return f"<{t}{name('ad', 0.97)}>{body}</{t}>"

    def share() -> str:
        return rng.choice([f"<div{name('form')}>{links(4)}</div>", f"<form{name('form')}><label>{some(1, 5)}</label><input name=q><p>{some(3, 15)}</p><button>{some(1, 2)}</button></form>", f"<form action=/s{name('form')}>{some(2, 8)}<input></form>"])

    def comments() -> str:
        one = lambda: f"<{t}{name('comment', 0.7)}>{rng.choice(['<b>' + some(1, 2) + '</b>', '<span>' + some(1, 2) + '</span>', ''])}<p>{sentences(rng.choice([1, 1, 2, 4]))}</p>{rng.choice(['', link(1, 1)])}</{t}>"
        t, outer = rng.choice([("div", "div"), ("li", "ol"), ("li", "ul"), ("article", "section"), ("div", "section")])
        return f"<{outer}{name('comment', 0.97)}><h3>{some(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 8))) + f"</{outer}>"

    def side() -> str:
        t = rng.choice(["aside", "div", "div", "section"])
        parts = [lambda: f"<h3>{some(1, 4)}</h3>{links(rng.randint(3, 9))}", lambda: f"<div{name('side')}><h4>{link(2, 8)}</h4><p>{sentences(1)}</p></div>", lambda: f"<h3>{some(1, 3)}</h3><p>{sentences(2)}</p>", ad]
        return f"<{t}{name('side', 0.95)}>" + "".join(rng.choice(parts)() for _ in range(rng.randint(1, 4))) + f"</{t}>"

    def nav() -> str:
        t = rng.choice(["nav", "nav", "div", "div", "td"])
        return f"<{t}{name('nav', 0.9 if t != 'nav' else 0.5)}>{links(rng.randint(3, 14))}</{t}>" if t != "td" else f"<table><tr><td>{links(rng.randint(4, 9))}</td></tr></table>"

    def head() -> str:
        t = rng.choice(["header", "header", "div"])
        return f"<{t}{name('head', 0.9)}>{rng.choice(['<h1>' + link(1, 4) + '</h1>', '<h2>' + some(1, 4) + '</h2>', '<a href=/>' + some(1, 3) + '</a>', some(1, 5)])}{rng.choice(['', '<p>' + some(2, 9) + '</p>', nav()])}</{t}>"

    def foot() -> str:
        t = rng.choice(["footer", "footer", "footer", "div"])
        return f"<{t}{name('foot', 0.95 if t == 'div' else 0.5)}>{rng.choice(['', links(5), '<p>' + sentences(2) + '</p>'])}{rng.choice(['&copy; ', '© 2024 ', ''])}{some(1, 4)} &middot; {sentences(1)}</{t}>"

    def notice() -> str:
        t = rng.choice(["div", "div", "section", "dialog"])
        return f"<{t}{name('notice', 0.98)}><p>{sentences(rng.choice([1, 2, 3]))}</p>{rng.choice(['', link(1, 2), '<button>' + some(1, 2) + '</button>'])}</{t}>"

    short = rng.random() < 0.15  # a headline and hardly more
    blocks = [f"<p>{m(some(1, 9))}</p>" if short else main_block() for _ in range(rng.choice([1, 1, 2, 4, 7, 12, 25]))]
    for _ in range(rng.choice([0, 0, 1, 2])):
        blocks.insert(rng.randint(0, len(blocks)), rng.choice([ad, ad, share, side])())
    title = m(some(2, 10).capitalize())
    top = rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", ""])
    tail = "".join(f() for f in rng.sample([share, comments, side], rng.choice([0, 0, 1])))
    inner = top + "".join(blocks) + tail
    wrap = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td", "none"])
    body = {"article": f"<article{name('main', 0.3)}>{inner}</article>", "main": f"<main>{inner}</main>", "div": f"<div{name('main')}>{inner}</div>", "section": f"<section{name('main')}>{inner}</section>", "td": f"<table><tr><td>{inner}</td></tr></table>", "none": inner}[wrap]
    sides = [side() for _ in range(rng.choice([0, 0, 1, 2]))]
    body = "".join(rng.sample([body, *sides], 1 + len(sides)))
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f"<div{name('', 1)}>{body}</div>"
    before = "".join(f() for f in rng.choice([[nav], [head, nav], [head], [nav, ad], [notice, head, nav], [nav, ad, notice], [], [head, nav, ad]]))
    after = "".join(f() for f in rng.choice([[foot], [foot], [comments, foot], [side, foot], [], [foot, notice], [ad, foot], [share, comments, side, foot]]))
    return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}<!-- {some(1, 3)} -->{body}{after}" + rng.choice(["</body></html>", ""])


# ---- operator


def learn_from_pages(pages: DataFrame, html: str = "html") -> Extractor:
    """Learn with the words of at most ``SAMPLE_PAGES`` pages, those with the smallest hashes."""
    hashed = pages.select(F.col(f"`{html}`").cast("string").alias("html")).where("html is not null").withColumn("h", F.xxhash64("html"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = hashed.where(F.col("h").isin(least)).dropDuplicates(["h"]).select("html").collect() if least else []
    words = [w for r in sample for leaf in walk(parse(r["html"])) if not leaf.tag for w in leaf.text.replace("<", "").replace("&", "").split(" ") if w and _MAIN not in w]
    return learn(words)


def extract(pages: DataFrame, extractor: Extractor, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` of every whole page; a null, empty or textless page has an empty text."""
    packed = extractor.to_json()
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias("__html"))
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + ["text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Extractor.shared(packed)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                last = part.num_columns - 1
                texts = own.texts(part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


@common.query("op9_boosted_extraction")
def op9_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, learn_from_pages(pages))
