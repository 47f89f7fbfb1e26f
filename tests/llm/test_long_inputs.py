"""One long text must cost time in proportion to its length; matching and decoding against plain enumeration."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np

from modelsift.llm import common, extraction, pieces, substrings, toxicity
from modelsift.llm.dom import parse, walk


def naive_find(lexicon: toxicity.Lexicon, folded: str) -> list:
    """The longest entry at each start, without those that lie in an exception phrase."""
    words = [(f" {e[:-1]}" if e.endswith("*") else f" {e} ", w) for e, w in lexicon.entries.items()]
    spared = [(i, i + len(p) + 2) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
    out = []
    for i in range(len(folded)):
        found = max(((len(w), weight) for w, weight in words if folded.startswith(w, i)), default=None)
        if found and not any(a <= i and i + found[0] <= b for a, b in spared):
            out.append((i, i + found[0], found[1]))
    return out


def test_matches_equal_a_naive_scan():
    rng = random.Random(3)
    for _ in range(400):
        word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        entries = {word() + rng.choice(["", "*"]): float(i + 1) for i in range(rng.randint(1, 6))}
        phrases = list({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 5))} - set(entries))
        lexicon = toxicity.Lexicon(entries, phrases, [0.0, 1.0, 1.0])
        folded = toxicity.fold(" ".join(word() for _ in range(rng.randint(0, 30))))
        assert sorted(toxicity.Matcher(lexicon).find(folded)) == naive_find(lexicon, folded)


def test_exceptions_in_a_long_text_are_linear():
    phrase = toxicity.fold("trash can").strip()
    matcher = toxicity.Matcher(toxicity.Lexicon({phrase.split()[0]: 1.0}, [phrase], [0.0, 1.0, 1.0]))
    begun = time.process_time()
    assert matcher.measure("trash can " * 100_000 + "trash")[1] == 1
    assert time.process_time() - begun < 5


def test_unclosed_elements_are_linear():
    begun = time.process_time()
    for page in ("<div>" * 100_000 + "x" + "</p>" * 100_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>" + "<span>" * 100_000 + "<a>x" * 50_000):
        assert any("x" in n.text for n in walk(parse(page)) if not n.tag)
    assert time.process_time() - begun < 15


def test_end_tags_close_the_innermost_element_of_their_name():
    leaves = lambda h: [n.text for n in walk(parse(h)) if not n.tag]
    assert leaves("<div>a<div>b</div>c</section>d</div>e") == ["a", "b", "cd", "e"]
    assert leaves("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f") == ["a", "b", "c", "d", "e", "f"]
    assert leaves("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>") == ["a", "b", "c", "d"]
    assert leaves("<p>a<button><div>b</div></button>") == ["a"]


def test_merge_rounds_equal_the_queue():
    rng = random.Random(9)
    coder = pieces.PieceCoder("piece_bpe_32k.model", 0.3)
    words = [" " + "".join(rng.choice("abcdeeeiinnorrsttu" if rng.random() < 0.9 else "éß字") for _ in range(rng.randint(1, 18))) for _ in range(1500)]
    draws = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    for word, draw, got in zip(words, draws.tolist(), coder._together(words, draws)):
        assert np.frombuffer(got, "<u4").tolist() == coder.agenda(word, draw)


def test_more_shards_change_no_span(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (50, 70, 120, 300)]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", "x", "yy"]) for _ in range(5))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = sorted((r["doc_id"], r["spans"]) for r in substrings.remove_repeats(df).collect())
    monkeypatch.setattr(substrings, "SHARD_BYTES", 500)
    monkeypatch.setattr(substrings, "BLOCK", 7)
    assert sorted((r["doc_id"], r["spans"]) for r in substrings.remove_repeats(df).collect()) == want


def test_names_of_the_input_do_not_clash(spark):
    names = ["own", "Runs", "__id", "__spans"]
    df = spark.createDataFrame([(1, "ab" * 60, 1, 2, 3, 4), (2, "ab" * 60, 5, 6, 7, 8)], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    out = {r["doc_id"]: r for r in substrings.without_repeats(df).collect()}
    assert out[1]["text"] == "ab" * 60 and out[2]["text"] == "" and [out[2][n] for n in names] == [5, 6, 7, 8]
    assert common.unused(["a", "A_"], "a") == "a__"


def test_decoding_equals_enumeration():
    """The kept leaves are those of the best way to call every node kept, dropped or mixed without contradiction."""
    rng = np.random.default_rng(2)
    nodes = walk(parse("<div><p>aa bb<p>cc</div><section><h2>dd</h2><div>ee ff gg<ul><li>h<li>ii</ul></div></section>"))
    number, chance = {id(n): i for i, n in enumerate(nodes)}, lambda z: -np.logaddexp(0, -z)
    seen = set()
    for _ in range(60):
        main, mixed = rng.normal(0, 3, len(nodes)), rng.normal(0, 3, len(nodes))

        def ways(node) -> list[tuple[float, frozenset]]:
            """Score and kept leaves of each choice for a node and all below it."""
            i, below = number[id(node)], [m for m in nodes if _inside(m, node)]
            out = []
            for sign in (1, -1):  # all kept, all dropped
                score = sum(chance(sign * main[number[id(m)]]) + (chance(-mixed[number[id(m)]]) if m.tag else 0) for m in below)
                out.append((score, frozenset(number[id(m)] for m in below if not m.tag and sign == 1)))
            if node.tag:
                for choice in itertools.product(*(ways(k) for k in node.kids if k.chars)):
                    out.append((chance(mixed[i]) + sum(c[0] for c in choice), frozenset().union(*(c[1] for c in choice))))
            return out

        got = frozenset(i for i, (n, k) in enumerate(zip(nodes, extraction.decode(nodes, main, mixed))) if k and not n.tag)
        assert got == max(ways(nodes[0]), key=lambda w: w[0])[1]
        seen.add(got)
    assert len(seen) > 5


def _inside(node, top) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top
