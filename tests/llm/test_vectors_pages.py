"""Vector searches against brute force, page extraction against known pages, the pipeline against its parts."""

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from modelsift.llm import common, extraction, hyperplanes, pstable
from modelsift.llm.dom import parse, walk
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def make_vectors(spark, n: int = 700, seed: int = 1, dim: int = 24):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 7, dim))
    x = centre[rng.integers(0, len(centre), n)] + 0.05 * rng.standard_normal((n, dim))
    x[5], x[6] = x[4], x[4]
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(n)]
    rows[0] = (0, None, 1)
    rows[1] = (1, [0.0] * dim, 1)
    rows[2] = (2, [float("nan")] + [1.0] * (dim - 1), 1)
    rows[3] = (3, [None] + [1.0] * (dim - 1), 1)
    rows[7] = (7, rows[7][1], None)
    rows[100], rows[200] = (100, [float("inf")] * dim, 0), (200, [], 0)
    return rows, spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, id string, code int").repartition(5)


def good(v) -> bool:
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplanes, "BLOCK", block)
    rows, df = make_vectors(spark)
    got = {r["vec_id"]: r for r in hyperplanes.near_duplicates(df, 0.98).collect()}
    use = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if good(v) and y is not None]
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, x, y in use:
        for b, z, w in use:
            if a < b and y == w and x @ z >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    assert sum(links.values()) > 100
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in up} == {i: (links[i], top(i), top(i) == i) for i in up}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hyperplanes.near_duplicates(empty, 0.98).count() == 0 and pstable.search(empty, empty, 10).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(r["n_links"] for r in hyperplanes.near_duplicates(bad, 0.98).collect()) == [0, 0] and pstable.search(bad, bad, 10).count() == 0


def test_search_recall_and_order(spark):
    rows, df = make_vectors(spark, 1500, 3)
    got: dict[int, list] = {}
    for r in pstable.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.array(v) for i, v, _ in rows if good(v)}
    assert set(got) == {i for i in x if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11)) and [f[2] for f in found] == sorted(f[2] for f in found)
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(got)


def test_search_of_few_rows_is_exact(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(9, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [r["vec_id"] for r in pstable.search(df, df.where("vec_id = 2"), 10).orderBy("rank").collect()]
    assert got == [9, 1, 3, 0, 4]


def test_reader():
    leaves = lambda h: [n.text for n in walk(parse(h)) if not n.tag]
    assert leaves("<p>a &amp; <b>b</b>c<br>d<p>e</p><script>x='<p>'</script>f<!-- g -->") == ["a & bc d", "e", "f"]
    assert leaves("<ul><li>a<li>b</ul><textarea>t</textarea><form>q<input>z</form>") == ["a", "b", "qz"]
    assert leaves("<div class='x>'>a</div><p title=\"y>\">b") == ["a", "b"]
    assert leaves(None) == leaves("") == [] and leaves("<") == ["<"]
    assert leaves("a < b <c") == ["a < b <c"]
    deep = "<div>" * 3000 + "x" + "</div>" * 2000
    assert leaves(deep) == ["x"]


@pytest.mark.parametrize("page", ["<html><head><title>t</title><body><p>a</p></body></html>", "<html><head><title>t</title><meta x></head><p>a</html>", "<html><head><title>t</title><link x><p>a</html>", "<head><title>t</title>a", "<head><script>'<p>'</script></html>a", "<head><noscript><img></noscript><style>p{}</style><div>a</div>", "<head><noscript><link><body>a", "<head><template><p>b</p><body></template><body>a", "<head><br>a"])
def test_a_head_ends_without_its_tag(page):
    assert [n.text for n in walk(parse(page)) if not n.tag] == ["a"]


@pytest.fixture(scope="module")
def extractor():
    rng = random.Random(1)
    return extraction.learn(["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(500)])


def test_extraction_of_unseen_layouts(extractor):
    rng, words = random.Random(77), [f"w{i}" for i in range(300)]
    right = kept = wanted = 0
    for _ in range(120):
        nodes, label = extraction._label(extraction.build_page(rng, words))
        x = extraction.features(nodes)
        for node, y, k in zip(nodes, label, extraction.decode(nodes, extractor.main.margin(x), extractor.mixed.margin(x))):
            if not node.tag:
                right, kept, wanted = right + node.chars * (y == 1 and k), kept + node.chars * k, wanted + node.chars * (y == 1)
    assert right / kept > 0.95 and right / wanted > 0.95


def long_page(blocks: int, seed: int) -> tuple[str, str]:
    """A page of so many paragraphs with headings and adverts among them, and its main text."""
    rng, words, body, want = random.Random(seed), [f"w{i}" for i in range(300)], [], []
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    for i in range(blocks):
        if i % 40 == 20:
            body.append(f'<div class="sponsored"><p>{say(8, 20)}. {say(8, 20)}.</p></div>')
        if i % 25 == 0:
            want.append(say(1, 4).capitalize())
            body.append(f"<h2>{want[-1]}</h2>")
        want.append(". ".join(say(3, 20).capitalize() for _ in range(rng.choice([1, 1, 2, 5]))) + ".")
        body.append(f"<p>{want[-1]}</p>")
    return f"<html><head><title>x</title></head><body><nav><ul><li><a href=/>a b</a></li><li><a href=/>c d</a></li></ul></nav><div>{''.join(body)}</div><footer>© 2024 w1 w2. <a href=/>w3</a></footer></body></html>", " ".join(want)


def test_features_of_many_siblings_are_exact():
    nodes = walk(parse(long_page(700, 0)[0]))
    kinds = {k: i for i, names in enumerate(extraction._KINDS) for k in names}
    for node, row in zip(nodes, extraction.features(nodes)):
        sibs = [k for k in node.parent.kids if k.chars] if node.parent else [node]
        place = [k is node for k in sibs].index(True)
        assert row[18:21].tolist() == [np.log1p(len(sibs)), place / len(sibs), sum(k.tag == node.tag for k in sibs) / len(sibs)]
        before, after = sibs[place - 1] if place else None, sibs[place + 1] if place + 1 < len(sibs) else None
        assert row[25:31].tolist() == [v for k in (before, after) for v in ((k.linked / k.chars, np.log1p(k.chars), kinds.get(k.tag, 5)) if k else (-1, -1, -1))]


@pytest.mark.parametrize("seed", [1, 2])
def test_extraction_of_long_pages(extractor, seed):
    page, text = long_page(260, seed)
    assert extractor.texts([page]) == [text]


def test_decoding_never_contradicts(extractor):
    rng = random.Random(5)
    for _ in range(30):
        nodes = walk(parse(extraction.build_page(rng, ["a", "b"])))
        noise = np.random.default_rng(1).standard_normal((2, len(nodes))) * 5
        keep = dict(zip(map(id, nodes), extraction.decode(nodes, *noise)))
        for n in nodes:
            if keep[id(n)]:
                assert all(keep[id(k)] for k in n.kids if k.chars)


def test_extraction_of_awkward_pages(spark, extractor):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>" * 50, 3), (4, "u", "plain words only", 4), (5, "u", "<article><h1>T</h1>" + "<p>some words here and there.</p>" * 5000 + "</article>", 5), (6, "u", "<p>" + "x" * 300_000, 6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in extraction.extract(df, extractor).collect()}
    assert len(got) == 6 and got[1]["text"] == got[2]["text"] == got[None]["text"] == "" and got[5]["n_chars"] == len(got[5]["text"]) > 100_000
    assert extraction.extract(df.limit(0), extractor).count() == 0


def test_given_pages(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in entry.queries()["op9_boosted_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br|article)>", " ", inner))
        assert got[r["page_id"]] == " ".join(html.unescape(text).split())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (4, 4)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up: dict[int, int] = {}
    for a, b in edges:
        if a is not None and a != b:
            up.setdefault(a, a)
            up.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_license_query_matches_sql(spark):
    assert compare(spark, connect(SF), SF, entry.queries()["op6_license_digests"], entry.oracle_sql()["op6_license_digests"]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.settled(stage(spark, docs, SF), "stage")
        if i < 3:
            assert docs.columns == names and docs.join(before, "doc_id", "left_anti").isEmpty()
    ids = {r["doc_id"] for r in before.collect()}
    assert {r["doc_id"] for r in docs.collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
