"""Spelling variants against all pairs, chat formatting against a plain formatter, clusters against plain distances."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from modelsift.llm import centroids, chat, spelling
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_trie_variants", "op12_prefix_target_chat", "op13_bisector_clusters"])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


# ---- spelling variants


def one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts: dict[str, int], ratio: int = 2) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(spark, counts: dict[str, int]) -> dict[str, tuple]:
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n bigint, near string, salt int").repartition(3)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


@pytest.mark.parametrize("heavy", [5_000, 3])
def test_variants_equal_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(spelling, "HEAVY", heavy)  # 3: nearly every node is salted
    rng = random.Random(heavy)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(700)}
    words |= {"reier", "leier", "abcba", "abcda", "level", "lever", "aaaaa", "aaaa", "aaaaaa", "a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 149, "b" + "a" * 299}
    counts = {w: rng.choice([1, 2, 3, 6, 12, 25]) for w in words}
    assert found(spark, counts) == brute(counts)


def test_long_and_nested_words(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    counts = {long: 9, long[:-1]: 4, long[1:]: 4, long[:10_000] + long[10_001:]: 2, "z" + long[1:]: 1, "short": 5, **{"n" * i: i for i in range(5, 25)}}
    assert found(spark, counts) == brute(counts)


def test_no_words(spark):
    assert found(spark, {}) == {}
    assert spelling.neighbours(spark.createDataFrame([(None,), ("a",), ("a",), ("",)], "word string")).count() == 2


def test_vocabulary_equals_plain_counts(spark, awkward):
    rows = awkward.select("doc_id", "text").collect()
    want: Counter = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            want[run] += len(run) >= 5
    got = {r["word"]: r["n"] for r in spelling.vocabulary(awkward, noise=5).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3}


def test_variants_of_nothing(spark, nothing):
    assert spelling.variants(spelling.vocabulary(nothing)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0


# ---- chat


PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "</turn>\n", "### User: ", "\n", "a", "é", "😀", "</", "turn>"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "Assistant", "tool", "", 'q"### </turn>\\']), PIECES), max_size=5))
def test_formatted_turns_read_back(turns):
    formatted = "".join(chat.turn(r, t) for r, t in turns)
    read = chat.parse(formatted)
    assert [(r, t) for r, t, _, _ in read] == turns
    assert all(chat.unescape(formatted[a:b]) == t for _, t, a, b in read)


def talks(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c} ### x </turn> \\") for c in range(4) for t in range(2 * c + 1)]
    rows += [(9, 0, "user", None), (9, 1, "assistant", ""), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (9, None, None, "first"), (None, 0, "assistant", "no id"), (None, 1, "tool", "x" * 300_000)]
    rows += [(10, i, ["assistant", "user"][i % 2], f"m{i}") for i in range(3000)]
    return rows, spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string, position int").repartition(4)


def plain(rows: list[tuple]) -> dict:
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        spoken = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        masked = "".join(t or "" for _, _, r, t in own if r == "assistant")
        formatted = "".join(chat.turn(r or "", t or "") for _, _, r, t in own)
        out[c] = (c, len(own), hashlib.sha256(spoken.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted))
    return out


def test_digest_equals_a_plain_formatter(spark):
    rows, df = talks(spark)
    got = {r["conv_id"]: tuple(r) for r in chat.digest(chat.expand(df)).collect()}
    assert got == plain(rows)


def test_examples_hold_all_turns_before_and_mask_one_reply(spark):
    rows, df = talks(spark)
    some = [r for r in rows if r[0] != 10]
    examples = {(r["conv_id"], r["example"]): r for r in chat.render(chat.expand(df.where("conv_id is null or conv_id <> 10"))).collect()}
    assert len(examples) == sum(r[2] == "assistant" for r in some)
    for c in {r[0] for r in some}:
        own = sorted((r for r in some if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        targets = [i for i, r in enumerate(own) if r[2] == "assistant"]
        for k, i in enumerate(targets):
            e = examples[c, k]
            assert e["text"] == "".join(chat.turn(r or "", t or "") for _, _, r, t in own[: i + 1])
            assert chat.unescape(e["text"][e["loss_start"]:e["loss_end"]]) == (own[i][3] or "")
            assert e["text"][e["loss_end"]:] == chat.CLOSE


def test_chat_of_nothing(spark):
    _, df = talks(spark)
    assert chat.digest(chat.expand(df.where("false"))).count() == 0
    assert chat.render(chat.expand(df.where("false"))).count() == 0


# ---- clusters


def plain_clusters(vectors: dict[int, list], k: int, rounds: int) -> tuple[dict, list]:
    x = {i: [int(np.floor(1024 * float(c))) for c in v] for i, v in vectors.items()}
    order = sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    cent = [list(x[i]) for i in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        at = {i: near(v)[1] for i, v in x.items()}
        for j in range(len(cent)):
            own = [x[i] for i in x if at[i] == j]
            if own:
                cent[j] = [sum(c) // len(own) for c in zip(*own)]
    return {i: near(v) for i, v in x.items()}, cent


@pytest.mark.parametrize("n,spread", [(300, 0.02), (300, 3.0), (5, 1.0), (60, 0.0)])
def test_clusters_equal_plain_distances(spark, n, spread):
    rng = np.random.default_rng(n)
    good = {i: (rng.integers(-2, 3, 6) + spread * rng.standard_normal(6)).tolist() for i in range(n)}
    bad = [(1001, None), (1002, []), (1003, [1.0] * 5), (1004, [None] + [1.0] * 5), (1005, [float("nan")] * 6), (1006, [float("inf")] * 6), (1007, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in [*good.items(), *bad]], "vec_id bigint, embedding array<double>, id string, x int, cluster int").repartition(5)
    want, cent = plain_clusters(good, 8, 10)
    got = {r["vec_id"]: r for r in centroids.clusters(df, 8, 10, 6).collect()}
    assert {i: (r["distance"], r["cluster"]) for i, r in got.items()} == want
    for i, (_, c) in want.items():
        assert got[i]["cluster_inertia"] == sum(d for d, j in want.values() if j == c)
        assert got[i]["inertia"] == sum(d for d, _ in want.values())
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()


def test_clusters_of_ties_nulls_and_nothing(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert centroids.clusters(spark.createDataFrame([], schema), 3, 4, 2).count() == 0
    rows = centroids.clusters(spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5]), (2, [9.0, 9.0])], schema), 8, 3, 2).collect()
    assert len(rows) == 4 and all(r["distance"] == 0 for r in rows)
    assert [r["cluster"] for r in rows if r["vec_id"] != 2] == [min(r["cluster"] for r in rows if r["vec_id"] != 2)] * 3


def test_tournament_at_the_largest_components():
    rng = np.random.default_rng(5)
    c = rng.choice([-centroids.LARGEST, centroids.LARGEST], (8, 64)).astype(np.int64)
    x = rng.choice([-centroids.LARGEST, centroids.LARGEST], (50, 64)).astype(np.int64)
    winner, distance = centroids.nearest(x, c, *centroids.bisectors(c))
    for i in range(len(x)):
        exact = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], r)), j) for j, r in enumerate(c))
        assert exact == (distance[i], winner[i])
