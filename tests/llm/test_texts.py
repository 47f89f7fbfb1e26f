"""Joins, substrings, toxicity, licences and pieces against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
import sentencepiece

from modelsift.llm import jaccard, licenses, pieces, substrings, suffixes, toxicity
from modelsift.llm.shingles import shingle_sets
from modelsift.llm.tokens import tokenizer_path

from .conftest import rows_by_id, texts

REPO, SF = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text: str | None, n: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(sets: dict, num: int, den: int) -> dict:
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 60)])
def test_join_equals_brute_force(spark, n, num):
    rng = random.Random(num)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 40, 120, 400]))] for _ in range(12)]
    docs = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        docs.append((i, " ".join(words)))
    classes, _ = jaccard.join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), n, num, 100)
    got = rows_by_id(classes)
    sets = {i: brute_set(t, n) for i, t in docs}
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i]["component_id"] for i in sets} == brute_components(sets, num, 100)


def test_schemes_lose_no_link():
    rng = np.random.default_rng(4)
    for num in (60, 80, 90, 95):
        for size in (4, 9, 10, 25, 63, 64, 65, 200, 900):
            for _ in range(6):
                s = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                worst = (100 - num) * 2 * len(s) // (100 + num)
                gone = int(rng.integers(0, worst // 2 + 1))
                t = np.unique(np.concatenate((s[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64))))
                both = np.intersect1d(s, t).size
                if 100 * both >= num * (s.size + t.size - both) and gone:
                    often = np.sort(rng.choice(s, s.size // 3))
                    assert np.intersect1d(jaccard.signatures(s, num, 100, often), jaccard.signatures(t, num, 100, often)).size


def test_join_of_awkward_rows(awkward, nothing):
    classes, links = jaccard.join(awkward, 3, 90, 100)
    got = classes.collect()
    assert len(got) == awkward.count()
    sets = {k: brute_set(t, 3) for k, t in texts(awkward).items() if k is not None}
    want = brute_components(sets, 90, 100)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    classes, links = jaccard.join(nothing, 3, 90, 100)
    assert classes.count() == 0 and links.count() == 0


def test_shingles_lower_only_ascii():
    a, b, c = shingle_sets(["ÄB c", "Äb C", "äb c"], 2)
    assert a.tolist() == b.tolist() != c.tolist()


@pytest.mark.parametrize("memory", [1 << 28, 200])
def test_suffixes_equal_plain_sorting(memory):
    rng = np.random.default_rng(memory % 97)
    for _ in range(120):
        n, depth = int(rng.integers(1, 250)), int(rng.choice([3, 8, 10, 50]))
        alphabet = int(rng.choice([1, 2, 3, 5, 256]))
        d = rng.integers(0, alphabet, n).astype(np.uint8)
        b, at, lcp = d.tobytes(), [], []
        for a, c in suffixes.sorted_suffixes(d, depth, memory):
            at += a.tolist()
            lcp += c.tolist()
        keys = [b[i : i + depth] for i in at]
        assert sorted(at) == list(range(n)) and keys == sorted(keys)
        for i in range(1, n):
            x, y, k = keys[i - 1], keys[i], 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert lcp[i] == k


def brute_repeats(docs: dict, size: int = 50) -> dict:
    first: dict[bytes, int] = {}
    out = {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in first:
                gone[p : p + size] = b"\x01" * size
            else:
                own.append(w)
        first.update(dict.fromkeys(own, i))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len([s for s in bytes(gone).split(b"\x00") if s]), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, awkward, nothing):
    rng = random.Random(8)
    parts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (20, 49, 50, 51, 60, 90, 200, 400)]
    docs = {i: "".join(rng.choice(parts) + rng.choice(["", "x", "yy"]) for _ in range(rng.randint(0, 6))) for i in range(90)}
    docs |= {100: "a" * 300, 101: "b" + "a" * 49, 102: "a" * 50 + "c", 103: "ab" * 200, 104: "ba" * 60, 105: None, 106: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(df).collect()}
    assert got == brute_repeats(docs)
    known = {k: t for k, t in texts(awkward).items() if k is not None}
    rows = substrings.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    want = brute_repeats(known)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    assert substrings.remove_repeats(nothing).count() == 0


def test_cut_texts_stay_text(spark, awkward, nothing):
    docs = [(1, "é" * 80 + "x"), (2, "y" + "é" * 60), (3, "z" + "é" * 24 + "ê" * 40), (4, None)]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id bigint, text string, n_chars bigint")
    got = rows_by_id(substrings.without_repeats(df, length="n_chars"))
    assert got[1]["text"] == docs[0][1] and got[2]["text"] == "y" and got[4]["text"] is None
    assert all(r["text"] is None or len(r["text"]) == r["n_chars"] for r in got.values())
    out = substrings.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert substrings.without_repeats(nothing).count() == 0


def test_merge_dropout_equals_the_library_without_dropout():
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    coder = pieces.PieceCoder("piece_bpe_32k.model", 0.0)
    odd = ["a  b   c \n d\n\n e ", "  lead", "字é😀 <0x0A> \t\t tab", "a" * 3000, " ", "The quick brown fox's 12,345 jumps!", "<s> </s> <unk>", "é"]
    got = coder.encode_all(odd, list(range(len(odd))))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [model.encode(t) for t in odd]


def test_merge_dropout_varies_and_decodes(awkward, nothing):
    coder = pieces.PieceCoder("piece_bpe_32k.model", 0.3, variants=8)
    words = [" worthless", " extraordinary", " internationalization", " a", "über"]
    for v in range(8):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder._together(words, v)] == [coder.agenda(w, v) for w in words]
    assert len({tuple(coder.agenda(" internationalization", v)) for v in range(8)}) > 2
    again = pieces.PieceCoder("piece_bpe_32k.model", 0.3, variants=8)
    assert coder.encode_all(["some text here"] * 2, [1, 2]) == again.encode_all(["some text here"] * 2, [1, 2])
    coded = pieces.encode(awkward, "piece_bpe_32k.model", dropout=0.3, check=True)
    assert coded.where("not lossless").count() == 0 and coded.count() == awkward.count()
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded, "piece_bpe_32k.model").collect()}
    assert back == {k: t or "" for k, t in texts(awkward).items()}
    assert pieces.encode(nothing, "piece_bpe_32k.model").count() == 0


def test_merge_dropout_draws_every_occurrence_anew():
    text = "internationalization\nof\tthe  extraordinary 字é " + "x" * 90
    tokens = pieces._RUNS.findall(" " + text)
    coder, rng = pieces.PieceCoder("piece_bpe_32k.model", 0.3), np.random.default_rng(1)
    names = rng.integers(-(2**62), 2**62, 300).tolist()
    got = coder.encode_all([text] * 300, names)
    assert len(set(got)) == 300 and got[:7] == pieces.PieceCoder("piece_bpe_32k.model", 0.3).encode_all([text] * 7, names[:7])
    for name, ids in zip(names, got):  # the kept outcomes are those of each occurrence's own key
        base = pieces.mix(np.array([(name * pieces._GOLD ^ coder.seed) & (2**64 - 1)], np.uint64))
        draws = pieces.mix(np.arange(len(tokens), dtype=np.uint64) + base).tolist()
        assert np.frombuffer(ids, "<u4").tolist() == [x for w, d in zip(tokens, draws) for x in coder.agenda(w, d)]
    one = coder.encode_all([" ".join(["extraordinary"] * 1000)], [5])[0]
    assert one != coder.encode_all([" ".join(["extraordinary"] * 1000)], [6])[0]
    short = coder.encode_all(["of the " * 500], [5])[0]
    assert short == pieces.PieceCoder("piece_bpe_32k.model", 0.3).encode_all(["of the " * 500], [5])[0] and len(coder.outcomes[coder.words[" the"]]) > 4


def test_fold():
    assert toxicity.fold("1D10T") == toxicity.fold("\u0456d\u0456\u043et") == toxicity.fold("idiot") == toxicity.fold("ïd!ôt") == toxicity.fold("id​iot")
    assert toxicity.fold(None) == toxicity.fold("") == " " and toxicity.fold(" ,. ").strip() == ""


def test_matches_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("trash").strip(): 2.0, toxicity.fold("stup").strip() + "*": 1.0}, [toxicity.fold("trash can").strip()], [0, 1, 1])
    m = toxicity.Matcher(lexicon)
    assert m.measure("You are TR4SH, a stupidity of trash trash.")[:2] == (7.0, 4)
    assert m.measure("the trash can is full")[:2] == (0, 0) and m.measure("trashy astupid")[:2] == (0, 0)
    assert m.measure(None) == (0, 0, 1) and toxicity.Matcher(toxicity.Lexicon({}, [], [0, 0, 0])).measure("x")[1] == 0


def test_learned_lexicon_separates(spark, awkward, nothing):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["gromble", "fnarkest", "fnarkish", "fnarkum"]))
        rows.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    lexicon = toxicity.learn(df.where("doc_id % 5 <> 0"))
    got = rows_by_id(toxicity.measure(df.where("doc_id % 5 = 0"), lexicon))
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0) >= 118
    odd = toxicity.measure(awkward, lexicon).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.measure(nothing, lexicon).count() == 0
    only = toxicity.learn(df.where("label = 0"))
    assert not only.entries and max(r["score"] for r in toxicity.measure(df.limit(3), only).collect()) < 0.5


def test_licences_of_awkward_rows(spark, awkward, nothing):
    mit = licenses.KNOWN["MIT"]
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n" + mit.replace("sublicense", "sub­license".replace("­", ""))), (2, mit.upper().replace(",", ";")), (3, mit + " and more"), (4, "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0"), (5, None), (6, "")], "doc_id bigint, text string")
    got = rows_by_id(licenses.scan(docs, licenses.known_texts(spark)))
    assert [got[i]["license_id"] for i in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[5]["notices"] is None and got[5]["digest"] == got[6]["digest"]
    assert licenses.scan(awkward.where("doc_id is null or doc_id <> 7"), licenses.known_texts(spark)).count() == awkward.count() - 2
    assert licenses.scan(nothing, licenses.known_texts(spark)).count() == 0


def test_entire_licences_at_several_widths(spark):
    import textwrap

    rows = []
    for name, text in licenses.entire_texts():
        notice = re.compile(licenses._COPYRIGHT)
        for width in (40, 57, 66, 72, 79, 100, 100_000):
            lines, run = [], []
            for line in [*text.split("\n"), ""]:
                if notice.match(line.lower()) or not line.strip():
                    lines += [*textwrap.wrap(" ".join(run), width, break_long_words=False, break_on_hyphens=False), line]
                    run = []
                else:
                    run.append(line)
            rows.append((len(rows), "Copyright (c) 2020 Someone\n" + "\n".join(lines), f"{name} {width}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, name string")
    got = rows_by_id(licenses.scan(docs, licenses.known_texts(spark)))
    assert [n for i, _, n in rows if got[i]["license_id"] != n.split(" ")[0]] == []
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "BSL-1.0", "Unlicense"} <= {r["license_id"] for r in got.values()}
    mit = licenses.KNOWN["MIT"].replace("MIT License", "The MIT License (MIT)", 1)
    assert rows_by_id(licenses.scan(spark.createDataFrame([(1, mit)], "doc_id bigint, text string"), licenses.known_texts(spark)))[1]["license_id"] == "MIT"


def test_long_words_that_fool_polynomials_do_not_link(spark):
    """Complementary Thue-Morse words have equal polynomial hashes modulo 2 ** 64 for every base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, f"{one} x y z"), (4, " ".join(["abcdefgh1", "abcdefgh2", "abcdefgh", "abcdefghi" * 7]))]
    classes, _ = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()} == {1: (2, 1), 2: (2, 2), 3: (2, 1), 4: (2, 4)}
    words = ["a" * k for k in range(1, 200)] + ["a" * k + "b" + "a" * (80 - k) for k in range(80)]
    for seed in (0, 1):
        assert len({int(shingle_sets([w], 1, seed)[0][0]) for w in words}) == len(words)


def test_workers_need_no_package(tmp_path):
    """Queries run where only the driver can import the package."""
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
for name in ("op8_jaccard_join", "op11_trie_variants", "op12_prefix_target_chat", "op13_bisector_clusters"):
    assert e.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)
