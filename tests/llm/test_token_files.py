"""Simple-8b files and packing against plain encoders and one-by-one best fit."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from modelsift.llm import common, packing, simple8b
from modelsift.llm.tokens import WordEncoder, tokenizer_path

from .conftest import texts


def library_ids(file: str, text: str | None) -> list[int]:
    t = Tokenizer.from_file(tokenizer_path(file))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_library(file):
    odd = ["a  b   c \n d\n\n e ", "  lead", "x　 y \x1c z 'S its  don't DON'T", "", "été ΣΑΣ İstanbul", "tab\t\ttab   nbsp  em", "<|endoftext|> <|startoftext|>", "12 345,678.9 !!! ???...", "a" * 4000, "字字 😀😀 ​ x"]
    rng = random.Random(2)
    odd += ["".join(rng.choice("ab \n\t'sé.,1😀  ") for _ in range(60)) for _ in range(300)]
    got = WordEncoder(file).encode_all(odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library_ids(file, t) for t in odd]


def test_simple8b_round_trips():
    rng = np.random.default_rng(1)
    for a in ([], [0], [5] * 1000, rng.integers(0, 50257, 5000), rng.integers(0, 2, 777), [2**63, 1, 2**60, 15 << 60, 3] * 90, [2**60 - 1] * 3):
        a = np.array(a, np.uint64)
        p = simple8b.pack(a)
        assert (simple8b.unpack(p) == a).all() and len(simple8b.unpack(p)) == len(a)
        for _ in range(10 if len(a) else 0):
            s = int(rng.integers(0, len(a)))
            n = int(rng.integers(0, len(a) - s + 1))
            assert (simple8b.unpack_range(p, s, n) == a[s : s + n]).all()
    with pytest.raises(IndexError):
        simple8b.unpack_range(simple8b.pack(np.arange(4)), 3, 2)


def test_token_file_of_awkward_rows(spark, awkward, nothing):
    path = common.scratch(spark, "t")
    simple8b.write_tokens(awkward, path, "byte_bpe_50k.json", 2)
    got = simple8b.read_tokens(spark, path).collect()
    assert len(got) == awkward.count()
    want, at = texts(awkward), 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = [*library_ids("byte_bpe_50k.json", want[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    path = common.scratch(spark, "t")
    simple8b.write_tokens(nothing, path, "byte_bpe_50k.json", 2)
    assert simple8b.read_tokens(spark, path).count() == 0


def test_best_fit_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([10, 17, 64, 4096])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        counts = {n: lengths.count(n) for n in lengths}
        bins: dict[int, list[tuple[int, int]]] = {}
        for n, lo, hi, s, per, base in packing.best_fit(counts, cap):
            for j in range(lo, hi):
                bins.setdefault(s + (j - lo) // per, []).append((base + (j - lo) % per * n, n))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= cap
        room: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=room.__getitem__)] -= n
            else:
                room.append(cap - n)
        assert sorted(room) == sorted(cap - sum(n for _, n in b) for b in bins.values())


def test_packing_of_awkward_rows(awkward, nothing):
    got = packing.pack_documents(awkward, "word_bpe_49k.json", 1).collect()
    want = texts(awkward)
    by_doc: dict[object, list] = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, pieces in by_doc.items():
        ids = [*library_ids("word_bpe_49k.json", want[k]), 1]
        copies = 2 if k == 7 else 1
        assert len(pieces) == copies * -(-len(ids) // 4096)
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(part)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(nothing, "word_bpe_49k.json", 1).count() == 0


def test_sequences_hold_the_ids(spark, awkward):
    pieces = common.settled(packing.cut_pieces(awkward, "word_bpe_49k.json", 1, capacity=64, with_ids=True), "p")
    placed = packing.place(pieces, 64)
    total = sum(len(r["ids"]) for r in packing.sequences(placed).collect())
    assert total == sum(r["length"] for r in pieces.collect())


def test_odd_lengths_get_no_place(spark):
    rows = spark.createDataFrame([(1, 0), (2, None), (3, 5), (4, 99), (5, 5)], "k int, length bigint")
    got = {r["k"]: r["sequence_id"] for r in packing.place(rows, 10).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and got[3] == got[5] == 0
