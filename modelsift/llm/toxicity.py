"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lower-cases, drops accents and invisible characters, maps look-alike letters of other scripts and digits or signs
used as letters to one Latin letter, and turns everything between words into one space, so ``1d10t`` and its Cyrillic
look-alike meet the same entry.  An entry is a word or a word beginning; exception phrases cancel the entries inside them.

The lexicon, its weights and the exceptions are learned from labelled rows: document counts per class give log-odds.
A logistic curve over the matched weight and its share of the words turns them into a score.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import worker_store

TRAIN_ROWS = 12_000     # labelled rows that are learned from, about
SHORTEST, LONGEST = 4, 12  # letters of a word beginning
KEEP_SHARE = 0.95       # a longer entry replaces a shorter one when it keeps this share of its toxic documents
MIN_LIFT = 6.0          # toxic share over clean share an entry needs
MIN_EVIDENCE = 28.0     # and its log-likelihood ratio: chance alone, over all candidates, reaches it in no corpus
MAX_ENTRIES = 5_000

# fixed values: letters of other scripts that look like Latin ones, and signs written for letters
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ь": "b", "г": "r",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "γ": "y", "σ": "o", "ς": "c", "μ": "u",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ᴏ": "o", "ᴄ": "c", "ᴇ": "e", "ᴍ": "m", "ᴛ": "t", "ᴜ": "u",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "£": "l"}
INVISIBLE = "­͏؜᠎​‌‍⁠﻿"
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash talk", "clown fish", "clown car", "pathetic fallacy", "pond scum", "soap scum")

_BETWEEN = re.compile(r"[\W_]+")
_INNER = re.compile(r"(?<=\w)!(?=\w)")


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    out |= {ord(k): v for k, v in {**LOOKALIKES, **SIGNS}.items()}
    for code in range(0xC0, 0x250):  # Latin letters with accents
        base = unicodedata.normalize("NFKD", chr(code).lower())[0]
        if base.isascii() and base.isalpha():
            out.setdefault(code, base)
    out |= {code: None for code in range(0x300, 0x370)}  # combining marks
    # l, i, 1, | and ! stand for one another: all become i
    return {k: "i" if v == "l" else v for k, v in out.items()} | {ord("l"): "i"}


FOLD = _table()


def fold(text: str | None) -> str:
    """Folded text with one space around every word; a null text is empty."""
    if not text:
        return " "
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "!" in text:
        text = _INNER.sub("i", text)
    return f" {_BETWEEN.sub(' ', text.lower().translate(FOLD)).strip()} ".replace("  ", " ")


@dataclass
class Lexicon:
    """``entries``: folded entry to weight, with a trailing ``*`` for a word beginning; ``exceptions``: folded phrases;
    ``curve``: weights of 1, log matched weight, log matched weight per hundred words."""

    entries: dict[str, float]
    exceptions: list[str]
    curve: list[float]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Lexicon:
        return cls(**json.loads(text))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve, self.automaton = lexicon.curve, ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            word = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
            self.automaton.add_word(word, (len(word), weight))
        for phrase in lexicon.exceptions:
            if phrase.strip():
                self.automaton.add_word(f" {phrase.strip()} ", (len(phrase.strip()) + 2, None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    @classmethod
    def shared(cls, lexicon_json: str) -> Matcher:
        store = worker_store("matchers")
        if lexicon_json not in store:
            store.clear()
            store[lexicon_json] = cls(Lexicon.from_json(lexicon_json))
        return store[lexicon_json]

    def find(self, folded: str) -> list[tuple[int, int, float]]:
        """Spans of the folded text that count, longest entry per word, without those inside an exception phrase."""
        if self.empty:
            return []
        spans, spared = {}, []
        for end, (size, weight) in self.automaton.iter(folded):
            a = end + 1 - size
            if weight is None:
                spared.append((a, end + 1))
            elif a not in spans or size > spans[a][1] - a:
                spans[a] = (a, end + 1, weight)
        if not spared:
            return list(spans.values())
        # one sweep over the starts: a span is spared if a phrase that begins no later reaches its end
        spared.sort()
        out, reach, at = [], 0, 0
        for a in sorted(spans):
            while at < len(spared) and spared[at][0] <= a:
                reach = max(reach, spared[at][1])
                at += 1
            if spans[a][1] > reach:
                out.append(spans[a])
        return out

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Matched weight, matches, words."""
        folded = fold(text)
        hits = self.find(folded)
        return sum(h[2] for h in hits), len(hits), max(1, folded.count(" ") - 1)


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / words)], axis=1)


def chance(weight: np.ndarray, words: np.ndarray, curve: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(weight, words) @ np.array(curve), -30, 30)))


def _fit_curve(weight: np.ndarray, words: np.ndarray, label: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge; without both labels, the constant share."""
    if label.min(initial=1) == label.max(initial=0):
        return [6.0 if label.size and label[0] else -6.0, 0.0, 0.0]
    x, w = features(weight, words), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + 0.05 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), grad)
    return w.tolist()


def learn(rows: DataFrame, text: str = "text", label: str = "label", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon from labelled rows (label 1: toxic); rows without a label are left out and copies count once.

    ``rows`` should be a bounded sample.  Counting runs in Spark; entries with enough support reach the driver.
    """
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").dropDuplicates().persist()
    try:
        totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_store("matchers")
            pos, neg = Counter(), Counter()
            for batch in batches:
                for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = set(fold(t).split())
                    units = {w for w in words if len(w) >= 3} | {f"{w[:n]}*" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                    (pos if y else neg).update(units)
            units = list(pos)  # what no toxic document holds cannot become an entry
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([pos[u] for u in units], pa.int64()), pa.array([0] * len(units), pa.int64())], names=["unit", "pos", "neg"])
            units = list(neg)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([0] * len(units), pa.int64()), pa.array([neg[u] for u in units], pa.int64())], names=["unit", "pos", "neg"])

        support = max(3, math.ceil(0.005 * toxic))
        counts = rows.mapInArrow(count, "unit string, pos bigint, neg bigint").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        n, base = F.col("pos") + F.col("neg"), max(toxic, 1) / max(toxic + clean, 1)
        part = lambda k, share: F.when(k > 0, k * F.log(k / n / share)).otherwise(0.0)
        evidence = 2 * (part(F.col("pos"), base) + part(F.col("neg"), 1 - base))
        lift = ((F.col("pos") + 0.5) / (toxic + 1.0)) / ((F.col("neg") + 0.5) / (clean + 1.0))
        found = counts.where((F.col("pos") >= support) & (lift >= MIN_LIFT) & (evidence >= MIN_EVIDENCE)).orderBy(F.desc("pos"), "unit").limit(4 * MAX_ENTRIES).collect() if toxic and clean else []
        entries = _choose({r["unit"]: (r["pos"], r["neg"]) for r in found}, toxic, clean)
        lexicon = Lexicon(entries, [fold(p).strip() for p in exceptions], [0.0, 0.0, 0.0])
        lexicon.exceptions += _spared_phrases(rows, lexicon)
        measured = measure(rows, lexicon, keep=("label",)).select("label", "weight", "words").toPandas()  # three numbers a sampled row
        lexicon.curve = _fit_curve(measured["weight"].to_numpy(float), measured["words"].to_numpy(float), measured["label"].to_numpy(float))
        return lexicon
    finally:
        rows.unpersist()


def _choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The most general beginnings that mark toxic text, made as specific as keeps what they catch."""
    weigh = lambda n: math.log((n[0] + 0.5) / (toxic + 1.0)) - math.log((n[1] + 0.5) / (clean + 1.0))
    begins = {u[:-1]: n for u, n in counts.items() if u.endswith("*")}
    longer = defaultdict(list)
    for b in begins:
        longer[b[:-1]].append(b)
    out = {}
    for b in begins:
        if b[:-1] in begins:  # a shorter beginning is an entry already
            continue
        n = begins[b]
        while True:
            deeper = max(longer[b], key=lambda x: begins[x][0], default=None)
            if deeper is None or begins[deeper][0] < KEEP_SHARE * n[0]:
                break
            b = deeper
        word = counts.get(b)
        if word and word[0] >= KEEP_SHARE * n[0]:
            out[b] = weigh(word)
        else:
            out[f"{b}*"] = weigh(begins[b])
    for u, n in counts.items():  # short words have no beginning of their own
        if not u.endswith("*") and len(u) < SHORTEST:
            out[u] = weigh(n)
    return dict(sorted(out.items(), key=lambda x: -x[1])[:MAX_ENTRIES])


def _spared_phrases(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around an entry that only clean documents hold, in three or more of them."""
    packed = lexicon.to_json()

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.shared(packed)
        pos, neg = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, seen = fold(t), set()
                for a, b, _ in matcher.find(folded):
                    stop = folded.index(" ", b - 1)
                    before, after = folded[:a].rpartition(" ")[2], folded[stop + 1 :].partition(" ")[0]
                    word = folded[a + 1 : stop]
                    seen |= {f"{before} {word}"} if before else set()
                    seen |= {f"{word} {after}"} if after else set()
                (pos if y else neg).update(seen)
        both = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([pos[p] for p in both], pa.int64()), pa.array([neg[p] for p in both], pa.int64())], names=["phrase", "pos", "neg"])

    found = rows.mapInArrow(phrases, "phrase string, pos bigint, neg bigint").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return [r["phrase"] for r in found.where("pos = 0 and neg >= 3").orderBy(F.desc("neg"), "phrase").limit(MAX_ENTRIES).collect()]


def measure(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1), ``weight``, ``matches``, ``words`` of every whole text; a null text is empty."""
    packed = lexicon.to_json()
    held = [F.col(f"`{c}`") for c in keep if c != text]
    rows = docs.select(*held, F.col(f"`{text}`").cast("string").alias("__text"))
    out = [(text if c == "__text" else c, t) for c, t in rows.dtypes]  # the text is read once, kept or not
    schema = ", ".join([f"`{c}` {t}" for c, t in out if c in keep] + ["score double, weight double, matches bigint, words bigint"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.shared(packed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [matcher.measure(t) for t in part.column(part.num_columns - 1).to_pylist()]
                weight, hits, words = (np.array([g[i] for g in got], dtype) for i, dtype in enumerate((float, np.int64, np.int64)))
                score = chance(weight, words, matcher.curve)
                kept = [(c, v) for (c, _), v in zip(out, part.columns) if c in keep]
                yield pa.RecordBatch.from_arrays([*(v for _, v in kept), pa.array(score), pa.array(weight), pa.array(hits), pa.array(words)], names=[*(c for c, _ in kept), "score", "weight", "matches", "words"])

    return rows.mapInArrow(scan, schema)


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_from_tables(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from about ``TRAIN_ROWS`` labelled documents outside the held-out fifth, picked by hashed id, at most twice as many; repeated
    labels of an id take the largest."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label")).where("label in (0, 1)")
    share = math.ceil(min(1.0, TRAIN_ROWS / max(1, known.count())) * (1 << 30))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).limit(2 * TRAIN_ROWS)
    return learn(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label"))  # some: TRAIN_ROWS at most


@common.query("op1_toxicity_lexicon")
def op1_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = measure(docs, learn_from_tables(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches", "words")
