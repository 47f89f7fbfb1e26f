"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins neighbouring symbols, best score first and leftmost among equals.  Here each candidate merge is skipped
when a keyed hash of its document, the word's place and the span falls below the dropout, so every occurrence of a word draws its
own merges, a function of the seed, the document and the place alone.  All of them decode to the text: characters outside the vocabulary, and a
literal word mark, become bytes.

No piece but a run of word marks continues behind a word mark, so words are encoded apart.  What becomes of a word depends on
which of the spans that could be candidates are skipped; a worker keeps the ids of words and skipped spans it has met and encodes
the new ones of a batch side by side: in each round every word takes the best candidate of its agenda.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix
from .tokens import tokenizer_path, worker_store

MARK = "▁"
DROPOUT, SEED = 0.1, 7
KEPT = 400_000         # words, and outcomes of words, a worker remembers; emptied when full
OFTEN = 6              # occurrences in a batch from which a word's outcomes are kept; others are encoded each time
MOST_SPANS = 24        # a word with more is encoded each time, for its outcomes hardly recur
BLOCK = 1 << 16        # occurrences whose spans are hashed at a time
LONGEST_KEPT = 40
LONG = 400             # symbols from which a word is encoded by itself
_RUNS = re.compile(r" *[^ \n\t]+| +|[\n\t]")
_STEP, _GOLD = np.uint64(0x9E3779B97F4A7C15), 0x9E3779B97F4A7C15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PieceCoder:
    def __init__(self, file: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = 0):
        """``variants``: the most segmentations a word may have; 0: each occurrence has its own."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(file))
        n = model.get_piece_size()
        self.limit = np.uint64(min(1.0, max(0.0, dropout)) * (2**64 - 1))
        self.drops, self.seed, self.variants = dropout > 0, seed, variants
        ordinary = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {model.id_to_piece(i): i for i in ordinary}
        if any(MARK in p[1:] and p.strip(MARK) for p in names):
            raise ValueError("pieces of this model cross words")
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        pairs = {}
        for p, i in names.items():
            for cut in range(1, len(p)):
                a, b = names.get(p[:cut]), names.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (i, model.get_score(i))
        order = np.argsort(-np.array([model.get_score(i) for i in range(n)]), kind="stable")
        self.n, self.rank = n, np.empty(n, np.int64)  # equal scores share a rank, so the leftmost wins
        score = np.array([model.get_score(i) for i in range(n)])[order]
        self.rank[order] = np.cumsum(np.concatenate(([0], (score[1:] != score[:-1]).astype(np.int64))))
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.pairs = {k: v[0] for k, v in pairs.items()}
        self.shown = [b""] * n
        for p, i in names.items():
            self.shown[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        self.lut = np.full(0x110000, -1, np.int64)  # symbols by code point; a space stands for the word mark, a mark for itself
        for p, i in names.items():
            if len(p) == 1:
                self.lut[ord(p)] = i
        self.lut[ord(" ")], self.lut[ord(MARK)] = self.lut[ord(MARK)], -1
        wanted = set(self.joined.tolist())
        self.spans = {p.replace(MARK, " ") for p, i in names.items() if i in wanted}
        self.widest = max(map(len, self.spans), default=0)
        self._forget()

    @classmethod
    def shared(cls, file: str, dropout: float, seed: int, variants: int) -> PieceCoder:
        store = worker_store("pieces")
        name = (file, dropout, seed, variants)
        if name not in store:
            store[name] = cls(*name)
        return store[name]

    def skipped(self, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether the candidate that would span the given characters of a word is dropped."""
        return mix(key + self.steps(start, stop)) < self.limit

    @staticmethod
    def steps(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (start.astype(np.uint64) * np.uint64(1 << 32) + stop.astype(np.uint64)) * _STEP

    def agenda(self, word: str, draw: int) -> list[int]:
        """One word by a priority queue; gives what ``_together`` gives."""
        import heapq

        points = _points(word)
        ids, n = self.lut[points].tolist(), len(points)
        key = mix(np.array([draw], np.uint64))
        start, stop, before, after, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and ids[i] >= 0 and ids[j] >= 0:
                new = self.pairs.get(ids[i] * self.n + ids[j])
                if new is not None and not (self.drops and self.skipped(key, np.array([start[i]]), np.array([stop[j]]))[0]):
                    heapq.heappush(heap, (int(self.rank[new]), start[i], stop[j], i, j))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, i, j = heapq.heappop(heap)
            if not (alive[i] and alive[j] and start[i] == a and stop[j] == b and after[i] == j):
                continue
            ids[i] = self.pairs[ids[i] * self.n + ids[j]]
            stop[i], alive[j], after[i] = b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = []
        for i in range(n):
            if alive[i]:
                out += [ids[i]] if ids[i] >= 0 else [self.bytes[b] for b in word[start[i] : stop[i]].encode("utf-8", "surrogatepass")]
        return out

    def _together(self, words: list[str], draws: int | np.ndarray) -> list[bytes]:
        """Ids of words as bytes, ``draws`` (one for each, or for all) key their merges; each round every word takes its best
        candidate.  Words that are long or hold unknown characters go to ``agenda``."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        points = _points("".join(words))
        sym = self.lut[points]
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(sym)) - begin[word]
        stop = start + 1
        draws = np.broadcast_to(np.asarray(draws, np.uint64), len(words))
        key = mix(draws)
        odd = (np.minimum.reduceat(sym, begin) < 0) | (sizes > LONG)
        if odd.any():
            keep = ~odd[word]
            sym, word, start, stop = sym[keep], word[keep], start[keep], stop[keep]
        done_word, done_sym = [], []

        def candidates(i: np.ndarray) -> np.ndarray:
            """What the symbols at ``i`` and behind make; -1 where nothing, where a word ends or where the merge is dropped."""
            pair = sym[i] * self.n + sym[i + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            ok = (self.keys[at] == pair) & (word[i] == word[i + 1])
            if self.drops:
                some = np.flatnonzero(ok)
                ok[some] = ~self.skipped(key[word[i[some]]], start[i[some]], stop[i[some] + 1])
            return np.where(ok, self.joined[at], -1)

        makes = np.full(len(sym), -1)
        if sym.size and self.keys.size:
            makes[:-1] = candidates(np.arange(len(sym) - 1))
        while sym.size:
            c = np.flatnonzero(makes >= 0)
            if not c.size:
                break
            # the best candidate of each word: least rank, then leftmost
            rank = self.rank[makes[c]]
            first = np.flatnonzero(np.concatenate(([True], word[c[1:]] != word[c[:-1]])))
            group = np.repeat(np.arange(first.size), np.diff(np.concatenate((first, [c.size]))))
            best = np.minimum.reduceat(rank, first)
            hits = np.flatnonzero(rank == best[group])
            hits = hits[np.concatenate(([True], group[hits[1:]] != group[hits[:-1]]))]
            left = c[hits]
            sym[left], stop[left] = makes[left], stop[left + 1]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            going = np.zeros(len(words), bool)
            going[word[left]] = True
            finished = ~going[word]
            if finished.any():
                done_word.append(word[finished])
                done_sym.append(sym[finished])
                keep &= ~finished
            left = np.cumsum(keep)[left] - 1
            sym, word, start, stop, makes = sym[keep], word[keep], start[keep], stop[keep], makes[keep]
            # only a merged symbol and the one before it have new neighbours
            makes[left] = -1
            near = np.concatenate((left[left > 0] - 1, left[left + 1 < len(sym)]))
            makes[near] = candidates(near)
        done_word.append(word)
        done_sym.append(sym)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        data = sym[order].astype("<u4").tobytes()
        cut = 4 * np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))
        out = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.agenda(words[i], int(draws[i])), "<u4").tobytes()
        return out

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.outcomes: list[dict[int, bytes]] = [{}]              # of each word, by the bits of the skipped spans; 0 stands for all other words
        self.first, self.many = np.zeros(2, np.int64), np.full(1, -1)  # where each word's spans begin, and how many; -1: encoded each time
        self.step, self.n_outcomes = np.zeros(0, np.uint64), 0

    def _meet(self, words: set[str]) -> None:
        """Number new words and list the spans of each that could be candidates."""
        many, start, stop = [], [], []
        for w in words:
            self.words[w] = len(self.outcomes)
            self.outcomes.append({})
            n, before = len(w), len(start)
            if not self.drops:
                many.append(0)
                continue
            if n <= LONGEST_KEPT:
                for i in range(n - 1):
                    for j in range(i + 2, min(n, i + self.widest) + 1):
                        if w[i:j] in self.spans:
                            start.append(i)
                            stop.append(j)
            if n > LONGEST_KEPT or len(start) - before > MOST_SPANS:
                del start[before:], stop[before:]
                many.append(-1)
            else:
                many.append(len(start) - before)
        self.many = np.concatenate((self.many, np.array(many, np.int64)))
        self.first = np.concatenate(([0], np.cumsum(np.maximum(self.many, 0))))
        self.step = np.concatenate((self.step, self.steps(np.array(start, np.int64), np.array(stop, np.int64))))

    def _skips(self, word: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of each occurrence, a bit for each span of its word that is dropped."""
        out = np.zeros(len(word), np.uint64)
        for a in range(0, len(word) if self.drops else 0, BLOCK):
            w = word[a : a + BLOCK]
            many = np.maximum(self.many[w], 0)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            gone = np.flatnonzero(mix(np.repeat(key[a : a + BLOCK], many) + self.step[np.repeat(self.first[w], many) + place]) < self.limit)
            if gone.size:
                at = np.repeat(np.arange(len(w)), many)[gone]
                begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                out[a + at[begin]] = np.bitwise_or.reduceat(np.uint64(1) << place[gone].astype(np.uint64), begin)
        return out

    def encode_all(self, texts: list[str | None], names: list[int]) -> list[bytes]:
        """Ids of each text, unsigned 32-bit little-endian; ``names`` key the merges.  A null or empty text has none."""
        if len(self.words) > KEPT or self.n_outcomes > KEPT:
            self._forget()
        flat, ends, draws = [], [], [np.zeros(0, np.uint64)]
        for t, name in zip(texts, names):
            if t:
                words = [" " + w for w in t.split(" ")] if not ("  " in t or t[0] == " " or t[-1] == " " or "\n" in t or "\t" in t) else _RUNS.findall(" " + t)
                flat += words
                base = mix(np.array([(name * _GOLD ^ self.seed) & (2**64 - 1)], np.uint64))
                draws.append(mix(np.arange(len(words), dtype=np.uint64) + base))
            ends.append(len(flat))
        draw = np.concatenate(draws)
        if self.variants:
            draw %= np.uint64(self.variants)
        self._meet({w for w, n in Counter(flat).items() if n >= OFTEN} - self.words.keys())
        numbers = [self.words.get(w, 0) for w in flat]
        word = np.array(numbers, np.int64)
        skips = self._skips(word, mix(draw)).tolist()
        outcomes = self.outcomes
        ids = [outcomes[w].get(m) for w, m in zip(numbers, skips)]
        alone = self.many[word] < 0
        new: dict[tuple[int, int], list[int]] = {}
        for i in [i for i, x in enumerate(ids) if x is None]:
            new.setdefault((-1, i) if alone[i] else (numbers[i], skips[i]), []).append(i)
        lead = [places[0] for places in new.values()]
        for ((w, m), places), got in zip(new.items(), self._together([flat[i] for i in lead], draw[lead])):
            for i in places:
                ids[i] = got
            if w > 0 and len(flat[places[0]]) <= LONGEST_KEPT:
                outcomes[w][m] = got
                self.n_outcomes += 1
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "surrogatepass") if data else ""


def encode(docs: DataFrame, file: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = 0, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """``doc_id, ids`` (unsigned 32-bit, little-endian), with ``lossless`` when ``check``: whether the ids decode to the text.

    A null or empty text has no ids.  A null key is encoded as key 0.  Rows are not moved; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.shared(file, dropout, seed, variants)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                ids = coder.encode_all(texts, [k or 0 for k in part.column(0).to_pylist()])
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if check:
                    columns.append(pa.array([coder.decode(np.frombuffer(x, "<u4")) == (t or "") for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "lossless"][: len(columns)])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary" + ", lossless boolean" * check)


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; the segmentation does not matter.  Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.shared(file, 0.0, 0, 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else coder.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


@common.query("op3_merge_dropout")
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(common.table(spark, sf_dir, "documents"), "piece_bpe_32k.model", check=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "lossless")
