"""Suffix-array dedup: bytes that a repeated string covers, at any scale.

A byte goes when a string of ``size`` bytes that covers it also starts in a document with a smaller id.  Sorting all suffixes of
the corpus together cannot be shared out, so strings are first brought together by content.  Winnowing gives every window of
``size`` bytes to the gram in it with the least hash, the same in equal windows.  Marks are exchanged as packed hashes; those that
several documents hold are cut out with their windows and dealt to shards by their hash, so equal windows meet in one shard.  Each shard sorts its suffixes by external induced sorting; suffixes that share ``size`` bytes are one
string, and the least document among them decides for all.  Copies are folded before each exchange: a text that its task has
seen under a smaller id needs no marks, and equal cuts of a task travel once.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import _powers, mix
from .suffixes import sorted_suffixes
from .tokens import worker_store

SIZE = 50
GRAM = 24              # bytes of a marked gram
CHUNK = 1 << 17        # bytes hashed together
SHARD_BYTES = 8 << 20  # text a shard stands for: there are as many shards as the measured text asks for, one for each shuffle partition at least
BLOCK = 1 << 16        # occurrences whose windows are compared at a time
BROADCAST_NUMBERS = 4_000_000  # numbers of the table of removed runs sent to every executor at most (32 MB); more are shuffled
_FULL = b"\x01"


def marks(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(index, first, count, hash)`` for each text of at least ``size`` bytes: every window of ``size`` bytes belongs to the gram in
    it with the least hash, the last of equal ones, which its own bytes alone decide.  Windows of one gram are neighbours:
    ``count`` of them from ``first``."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= CHUNK):
            total += len(texts[j])
            j += 1
        yield from _marks(texts, i, j, size, gram)
        i = j


def _marks(texts: list[bytes], i: int, j: int, size: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    b = np.frombuffer(b"".join(texts[i:j]), np.uint8)
    n = b.size - gram + 1
    if b.size < size:
        return
    up, down = _powers(b.size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)))
    h = mix((sums[gram:] - sums[:-gram]) * down[:n])
    last_first = np.uint64(0xFFFFFFFF)
    key = (h & ~last_first) | (last_first - np.arange(n, dtype=np.uint64))
    place = (last_first - (_sliding(np.minimum, key, size - gram + 1) & last_first)).astype(np.int64)  # of each window's gram
    ends = np.cumsum([len(t) for t in texts[i:j]])
    for k in range(i, j):
        end = int(ends[k - i])
        base, windows = end - len(texts[k]), len(texts[k]) - size + 1
        if windows > 0:
            own = place[base : base + windows]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            yield k, first, np.diff(np.concatenate((first, [windows]))), h[own[first]]


def _sliding(op: Callable, x: np.ndarray, span: int) -> np.ndarray:
    """``op`` over every window of ``span`` values."""
    width = 1
    while 2 * width <= span:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (span - width)], x[span - width :]) if span > width else x


def _pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind = a.dtype.str.encode()
        out.append(struct.pack("<B3sQ", len(kind), kind.ljust(3), a.nbytes) + a.tobytes())
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(blob[0]):
        k, kind, size = struct.unpack_from("<B3sQ", blob, at)
        at += 12
        out.append(np.frombuffer(blob, np.dtype(kind[:k].decode()), size // np.dtype(kind[:k].decode()).itemsize, at))
        at += size
    return out


def _batches(batches: Iterator[pa.RecordBatch], columns: int, most: int = 24 << 20) -> Iterator[list[list]]:
    """Column lists of rows whose first binary column is about ``most`` bytes long together."""
    held: list[list] = [[] for _ in range(columns)]
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for h, c in zip(held, part.columns):
                h += c.to_pylist()
            size += part.column(1).nbytes
            if size >= most:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def _deal(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each shard that has any."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for t in np.flatnonzero(cut[1:] > cut[:-1]):
        yield int(t), order[cut[t] : cut[t + 1]]


def _mark_rows(size: int, gram: int, shards: int) -> Callable:
    """Rows ``shard, blob``: hashes (40 bits besides the shard) and document numbers of marks; ids of folded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("none")
        seen: dict[bytes, int] = {}
        for ids, texts in _batches(batches, 2):
            keep, folded = [], []
            for k, t in zip(ids, texts):
                if t is None or len(t) < size or k is None:
                    continue
                key = hashlib.blake2b(t, digest_size=16).digest()
                if seen.get(key, k) < k:
                    folded.append(k)
                else:
                    seen[key] = k
                    keep.append((k, t))
            got = list(marks([t for _, t in keep], size, gram))
            names = np.array([keep[g[0]][0] for g in got], np.int64)
            doc = np.repeat(np.arange(len(got), dtype=np.uint32), [len(g[1]) for g in got])
            h = np.concatenate([g[3] for g in got] or [np.empty(0, np.uint64)])
            rows = []
            for t, at in _deal((mix(h) % np.uint64(shards)).astype(np.int64), shards):
                docs, number = np.unique(doc[at], return_inverse=True)
                number = number.astype(np.uint16 if len(docs) <= 65536 else np.uint32)
                rows.append((t, _pack(h[at].astype(np.uint32), (h[at] >> np.uint64(32)).astype(np.uint8), number, names[docs], np.empty(0, np.int64))))
            none = np.empty(0, np.uint32)
            for t in range(min(shards, len(folded))):
                rows.append((t, _pack(none, none.astype(np.uint8), none, none.astype(np.int64), np.array(folded[t::shards], np.int64))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    return run


def _to_buckets(doc: np.ndarray, columns: list[np.ndarray], folded: np.ndarray, buckets: int) -> pa.Table:
    """Rows ``bucket, blob`` of values per document, dealt by document; ids of folded documents besides."""
    order = np.argsort(doc, kind="stable")
    doc, columns = doc[order], [c[order] for c in columns]
    own = (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    fold = (mix(folded.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    parts, folds = dict(_deal(own, buckets)), dict(_deal(fold, buckets))
    none = np.empty(0, np.int64)
    rows = []
    for t in sorted(parts.keys() | folds.keys()):
        at = parts.get(t, none)
        names, counts = np.unique(doc[at], return_counts=True)
        rows.append((t, _pack(names, counts.astype(np.uint32), folded[folds.get(t, none)], *(c[at] for c in columns))))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _from_buckets(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Folded documents, the document of each value in ascending order, and the values."""
    blobs = [_unpack(b) for b in group.column("blob").to_pylist()]
    doc = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([b[2] for b in blobs]), doc[order], [np.concatenate(c)[order] for c in zip(*(b[3:] for b in blobs))]


def _marks_of_docs(group: pa.Table) -> pa.Table:
    """``doc_id, blob``: the low halves of the shared marks of each document; one byte for a folded one."""
    folded, doc, (low,) = _from_buckets(group)
    names, start = np.unique(doc, return_index=True)
    cut = [*start.tolist(), len(doc)]
    blobs = [low[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"doc_id": pa.array(np.concatenate((names, folded)), pa.int64()), "blob": pa.array(blobs + [_FULL] * len(folded), pa.binary())})


def _spans_of_docs(size: int) -> Callable:
    """``doc_id, spans`` from the removed windows of all shards; ``[0, -1]`` is the whole of a folded document."""

    def run(group: pa.Table) -> pa.Table:
        folded, doc, (first, mask) = _from_buckets(group)
        bits = (mask[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool)
        row, step = np.nonzero(bits)
        doc, start = doc[row], first[row].astype(np.int64) + step
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)))) if doc.size else np.empty(0, np.int64)
        last = np.concatenate((new[1:], [doc.size])) - 1 if doc.size else new
        pairs = np.stack((start[new], start[last] + size), axis=1)
        pairs = np.concatenate((pairs, np.tile(np.array([[0, -1]]), (len(folded), 1))))
        names, counts = np.unique(doc[new], return_counts=True)
        ends = np.cumsum(np.concatenate(([0], counts, np.ones(len(folded), np.int64)))) * 2
        return pa.table({"doc_id": pa.array(np.concatenate((names, folded)), pa.int64()), "spans": pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(pairs.ravel(), pa.int64()))})

    return run


def _shared(buckets: int) -> Callable:
    """Marks that at least two documents of a shard hold: the low halves of their hashes, by document."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [_unpack(b) for b in group.column("blob").to_pylist()]
        h = np.concatenate([b[0].astype(np.uint64) | b[1].astype(np.uint64) << np.uint64(32) for b in blobs])
        doc, fold = np.concatenate([b[3][b[2]] for b in blobs]), np.concatenate([b[4] for b in blobs])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        if h.size:
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            keep = np.repeat(several, np.diff(np.concatenate((start, [h.size]))))
            h, doc = h[keep], doc[keep]
        return _to_buckets(doc, [h.astype("<u4")], fold, buckets)

    return run


def _cut_rows(size: int, gram: int, shards: int) -> Callable:
    """Rows ``shard, blob``: distinct cuts (the windows of a shared mark, as one string) and where they occur; ids of folded documents."""
    wide = 2 * size - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for ids, texts, blobs in _batches(batches, 3, 8 << 20):
            folded = [k for k, found in zip(ids, blobs) if found == _FULL]
            some = [(k, t, np.unique(np.frombuffer(found, "<u4"))) for k, t, found in zip(ids, texts, blobs) if found != _FULL]
            names, doc, place, count, mark, cuts = [], [], [], [], [], []
            for i, first, n, h in marks([t for _, t, _ in some], size, gram):
                k, t, wanted = some[i]
                low = h.astype(np.uint32)
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low)
                data = np.concatenate((np.frombuffer(t, np.uint8), np.zeros(wide, np.uint8)))
                cuts.append(np.lib.stride_tricks.sliding_window_view(data, wide)[first[at]])
                place.append(first[at])
                count.append(n[at])
                mark.append(h[at])
                doc.append(np.full(len(at), len(names), np.uint32))
                names.append(k)
            rows = []
            if names:
                cut, place, count, mark, doc = np.concatenate(cuts), np.concatenate(place).astype(np.uint32), np.concatenate(count), np.concatenate(mark), np.concatenate(doc)
                names = np.array(names, np.int64)
                inside = np.arange(wide) < (count + size - 1)[:, None]
                cut[~inside] = 255  # occurs in no text
                whole = _row_hash(cut)
                for t, at in _deal((mix(mark) % np.uint64(shards)).astype(np.int64), shards):
                    rep, which = _distinct(cut[at], whole[at])
                    rep = at[rep]
                    docs, number = np.unique(doc[at], return_inverse=True)
                    number = number.astype(np.uint16 if len(docs) <= 65536 else np.uint32)
                    which = which.astype(np.uint16 if len(rep) <= 65536 else np.uint32)
                    flat = np.frombuffer(press.compress(cut[rep][inside[rep]].tobytes()), np.uint8)
                    rows.append((t, _pack(flat, count[rep].astype(np.uint8), which, number, names[docs], place[at], np.empty(0, np.int64))))
            none = np.empty(0, np.uint8)
            for t in range(min(shards, len(folded))):
                rows.append((t, _pack(none, none, none, none, none.astype(np.int64), none.astype(np.uint32), np.array(folded[t::shards], np.int64))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    return run


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct rows, and which of them each row equals."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero((rows != rows[first[which]]).any(1))  # equal hashes of different rows stay apart
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


def _row_hash(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for c in range(words.shape[1]):
        h = mix(h + words[:, c] + np.uint64(0x9E3779B97F4A7C15))
    return h


def _repeated(size: int, gram: int, buckets: int) -> Callable:
    """Per shard: the windows of each document that also start in a smaller one, as first places and bit masks."""
    wide, offsets = 2 * size - gram, size - gram + 1

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdDecompressor()
        cuts, counts, which, doc, place, folded, base = [], [], [], [], [], [], 0
        for blob in group.column("blob").to_pylist():
            flat, n, w, number, names, at, fold = _unpack(blob)
            folded.append(fold)
            if not n.size:
                continue
            cut = np.full((len(n), wide), 255, np.uint8)
            cut[np.arange(wide) < (n.astype(np.int64) + size - 1)[:, None]] = np.frombuffer(press.decompress(flat.tobytes()), np.uint8)
            cuts.append(cut)
            counts.append(n)
            which.append(w.astype(np.int64) + base)
            doc.append(names[number])
            place.append(at)
            base += len(cut)
        fold = np.concatenate(folded)
        if not cuts:
            return _to_buckets(np.empty(0, np.int64), [np.empty(0, "<u4"), np.empty(0, "<u8")], fold, buckets)
        cut, count, which, doc, place = np.concatenate(cuts), np.concatenate(counts), np.concatenate(which), np.concatenate(doc), np.concatenate(place)
        del cuts
        rep, again = _distinct(cut, _row_hash(cut))  # equal cuts of different tasks are one
        cut, count, which = cut[rep], count[rep].astype(np.int64), again[which]
        names, doc = np.unique(doc, return_inverse=True)  # places in ascending order stand for ids
        doc = doc.astype(np.int32)
        least = np.full(len(cut), len(names), np.int32)
        np.minimum.at(least, which, doc)
        winner = np.repeat(least[:, None], offsets, axis=1)  # least document of each window of each cut
        _settle(cut, count, least, winner, size)
        mask = np.empty(len(doc), np.uint64)
        step = np.arange(offsets, dtype=np.uint64)
        for i in range(0, len(doc), BLOCK):
            w = which[i : i + BLOCK]
            gone = (winner[w] < doc[i : i + BLOCK, None]) & (np.arange(offsets) < count[w][:, None])
            mask[i : i + BLOCK] = np.bitwise_or.reduce(gone.astype(np.uint64) << step, axis=1)
        hit = np.flatnonzero(mask)
        return _to_buckets(names[doc[hit]], [place[hit].astype("<u4"), mask[hit].astype("<u8")], fold, buckets)

    return run


def _settle(cut: np.ndarray, count: np.ndarray, least: np.ndarray, winner: np.ndarray, size: int) -> None:
    """All suffixes of the cuts in order; windows that share ``size`` bytes take the least document of all."""
    length = count + size  # with one byte that ends each cut
    text = np.full((len(cut), cut.shape[1] + 1), 255, np.uint8)
    text[:, :-1] = cut
    text = text[np.arange(text.shape[1]) < length[:, None]]
    start = np.cumsum(length) - length
    row_of = np.repeat(np.arange(len(cut), dtype=np.int32), length)
    for at, lcp in sorted_suffixes(text, size):
        same = lcp >= size
        if not same.any():
            continue
        member = same.copy()  # of a group of two or more
        member[:-1] |= same[1:]
        group, at = np.cumsum(~same)[member], at[member]
        row = row_of[at]
        offset = at - start[row]
        ok = offset < count[row]
        row, offset, group = row[ok], offset[ok], group[ok]
        if not row.size:
            continue
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        best = np.minimum.reduceat(least[row], first)
        winner[row, offset] = np.repeat(best, np.diff(np.concatenate((first, [row.size]))))


def repeated_spans(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", gram: int | None = None) -> DataFrame:
    """``doc_id, spans`` (``start, stop`` pairs, flattened; ``[0, -1]`` is a whole document) of the documents that lose bytes."""
    gram = gram or max(4, min(GRAM, size // 2))
    if size - gram + 1 > 64 or size > 254:
        raise ValueError("a mark may have 64 windows of 254 bytes")
    rows, buckets = _rows(docs, key, text), common.partitions(docs.sparkSession)
    size_of_all = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(buckets, -(-size_of_all // SHARD_BYTES))
    marked = rows.mapInArrow(_mark_rows(size, gram, shards), "shard int, blob binary")
    parts = "bucket int, blob binary"
    shared = marked.groupBy("shard").applyInArrow(_shared(buckets), parts).groupBy("bucket").applyInArrow(_marks_of_docs, "doc_id bigint, blob binary")
    cut = rows.join(shared, "doc_id").mapInArrow(_cut_rows(size, gram, shards), "shard int, blob binary")
    gone = cut.groupBy("shard").applyInArrow(_repeated(size, gram, buckets), parts)
    return gone.groupBy("bucket").applyInArrow(_spans_of_docs(size), "doc_id bigint, spans array<bigint>")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` (binary), one row per row of ``docs``, in which ``key`` is unique.

    ``spans``: removed runs as ``start, stop`` pairs, flattened.  A null or short text keeps all its bytes; a row with a null key
    is neither searched nor matched.  Strings are judged on the input, so what a document loses does not free others.  Other
    columns are not read.
    """
    joined = _with_spans(_rows(docs, key, text), repeated_spans(docs, size, key, text), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _batches(batches, 3, 8 << 20):
            out = []
            for k, t, runs in zip(ids, texts, found):
                t, runs = t or b"", runs or []
                if runs and runs[1] == -1:
                    runs = [0, len(t)]
                keep = _keep(t, runs)
                out.append((k, len(t), len(t) - len(keep), runs, keep))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary")


def _with_spans(rows: DataFrame, spans_: DataFrame, key: str) -> DataFrame:
    """Rows with their removed runs as one more column, the last; the table of runs is sent to the rows while it is small, which is measured."""
    own, runs = common.unused(rows.columns, "own"), common.unused(rows.columns, "runs")
    found = common.settled(spans_, "spans").select(F.col("doc_id").alias(own), F.col("spans").alias(runs))
    held = found.agg(F.sum(F.size(runs) + 2)).first()[0] or 0
    return rows.join(F.broadcast(found) if held <= BROADCAST_NUMBERS else found, F.col(f"`{key}`") == F.col(own), "left").drop(own)


def _keep(text: bytes, runs: list[int]) -> bytes:
    return b"".join(text[a:c] for a, c in zip([0, *runs[1::2]], [*runs[::2], len(text)]))


def without_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated strings cut out of ``text``; a character that is removed in part stays.

    ``length`` names a column that is set to the new number of characters.  A text that loses everything becomes empty, a null stays.
    """
    names = docs.columns
    joined = _with_spans(docs, repeated_spans(docs, size, key, text), key)
    at, number = names.index(text), names.index(length) if length else -1
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {'string' if c == text else 'bigint' if c == length else kinds[c]}" for c in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if t is not None and runs:
                    b = t.encode()
                    runs = [0, len(b)] if runs[1] == -1 else list(runs)
                    for i in range(0, len(runs), 2):  # whole characters only
                        while runs[i] < runs[i + 1] and b[runs[i]] & 0xC0 == 0x80:
                            runs[i] += 1
                        while runs[i + 1] > runs[i] and runs[i + 1] < len(b) and b[runs[i + 1]] & 0xC0 == 0x80:
                            runs[i + 1] -= 1
                    t = _keep(b, runs).decode()
                texts.append(t)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if length:
                columns[number] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, schema)


@common.query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
