"""Token-ID output: Simple-8b word-aligned coding.

A 64-bit word holds a selector in its top four bits and, below it, as many ids as fit at one width.  An id that needs more
than 60 bits is escaped: selector 15, then a raw word.  Ids are cut into blocks; a table gives the first word of each block,
so any document can be decoded alone and all words of a payload are decoded together.

A token file is a folder of Parquet parts in which each row holds one self-contained payload (``payload``) with its
documents in ascending order (``docs``: id and number of ids), so the writer's commit protocol covers the bytes too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WordEncoder

# fixed values: ids per word and bits per id of selectors 0 to 13
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
MAGIC = b"S8B1"
BLOCK = 256          # ids per block
GROUP_IDS = 1 << 20  # ids per payload, about; a longer document has a payload of its own

DOCS = "array<struct<doc_id:bigint,n_tokens:bigint>>"
PARTS = f"part int, seq int, first_doc bigint, before bigint, n_tokens bigint, docs {DOCS}, payload binary"


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits each id needs, at least 1."""
    if not v.size or v.max() < len(_SMALL):
        return _SMALL[v]
    return np.maximum(1, np.searchsorted(_POWERS, v, side="right")).astype(np.uint8)


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = np.maximum(1, np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right")).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Encode unsigned ids (any integer type, values below 2**64); an empty array has a payload too."""
    v = np.ascontiguousarray(ids).astype(np.uint64)
    n, nb = len(v), -(-len(v) // block)
    width = np.full((nb, block + 64), 255, np.uint8)  # padded, so no word crosses a block
    flat = np.full(nb * block, 255, np.uint8)
    flat[:n] = _bits(v)
    width[:, :block] = flat.reshape(nb, block)
    # most[c]: the largest width among the c ids from each place
    most = {1: width}
    for c in sorted(PER_WORD)[1:]:
        half = max(x for x in most if x < c and 2 * x >= c) if any(2 * x >= c for x in most) else max(most)
        while 2 * half < c:
            most[2 * half] = np.maximum(most[half][:, : -half], most[half][:, half:])
            half *= 2
        most[c] = np.maximum(most[half][:, : most[half].shape[1] - (c - half)], most[half][:, c - half :])
    choice = np.zeros((nb, block), np.uint8)
    for s in range(14):  # what fits at one selector fits at all later ones
        choice += most[PER_WORD[s]][:, :block] > WIDTHS[s]
    choice[choice == 14] = ESCAPE
    step = np.array([*PER_WORD, 1, 1], np.int64)
    end = np.minimum(block, n - np.arange(nb) * block)
    at, live = np.zeros(nb, np.int64), np.arange(nb)
    starts, rows = [], []
    while live.size:  # all blocks advance by one word
        here = at[live]
        starts.append(here)
        rows.append(live)
        at[live] = here + step[choice[live, here]]
        live = live[at[live] < end[live]]
    if not starts:
        starts, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    row, start = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    sel, src = choice[row, start], row * block + start
    size = 1 + (sel == ESCAPE)
    place = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(int(place[-1]), np.uint64)
    for s in range(14):
        at_s = np.flatnonzero(sel == s)
        if at_s.size:
            got = v[src[at_s, None] + np.arange(PER_WORD[s])]
            shift = (np.arange(PER_WORD[s]) * WIDTHS[s]).astype(np.uint64)
            words[place[at_s]] = np.bitwise_or.reduce(got << shift, axis=1) | np.uint64(s << 60)
    esc = np.flatnonzero(sel == ESCAPE)
    words[place[esc]] = np.uint64(ESCAPE << 60)
    words[place[esc] + 1] = v[src[esc]]
    offsets = place[np.searchsorted(row, np.arange(nb))].astype("<u4")
    return MAGIC + struct.pack("<QIII", n, block, nb, len(words)) + offsets.tobytes() + words.astype("<u8").tobytes()


def _head(payload: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, block, nb, nw = struct.unpack_from("<QIII", payload, 4)
    offsets = np.frombuffer(payload, "<u4", nb, 24)
    return n, block, offsets, np.frombuffer(payload, "<u8", nw, 24 + 4 * nb)


def _spread(words: np.ndarray, limit: int) -> np.ndarray:
    """The ids in a run of whole blocks."""
    top = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(top == ESCAPE) if (top == ESCAPE).any() else ():  # a raw word may look like an escape
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    held = np.array([*PER_WORD, 0, 1], np.int64)[top]
    held[raw] = 0
    place = np.concatenate(([0], np.cumsum(held)))
    out = np.empty(int(place[-1]), np.uint64)
    for s in range(14):
        at = np.flatnonzero((top == s) & ~raw)
        if at.size:
            shift = (np.arange(PER_WORD[s]) * WIDTHS[s]).astype(np.uint64)
            out[place[at][:, None] + np.arange(PER_WORD[s])] = (words[at][:, None] >> shift) & np.uint64((1 << WIDTHS[s]) - 1)
    esc = np.flatnonzero((top == ESCAPE) & ~raw)
    out[place[esc]] = words[esc + 1]
    return out[:limit]


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a payload as unsigned 64-bit integers."""
    n, _, _, words = _head(payload)
    return _spread(words, n)


def unpack_range(payload: bytes, start: int, length: int) -> np.ndarray:
    """``length`` ids from ``start``; only the blocks that hold them are decoded."""
    n, block, offsets, words = _head(payload)
    if not 0 <= start <= start + length <= n:
        raise IndexError((start, length, n))
    if length == 0:
        return np.empty(0, np.uint64)
    a, b = start // block, (start + length - 1) // block + 1
    stop = int(offsets[b]) if b < len(offsets) else len(words)
    return _spread(words[int(offsets[a]) : stop], min(n, b * block) - a * block)[start - a * block :][:length]


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int | None, text: str = "text", key: str = "doc_id") -> None:
    """Encode ``text`` of every row and write a token file in ascending order of ``key``.

    A null or empty text has only the end id.  Rows with a null key come first; repeated keys stay separate, in any order.
    Other columns are not read.  One shuffle by key range; each task then streams its sorted rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        coder = WordEncoder.shared(file)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        keys: list[int | None] = []
        held: list[bytes] = []
        total = 0

        def out() -> pa.RecordBatch:
            nonlocal keys, held, total, seq, before
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "seq": seq, "first_doc": keys[0], "before": before, "n_tokens": len(ids), "docs": [{"doc_id": k, "n_tokens": len(h) // 4} for k, h in zip(keys, held)], "payload": pack(ids)}
            seq, before, keys, held, total = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))), ("payload", pa.binary())])
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(names), 64):
                for k, h in zip(names[i : i + 64], coder.encode_all(column.slice(i, 64).to_pylist())):
                    keys.append(k)
                    held.append(h + end)
                    total += len(h) // 4 + 1
                    if total >= GROUP_IDS:
                        yield out()
        if keys:
            yield out()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, PARTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (bytes: unsigned 32-bit, little-endian) of every document in a token file.

    ``start`` counts the ids of all documents before it.  Only one number per part reaches a window; payloads are read once.
    """
    parts = spark.read.schema(PARTS).parquet(path)
    sums = parts.groupBy("part").agg(F.min_by("first_doc", "seq").alias("first_doc"), F.sum("n_tokens").alias("held"))
    tops = sorted(sums.collect(), key=lambda r: (r["first_doc"] is not None, r["first_doc"], r["part"]))  # one row per part
    at, base = 0, {}
    for r in tops:
        base[r["part"]], at = at, at + r["held"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids = unpack(r["payload"]).astype("<u4")
                counts = np.array([d["n_tokens"] for d in r["docs"]], np.int64)
                starts = np.concatenate(([0], np.cumsum(counts)))
                first = base[r["part"]] + r["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d["doc_id"] for d in r["docs"]], pa.int64()), pa.array(first + starts[:-1]), pa.array(counts), pa.array([ids[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return parts.select("part", "before", "docs", "payload").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


@common.query("op2_simple8b_tokens")
def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    read = read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
