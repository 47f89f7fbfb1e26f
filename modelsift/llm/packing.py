"""Best-fit packing: documents become sequences of at most ``capacity`` tokens.

Best-fit decreasing, run over the whole corpus at once: a document goes to the tightest open sequence that still holds it.
Only its length decides where a document goes, so the lengths' histogram (at most ``capacity`` rows) is packed: a segment tree
over remaining capacities finds the tightest open group of sequences in logarithmic time, and a whole run of equally long
documents is placed per step, exactly as one by one.  Spark then numbers the documents of each length and joins them to their
places, so nothing that grows with the corpus leaves the executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .simple8b import crc32
from .tokens import WordEncoder

CAPACITY = 4096
PLACES = "length bigint, lo bigint, hi bigint, sequence_lo bigint, per_sequence bigint, base bigint"


class RoomTree:
    """Segment tree over remaining capacities 0 to ``top``: ``tightest(n)`` is the smallest open one of at least ``n``."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        while not self.open[i]:  # climb until a right sibling is open
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            if i <= 1:
                return None
            i += 1
        while i < self.size:  # and go down to its leftmost open leaf
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` documents of each length: ``(length, lo, hi, sequence_lo, per_sequence, base)``.

    Number ``lo <= j < hi`` among the documents of that length goes to sequence ``sequence_lo + (j - lo) // per_sequence`` at
    offset ``base + (j - lo) % per_sequence * length``.
    """
    tree, groups, places, opened = RoomTree(capacity), defaultdict(list), [], 0

    def put(room: int, lo: int, hi: int) -> None:
        if hi > lo:
            groups[room].append((lo, hi))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                lo, hi = opened, opened + -(-(total - done) // per)
                opened = hi
            else:
                per = room // length
                lo, hi = groups[room].pop()
                if not groups[room]:
                    tree.set(room, False)
            used = min(hi - lo, -(-(total - done) // per))
            put(room, lo + used, hi)
            n = min(total - done, used * per)
            places.append((length, done, done + n, lo, per, capacity - room))
            full, rest = divmod(n, per)
            put(room - per * length, lo, lo + full)
            if rest:
                put(room - rest * length, lo + full, lo + full + 1)
            done += n
    return places


def cut_pieces(docs: DataFrame, file: str, end_id: int | None, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32 [, ids]``: each text's ids and the end id, cut only where longer than ``capacity``.

    A null or empty text is one piece with the end id alone.  A null key stays null.  Other columns are not read.
    """
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder.shared(file)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for k, ids in zip(part.column(0).to_pylist(), coder.encode_all(part.column(1).to_pylist())):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[a : a + 4 * capacity]
                        rows.append((k, n, a // 4, len(piece) // 4, crc32(piece)) + ((piece,) if with_ids else ()))
                columns = zip(*rows) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def place(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length of 1 to ``capacity``; other lengths (null, 0) get null places.

    ``pieces`` is read twice and should be a table.  Equal rows are placed apart.  Columns of other names pass through; columns
    already called ``sequence_id`` or ``offset`` are replaced.
    """
    spark, n = pieces.sparkSession, common.partitions(pieces.sparkSession)
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{length}`").cast("bigint").alias("__length"))
    # a length may hold a third of all rows: number it in chunks of rows, then shift each chunk by those before it
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own]), F.lit(n)))
    fits = rows.where(F.col("__length").between(1, capacity))
    sizes = fits.groupBy("__length", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__length", "__chunk", F.coalesce(before, F.lit(0)).alias("__shift"))
    counts = {r["__length"]: r["n"] for r in sizes.groupBy("__length").agg(F.sum("__n").alias("n")).collect()}  # at most capacity rows
    places = spark.createDataFrame(best_fit(counts, capacity), PLACES)
    numbered = fits.withColumn("__j", F.row_number().over(Window.partitionBy("__length", "__chunk").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in own]))) - 1)
    numbered = numbered.join(shifts, ["__length", "__chunk"]).withColumn("__j", F.col("__j") + F.col("__shift"))
    p = F.broadcast(places.select(*[F.col(c).alias(f"__p_{c}") for c in places.columns]))  # its size depends on the capacity alone
    joined = numbered.join(p, (F.col("__length") == F.col("__p_length")) & (F.col("__j") >= F.col("__p_lo")) & (F.col("__j") < F.col("__p_hi")))
    k = F.col("__j") - F.col("__p_lo")
    out = joined.select(
        *[F.col(f"`{c}`") for c in own],
        (F.col("__p_sequence_lo") + F.floor(k / F.col("__p_per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("__p_base") + k % F.col("__p_per_sequence") * F.col("__length")).cast("bigint").alias("offset"),
    )
    odd = rows.where(~F.coalesce(F.col("__length").between(1, capacity), F.lit(False))).select(*[F.col(f"`{c}`") for c in own], F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"))
    return out.unionAll(odd)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids, docs``: the packed sequences themselves, from placed pieces that carry ``ids``."""

    def build(key, group):
        group = group.sort_values("offset")
        return group.iloc[:1][["sequence_id"]].assign(ids=[np.frombuffer(b"".join(group["ids"]), "<u4").astype("int64")], docs=[group["doc_id"].tolist()])

    return placed.where("sequence_id is not null").groupBy("sequence_id").applyInPandas(build, "sequence_id bigint, ids array<bigint>, docs array<bigint>")


def pack_documents(docs: DataFrame, file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places."""
    return place(common.settled(cut_pieces(docs, file, end_id, capacity), "pieces"), capacity)


@common.query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)
