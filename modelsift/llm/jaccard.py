"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact.

Two sets that link have sizes within the threshold, so sizes fall into geometric bands and only neighbours meet; each band and
the next share a scheme.  A scheme hashes the universe into segments.  If two sets differ in at most H elements and the
segments' budgets sum to H + 1 + t, they agree in segments worth more than t.  A segment of budget 1 is indexed as a whole; one
of budget 2 also by all its one-deletion neighbours, which catches one difference.  Each set leaves out its t costliest
whole segments, those with the fewest rare elements: cost is a function of a segment's content, so of two agreeing sets both keep
their cheapest agreeing segment and nothing is lost, whatever the costs are.  A cost model picks the numbers of doubled and spare
segments of each scheme; which elements are frequent is read off some documents and guides the costs only.

Sets that agree in a signature are candidates.  Each is compared with the smallest id of its signature; only signatures whose
members then still lie in different components compare the rest across components, so no group of copies is paired out.
A parity bitmap bounds the difference from below before whole texts are fetched; the final test is on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix, shingle_sets
from .tokens import worker_store

BITMAP_WORDS = (4, 1024)  # least and most 64-bit words of a parity bitmap, which has two to four cells per element
SLICE, SEEN = 200, 200_000  # documents whose signatures are held at once; sets a task remembers
SMALL = 64           # up to this size all segments are doubled
WEAK_COST = 200.0    # comparisons that a signature of at most one element is expected to cause
GUIDE_DOCS = 4_000   # documents, about, whose shingles tell frequent ones
FREQUENT, MOST_FREQUENT = 0.003, 50_000  # share of them that makes a shingle frequent; frequent shingles kept


def band_edges(num: int, den: int, top: int) -> list[int]:
    """Band k holds the sizes from ``edges[k]`` to below ``edges[k + 1]``; sizes that link lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    return edges


_SCHEMES: dict[tuple[int, int, int, int], tuple[int, int, int]] = {}  # a plain table travels by value to workers without the package


def scheme(num: int, den: int, low: int, high: int) -> tuple[int, int, int]:
    """``(segments, doubled, spare)`` for sets of ``low`` to ``high`` elements; no segments where only equal sets link."""
    key = (num, den, low, high)
    if key not in _SCHEMES:
        _SCHEMES[key] = _scheme(*key)
    return _SCHEMES[key]


def _scheme(num: int, den: int, low: int, high: int) -> tuple[int, int, int]:
    worst = (den - num) * 2 * high // (den + num)
    if worst == 0:
        return 0, 0, 0
    if high <= SMALL:
        m = (worst + 2) // 2
        return m, m, 2 * m - worst - 1
    best, size = None, (low + high) / 2
    for spare in sorted({0, *(math.ceil(f * worst) for f in (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.4, 0.55))}):
        for doubled in sorted({0, *(math.ceil(f * worst) for f in (0.01, 0.02, 0.05, 0.1))}):
            m = worst + 1 + spare - doubled
            if m - doubled <= spare:
                continue
            each = size / m
            few = math.exp(-each) * (1 + each)  # a doubled segment of one element has the empty one among its neighbours
            weak = max(0.0, (m - doubled) * few - spare) + doubled * 10 * few  # and cannot be left out
            cost = m - spare + doubled * each + WEAK_COST * weak
            if best is None or cost < best[0]:
                best = (cost, m, doubled, spare)
    return best[1:]


def signatures(s: np.ndarray, num: int, den: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a sorted set: any two sets that link share one, unless they are equal or empty.  ``frequent``: a sorted array of
    elements that make a segment costly; it must be the same for all sets."""
    if not s.size:
        return np.empty(0, np.uint64)
    edges = band_edges(num, den, s.size * den // num + 2)
    band = int(np.searchsorted(edges, s.size, side="right")) - 1
    out, value = [], mix(s ^ np.uint64(0x5851F42D4C957F2D))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    rare = np.ones(s.size) if frequent is None or not frequent.size else (frequent[np.minimum(np.searchsorted(frequent, s), frequent.size - 1)] != s).astype(float)
    for p in (band - 1, band):
        if p < 0:
            continue
        m, doubled, spare = scheme(num, den, edges[p], edges[p + 2] - 1)
        if not m:
            continue
        segment = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # never falls, as s is sorted
        counts = np.bincount(segment, minlength=m)
        stop = np.cumsum(counts)
        sums = total[stop] - total[stop - counts]
        tag = mix(np.arange(m, dtype=np.uint64) + (np.uint64(p) << np.uint64(40)))
        single = np.arange(doubled, m)
        if 0 < spare < single.size and doubled < m:
            own = np.bincount(segment, rare, m).astype(np.int64)
            single = single[np.lexsort((single, counts[doubled:], own[doubled:]))[spare:]]
        kept = np.concatenate((np.arange(doubled), single))
        out.append(mix(sums[kept] + tag[kept]))
        if doubled:
            n = int(stop[doubled - 1])
            seg = segment[:n]
            out.append(mix(sums[seg] - value[:n] + tag[seg]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the set in each cell, a power of two of them by the set's size; two bitmaps of one length differ in at most as many
    cells as the sets differ in elements, and a longer one folds to half its length by exclusive or of its halves."""
    words = min(BITMAP_WORDS[1], max(BITMAP_WORDS[0], 1 << max(0, (s.size - 1) // 32).bit_length()))
    bits = np.bincount((mix(s) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, k1, k2``: set size and a key of the set under each of two independent word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("none")
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            size = np.array([s.size for s in sets], np.int64)
            k1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            other = shingle_sets(batch.column(1).to_pylist(), n, 1)
            k2 = np.array([mix(s).sum(dtype=np.uint64) for s in other], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(k1), pa.array(k2)], names=["doc_id", "n_shingles", "k1", "k2"])

    return _rows(docs, key, text).mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint")


_FOLDS = [f"f{i}" for i in range(4)]


def _maps(texts: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, map, f0..f3``: set size, parity bitmap, and the bitmap folded to 256 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            maps = [bitmap(s) for s in sets]
            folds = np.stack([np.bitwise_xor.reduce(m.reshape(-1, 4), axis=0) for m in maps]) if maps else np.empty((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(maps, pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(folds[:, i])) for i in range(4)]],
                names=["doc_id", "n_shingles", "map", *_FOLDS],
            )

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, map array<bigint>, " + ", ".join(f"{f} bigint" for f in _FOLDS))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _frequent(docs: DataFrame, n: int, rows: int, key: str, text: str) -> np.ndarray:
    """Shingles that many of some documents hold, picked by hashed id; at most ``MOST_FREQUENT``, sorted."""
    share = math.ceil(min(1.0, GUIDE_DOCS / max(1, rows)) * (1 << 30))
    some = _rows(docs, key, text).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            names, counts = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    least = max(8, math.ceil(FREQUENT * min(rows, GUIDE_DOCS)))
    sums = some.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = sums.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


def _index(docs: DataFrame, n: int, num: int, den: int, key: str, text: str, frequent: np.ndarray) -> DataFrame:
    """``sig, doc_id``; of equal sets near each other in a task only the first is indexed, which saves work only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("none")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, sigs = [], []
                if len(seen) > SEEN:
                    seen.clear()
                for k, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), n)):
                    if k is None or not s.size:
                        continue
                    same = (int(mix(s).sum(dtype=np.uint64)), s.size)
                    if same in seen:
                        continue
                    seen.add(same)
                    sigs.append(signatures(s, num, den, frequent))
                    ids.append(np.full(sigs[-1].size, k, np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], names=["sig", "doc_id"])

    return _rows(docs, key, text).mapInArrow(run, "sig bigint, doc_id bigint")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and id become ``(sig, smallest id, id)`` for each further id of a signature."""
    last_sig, centre = None, None
    for batch in batches:
        sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not sig.size:
            continue
        new = np.concatenate(([last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(sig.size), -1))
        first = np.where(head >= 0, ids[head], centre if centre is not None else 0)
        keep = ~new & (ids != first)
        last_sig, centre = sig[-1], first[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(first[keep]), pa.array(ids[keep])], names=["sig", "a", "b"])


def _close(x: str, y: str, num: int, den: int) -> Column:
    """What two linked sets must satisfy: near sizes, and bitmaps no further apart than the sets may be."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    mx, my = F.col(f"{x}.map"), F.col(f"{y}.map")
    xor = lambda a, b: a.bitwiseXOR(b)
    fold = lambda m, other: F.when(F.size(m) > F.size(other), F.zip_with(F.slice(m, 1, (F.size(m) / 2).cast("int")), F.slice(m, (F.size(m) / 2).cast("int") + 1, (F.size(m) / 2).cast("int")), xor)).otherwise(m)
    apart = F.aggregate(F.zip_with(fold(mx, my), fold(my, mx), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda s, v: s + v)
    # sizes of a pair that links lie within a factor of two, so one fold is enough; without equal lengths nothing is ruled out
    apart = F.when(F.size(fold(mx, my)) == F.size(fold(my, mx)), apart).otherwise(0)
    # compiled tests come first: few pairs reach the whole bitmaps
    coarse = sum((F.bit_count(xor(F.col(f"{x}.{f}"), F.col(f"{y}.{f}"))) for f in _FOLDS), F.lit(0))
    may = (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (coarse * (den + num) <= (nx + ny) * (den - num))
    return F.when(may, apart * (den + num) <= (nx + ny) * (den - num)).otherwise(F.lit(False))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs that link, with the sizes of intersection and union."""
    t = texts.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    both = pairs.join(t.withColumnsRenamed({"id": "b", "t": "tb"}), "b").join(t.withColumnsRenamed({"id": "a", "t": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, ones = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                others = part.column(3).to_pylist()
                for a, b, ta, *sets in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), shingle_sets(others, n), shingle_sets(others, n, 1)):
                    if ta != text:
                        text, ones = ta, [shingle_sets([ta], n, seed)[0] for seed in (0, 1)]
                    shared = []
                    for one, s in zip(ones, sets):
                        both = np.sort(np.concatenate((one, s)))
                        shared.append(int((both[1:] == both[:-1]).sum()))
                    common_n = min(shared)  # a chance collision can only add to one of the two
                    union = max(o.size + s.size for o, s in zip(ones, sets)) - common_n
                    if union and den * common_n >= num * union:
                        rows.append((a, b, common_n, union))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["a", "b", "n_common", "n_union"])

    return both.mapInArrow(run, "a bigint, b bigint, n_common bigint, n_union bigint")


def join(docs: DataFrame, n: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents whose shingle sets satisfy ``den * intersection >= num * union``.

    Returns ``(classes, links)``.  ``classes``: ``doc_id, n_shingles, representative, component_id`` for each row of ``docs``;
    equal sets share a representative, the smallest id; ``component_id`` is the smallest id reachable by links.  ``links``:
    ``a, b, n_common, n_union``, links between representatives that were found and suffice to connect their components.
    A null or wordless text has no shingles and is its own component; a row with a null id has a null component.  Rows that
    repeat an id count as one document.  Other columns of ``docs`` are not read.
    """
    members = common.settled(describe(docs, n, key, text), "sets")
    whole = members.where("doc_id is not null and n_shingles > 0")
    reps = whole.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("representative"))
    of = common.settled(whole.join(reps, ["k1", "k2", "n_shingles"]).select("doc_id", "representative"), "representatives")
    frequent = _frequent(docs, n, members.count(), key, text)
    index = _index(docs, n, num, den, key, text, frequent).repartition("sig").sortWithinPartitions("sig", "doc_id")
    stars = index.mapInArrow(_stars, "sig bigint, a bigint, b bigint")
    stars = common.settled(stars.join(of.select(F.col("doc_id").alias("a"), F.col("representative").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("representative").alias("rb")), "b").where("ra <> rb").select("sig", F.col("ra").alias("a"), F.col("rb").alias("b")), "stars")

    texts = common.settled(common.rows_of(_rows(docs, key, text), stars.select(F.explode(F.array("a", "b")).alias("doc_id"))).dropDuplicates(["doc_id"]), "texts", compression="zstd")
    described = common.settled(_maps(texts, n), "described")

    def near(pairs: DataFrame) -> DataFrame:
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(described.alias("x"), F.col("a") == F.col("x.doc_id")).join(described.alias("y"), F.col("b") == F.col("y.doc_id"))
        return p.where(_close("x", "y", num, den)).select("a", "b")

    first = common.settled(near(stars), "pairs")
    links = common.settled(_verify(first, texts, n, num, den), "verified")
    found = common.components(links)

    # signatures whose members are not yet connected: compare what lies in different components
    held = stars.select("sig", F.col("a").alias("id")).unionAll(stars.select("sig", F.col("b").alias("id"))).distinct()
    labelled = held.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    rest = common.settled(labelled.join(mixed, "sig").join(described.withColumnRenamed("doc_id", "id"), "id"), "mixed")
    cross = rest.alias("x").join(rest.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _close("x", "y", num, den))
    second = common.settled(cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = common.settled(_verify(second, texts, n, num, den), "verified")
    links = links.unionAll(more)
    final = common.components(links) if not more.isEmpty() else found

    classes = members.select("doc_id", "n_shingles").join(of.distinct(), "doc_id", "left")
    classes = classes.join(final.withColumnRenamed("node", "representative"), "representative", "left")
    return classes.select("doc_id", "n_shingles", "representative", F.coalesce("component", "representative", "doc_id").alias("component_id")), links


@common.query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = join(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return classes.select("doc_id", "n_shingles", "component_id")
