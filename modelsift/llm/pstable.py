"""Approximate nearest neighbours: multiprobe p-stable hashing.

A table hashes a vector to the cells of several random projections.  A query visits its own bucket and then buckets one cell
away in some projections, in the order in which they are likely to hold near vectors: the squared distances to the cell borders
that are crossed, with the order of the sums taken from their expectation.  Each bucket ranks its rows by exact distance and
passes on the best; the tables' candidates are merged.

Cell width, projections and probes are fitted on a bounded sample: the distance of a far-enough neighbour is measured there, and
the probes are counted by simulation until that neighbour is found with the wanted chance.  Every row is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import mix
from .vectors import matrix, usable

SAMPLE_ROWS = 20_000   # rows the index is fitted on
SAMPLE_QUERIES = 200   # of them used as queries
TABLES = 10
WANTED = 0.98          # chance aimed at that the fitted neighbour is found
CELL = 1.9             # cell width over the fitted distance
BUCKET = 200           # rows a bucket should hold
MOST_PROBES = 3000     # probes a table may take; projections are given up before
SHARD = 20_000         # rows ranked in one task
SEED = 20240301


@dataclass
class Index:
    dim: int
    width: float
    planes: int
    probes: int
    tables: int = TABLES

    def draw(self, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, table])
        odd = rng.integers(0, 1 << 63, self.planes, dtype=np.uint64) | np.uint64(1)
        return rng.standard_normal((self.dim, self.planes)), rng.uniform(0, self.width, self.planes), odd


def probe_order(planes: int, most: int) -> list[tuple[int, ...]]:
    """Sets of crossings in order of their expected cost.  Crossing k is the k-th nearest of the 2 x planes borders; a set does not
    cross both borders of a projection, whose ranks sum to 2 x planes - 1."""
    k = np.arange(1, 2 * planes + 1)
    near = k * (k + 1) / (4 * (planes + 1) * (planes + 2))
    r = 2 * planes + 1 - k
    far = 1 - r / (planes + 1) + r * (r + 1) / (4 * (planes + 1) * (planes + 2))
    cost = np.where(k <= planes, near, far)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if all(2 * planes - 1 - x not in s for x in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * planes:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], s[:-1] + (last + 1,)))
            heapq.heappush(heap, (c + cost[last + 1], s + (last + 1,)))
    return out


def probes_needed(planes: int, ratio: float, wanted: float, tables: int, most: int, trials: int = 4000) -> int | None:
    """Probes with which ``tables`` tables find a neighbour at ``1 / ratio`` cell widths with chance ``wanted``; None if too many."""
    rank = {frozenset(s): i for i, s in enumerate(probe_order(planes, most))}
    rng = np.random.default_rng(SEED)
    f = rng.uniform(size=(trials, planes))
    step = np.floor(f + rng.standard_normal((trials, planes)) / ratio).astype(int)
    border = np.argsort(np.argsort(np.concatenate((f, 1 - f), axis=1), axis=1), axis=1)
    ranks = np.full(trials, np.inf)
    for t in range(trials):
        if (abs(step[t]) <= 1).all():
            crossed = frozenset(int(border[t, i] if step[t, i] < 0 else border[t, planes + i]) for i in np.flatnonzero(step[t]))
            ranks[t] = rank.get(crossed, np.inf)
    each = 1 - (1 - wanted) ** (1 / tables)
    need = np.sort(ranks)[min(trials - 1, math.ceil(each * trials))]
    return int(need) + 1 if np.isfinite(need) else None


def fit(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", wanted: float = WANTED) -> Index | None:
    """Fit on about ``SAMPLE_ROWS`` usable rows, at most twice as many, picked by hashed key; None without rows."""
    n = rows.count()
    share = math.ceil(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30))  # of hashed keys
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).select(F.xxhash64(key).alias("h"), F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v")).limit(2 * SAMPLE_ROWS).toPandas().sort_values(["h", "k"])
    if not len(sample):
        return None
    dim = len(sample["v"].iloc[0])
    x = np.array([v for v in sample["v"] if len(v) == dim])
    q = x[:SAMPLE_QUERIES]
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(0, square[: len(q), None] + square - 2 * q @ x.T))
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    place = min(max(1, round(k * len(x) / n)), max(1, len(x) - 1)) - 1
    near = np.sort(d, axis=1)[:, place]
    near = near[np.isfinite(near) & (near > 0)]
    reach = float(np.quantile(near, 0.6)) if near.size else 1.0
    spread = float(np.median(x.std(0) * math.sqrt(dim))) or 1.0
    width = CELL * reach
    cells = max(1.2, 2 * spread * 2 / width)  # cells of a projection that hold most rows
    planes = max(2, min(24, round(math.log(max(2, n / BUCKET)) / math.log(cells))))
    while planes > 1:
        probes = probes_needed(planes, CELL, wanted, TABLES, MOST_PROBES)
        if probes:
            return Index(dim, width, planes, probes)
        planes -= 1
    return Index(dim, width, 1, 3)


def _cells(x: np.ndarray, index: Index, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, odd = index.draw(table)
    h = (x @ a + b) / index.width
    cell = np.floor(h)
    return cell.astype(np.int64), h - cell, odd


def _code(cell: np.ndarray, odd: np.ndarray, table: int) -> np.ndarray:
    return (cell.astype(np.uint64) * odd).sum(axis=-1, dtype=np.uint64) + mix(np.full(1, table, np.uint64))[0]


def _index_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(index.tables if batch.num_rows else 0):
                cell, _, odd = _cells(x, index, t)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mix(_code(cell, odd, t)).view(np.int64))], names=["vec_id", "vector", "code"])

    return run


def _probe_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probe_order(index.planes, index.probes)
        crossed = np.zeros((len(order), 2 * index.planes), np.uint64)
        for i, s in enumerate(order):
            crossed[i, list(s)] = 1
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(index.tables if batch.num_rows else 0):
                cell, rest, odd = _cells(x, index, t)
                border = np.argsort(np.concatenate((rest, 1 - rest), axis=1), axis=1, kind="stable")
                step = np.concatenate((np.uint64(0) - odd, odd))[border]  # what crossing the k-th nearest border adds to the code
                codes = mix(_code(cell, odd, t)[:, None] + step @ crossed.T)
                ids = np.repeat(batch.column(0).to_numpy(), codes.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes.ravel().view(np.int64))], names=["query_id", "code"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows by exact distance, ties to the smaller id, without the query itself."""
    ok = ids != query
    ids, x = ids[ok], x[ok]
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(ids) > k:
        cut = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = ids[cut], d[cut]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _rank(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if data.num_rows and queries.num_rows:
            code = data.column("code").to_numpy()
            order = np.argsort(code, kind="stable")
            code, ids, x = code[order], data.column("vec_id").to_numpy()[order], matrix(data.column("vector"))[order]
            q = matrix(queries.column("vector"))
            for row, (query, codes) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("codes").to_pylist())):
                codes = np.array(codes, np.int64)
                lo, hi = np.searchsorted(code, codes), np.searchsorted(code, codes, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if b > a] or [np.empty(0, np.int64)])
                if at.size:
                    at = at[np.unique(ids[at], return_index=True)[1]]  # a row may come from several tables
                    got, d = _best(ids[at], x[at], q[row], query, k)
                    out_q.append(np.full(len(got), query))
                    out_v.append(got)
                    out_d.append(d)
        cat = lambda a, kind: np.concatenate(a).astype(kind) if a else np.empty(0, kind)
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "score": cat(out_d, np.float64)})

    return run


_FOUND = "query_id bigint, vec_id bigint, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` nearest rows found, without the row of its own id.

    A query for which the tables hold fewer than ``k`` rows is searched exactly, in blocks.  Unusable vectors (null, zero, null or
    non-finite components) and those of another dimension than the index take no part.  Of rows that repeat an id, the first by
    distance counts.  Without usable rows the result is empty.
    """
    spark = rows.sparkSession
    take = lambda df: usable(df, key, vector).select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    data = take(rows)
    index = index or fit(data, k, "vec_id", "vector")
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    data = data.where(F.size("vector") == index.dim)
    asked = take(queries).where(F.size("vector") == index.dim).dropDuplicates(["vec_id"])
    # of equal vectors only the smallest ids can be among the nearest
    distinct = data.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    data = common.settled(distinct, "vectors")
    total = data.count()
    shards = max(1, math.ceil(total * index.tables / SHARD))

    coded = data.mapInArrow(_index_rows(index), "vec_id bigint, vector array<double>, code bigint")
    large = coded.groupBy("code").count().where(F.col("count") > SHARD).select("code", F.ceil(F.col("count") / SHARD).alias("blocks"))
    large = common.settled(large, "large")
    blocks = F.coalesce("blocks", F.lit(1))
    shard = lambda block: F.pmod(F.xxhash64("code", block), F.lit(shards))
    left = coded.join(large, "code", "left").withColumn("shard", shard(F.pmod(F.xxhash64("vec_id"), blocks))).select("shard", "vec_id", "vector", "code")
    probes = asked.mapInArrow(_probe_rows(index), "query_id bigint, code bigint").join(large, "code", "left")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1))).withColumn("shard", shard(F.col("block")))
    probes = probes.groupBy("shard", "query_id").agg(F.collect_set("code").alias("codes"))  # at most all probes of one query
    right = probes.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").select("shard", "query_id", "vector", "codes")
    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_rank(k), _FOUND)
    found = common.settled(_top(found, k), "found")

    enough = min(k, max(0, total - 1))
    few = found.groupBy("query_id").count().where(F.col("count") >= enough).select("query_id")
    short = common.settled(asked.withColumnRenamed("vec_id", "query_id").join(few, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        exact = _exact(data, short, k)
        found = _top(found.select("query_id", "vec_id", "score").unionAll(exact), k)
    return found.select("query_id", "rank", "vec_id", "score")


def _exact(data: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """All rows against the given queries, block by block."""
    rows, asked = math.ceil(data.count() / SHARD), math.ceil(queries.count() / block)
    left = data.withColumn("row", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows)))).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(max(0, asked - 1)))))
    right = queries.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked))).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, rows - 1)).cast("bigint"))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, x, q = a.column("vec_id").to_numpy(), matrix(a.column("vector")), matrix(b.column("vector"))
            for row, query in enumerate(b.column("query_id").to_pylist()):
                got, d = _best(ids, x, q[row], query, k)
                out.append(pa.table({"query_id": np.full(len(got), query, np.int64), "vec_id": got.astype(np.int64), "score": d.astype(np.float64)}))
        empty = pa.table({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.float64)})
        return pa.concat_tables([empty, *out])

    return left.groupBy("row", "ask").cogroup(right.groupBy("row", "ask")).applyInArrow(run, _FOUND)


@common.query("op10_multiprobe_neighbours")
def op10_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"), 10)
