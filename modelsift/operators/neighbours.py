"""Exact nearest neighbours as a bounded, pruned, distributed join.

Train rows are assigned to the nearest of a few pivots.  For a query, the triangle inequality gives each pivot cell a
smallest possible distance, and cells that cannot hold one of its k nearest rows are never visited: the home cell is
searched first, its k-th distance then prunes the rest.  A cell is cut into hashed blocks of bounded size and the
queries that visit it into hashed chunks, so one group never grows with the data, however many rows share a cell.
Each (cell, block, chunk) group keeps only its own k best per query.

Two exact reductions remove copies first: equal query vectors are searched once, and of equal train vectors only the
k with the smallest ids can ever be among k neighbours ordered by (distance, id).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError

METRICS = ("euclidean", "manhattan", "minkowski")
BLOCK_ROWS, CHUNK_ROWS, MAX_PIVOTS = 20_000, 5_000, 1024
SLACK = 1e-9  # relative guard on the pruning bounds against rounding
HITS = "query string, id string, distance double"


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``a`` against rows of ``b``, in slices of bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.abs(d).sum(-1) if metric == "manhattan" else np.sqrt((d * d).sum(-1))
    return out


def _closest(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and distance of the ``k`` nearest, by distance, then place in ``b``.

    Euclidean distances are first told by one matrix product; its rounding is bounded, so only the rows that may be among the nearest
    within that bound are measured.
    """
    k = min(k, len(b))
    if metric != "manhattan":
        with np.errstate(over="ignore", invalid="ignore"):
            aa, bb = (a * a).sum(1), (b * b).sum(1)
            rough = aa[:, None] + bb - 2 * (a @ b.T)
            slack = 16 * (a.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max())
        if np.isfinite(rough).all():
            reach = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
            r, c = np.nonzero(rough <= reach[:, None])
            d = np.empty(len(r))
            step = max(1, 4_000_000 // max(1, a.shape[1]))
            for i in range(0, len(r), step):
                e = a[r[i : i + step]] - b[c[i : i + step]]
                d[i : i + step] = np.sqrt((e * e).sum(-1))
            order = np.lexsort((c, d, r))
            first = np.searchsorted(r, np.arange(len(a)))  # r ascends, and so does r[order]
            kept = order[np.arange(len(r)) - first[r] < k]
            return r[kept], c[kept], d[kept]
    d = _distances(a, b, metric)
    top = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(a)), k), top.ravel(), np.take_along_axis(d, top, 1).ravel()


def vector_key(x: Column) -> Column:
    return F.md5(F.to_json(x))


def _pivots(train: DataFrame, n: int) -> np.ndarray:
    """Evenly spread rows: those with the lowest id hashes.  At most ``MAX_PIVOTS`` rows reach the driver."""
    count = min(MAX_PIVOTS, max(1, int(math.sqrt(n) / 4)))
    rows = train.select("x", F.md5("id").alias("h")).orderBy("h").limit(count).collect()
    return np.unique(np.array([r["x"] for r in rows], dtype=float), axis=0)


def _assign(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    @F.pandas_udf("cell int, reach double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "reach": pd.Series(dtype="float64")})
        d = _distances(np.stack(x.to_numpy()), pivots, metric)
        j = d.argmin(1)
        return pd.DataFrame({"cell": j.astype("int32"), "reach": d[np.arange(len(d)), j]})

    return df.withColumn("_a", nearest("x")).select("*", "_a.cell", "_a.reach").drop("_a")


def _plan(queries: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int, metric: str) -> DataFrame:
    """Adds ``home``, the cell searched first, ``bound``, and ``floors``: the least distance to each cell."""
    used = cells["cell"].to_numpy()
    near, far, size = (cells[c].to_numpy() for c in ("near", "far", "n"))

    @F.pandas_udf("home int, bound double, floors array<double>")
    def bounds(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"home": pd.Series(dtype="int32"), "bound": pd.Series(dtype="float64"), "floors": pd.Series(dtype="object")})
        d = _distances(np.stack(x.to_numpy()), pivots[used], metric)
        floor = np.maximum(0.0, np.maximum(d - far, near - d))
        top = d + far  # every row of the cell is at most this far
        order = np.argsort(top, axis=1)
        held = np.cumsum(size[order], axis=1)
        first = np.minimum((held < k).sum(1), len(used) - 1)
        bound = top[np.arange(len(d)), order[np.arange(len(d)), first]]
        return pd.DataFrame({"home": d.argmin(1).astype("int32"), "bound": bound, "floors": list(floor)})

    return queries.withColumn("_b", bounds("x")).select("*", "_b.home", "_b.bound", "_b.floors").drop("_b")


def _search(visits: DataFrame, train: DataFrame, sizes: dict[int, int], k: int, metric: str) -> DataFrame:
    """``visits`` is ``(query, x, slot)``; returns the k best of each (query, slot, block)."""
    per_slot = {r["slot"]: r["count"] for r in visits.groupBy("slot").count().collect()}  # one row per pivot
    if not per_slot:
        return visits.sparkSession.createDataFrame([], HITS)
    blocks = {s: max(1, math.ceil(sizes[s] / BLOCK_ROWS)) for s in per_slot}
    chunks = {s: max(1, math.ceil(n / CHUNK_ROWS)) for s, n in per_slot.items()}
    lookup = lambda m, c: F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), c)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.select(
        "query", F.col("x").alias("qx"), F.col("slot").alias("qs"), F.pmod(F.xxhash64("query"), lookup(chunks, F.col("slot"))).cast("int").alias("qc"),
        spread(lookup(blocks, F.col("slot"))).alias("qb"),
    )
    right = train.filter(F.col("slot").isin(list(per_slot))).select(
        "id", F.col("x").alias("tx"), F.col("slot").alias("ts"), F.pmod(F.xxhash64("id"), lookup(blocks, F.col("slot"))).cast("int").alias("tb"),
        spread(lookup(chunks, F.col("slot"))).alias("tc"),
    )

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"query": [], "id": [], "distance": []}).astype({"query": "str", "id": "str", "distance": "float64"})
        t = t.sort_values("id", kind="stable")
        tx, ids = np.stack(t["tx"].to_numpy()), t["id"].to_numpy()
        out = []
        step = max(1, 2_000_000 // len(t))
        for i in range(0, len(q), step):
            part = q.iloc[i : i + step]
            r, c, d = _closest(np.stack(part["qx"].to_numpy()), tx, k, metric)  # rows are in id order, so ties go to the smaller id
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[r], "id": ids[c], "distance": d}))
        return pd.concat(out)

    return left.groupBy("qs", "qb", "qc").cogroup(right.groupBy("ts", "tb", "tc")).applyInPandas(best, HITS)


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """The k best per query; the rank filter is applied before the shuffle as well as after it."""
    w = Window.partitionBy("query").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(train: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", held: list | None = None) -> DataFrame:
    """``(query, rank, id, distance)`` for each distinct query vector, ties by id.

    ``train`` holds ``id string, x array<double>``; ``queries`` holds ``x``; ``query`` is ``vector_key(x)``.
    Frames used by several of the jobs are persisted (memory and disk, recomputed if an executor is lost) and, when
    ``held`` is given, appended to it for the caller to release.
    """
    held = [] if held is None else held

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    if metric not in METRICS:
        raise ConfigurationError("unknown metric", metric=metric)
    copies = Window.partitionBy(vector_key(F.col("x"))).orderBy("id")
    train = keep(train.select("id", "x").withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k).drop("_r"))
    queries = queries.select("x").withColumn("query", vector_key(F.col("x"))).dropDuplicates(["query"])
    n = train.count()
    if n == 0:
        return train.sparkSession.createDataFrame([], HITS + ", rank int")
    pivots = _pivots(train, n)
    placed = _assign(train, pivots, metric)
    cells = (
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"))
        .orderBy("cell").toPandas()  # one row per pivot
    )
    sizes = dict(enumerate(int(v) for v in cells["n"]))
    slot_of = F.create_map(*[F.lit(v) for i, c in enumerate(cells["cell"]) for v in (int(c), i)])
    placed = placed.withColumn("slot", F.element_at(slot_of, F.col("cell")))
    planned = keep(_plan(queries, pivots, cells, k, metric))
    first = _merge(_search(planned.select("query", "x", F.col("home").alias("slot")), placed, sizes, k, metric), k)
    if len(cells) == 1:
        return first.select("query", "rank", "id", "distance")
    first = keep(first)
    reached = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("seen"))
    tight = planned.join(reached, "query").withColumn("bound", F.least("bound", F.coalesce("seen", F.col("bound"))) * (1 + SLACK) + 1e-300)
    visits = (
        tight.select("query", "x", "home", "bound", F.posexplode("floors").alias("slot", "floor"))
        .filter((F.col("slot") != F.col("home")) & (F.col("floor") * (1 - SLACK) <= F.col("bound")))
        .select("query", "x", "slot")
    )
    rest = _search(visits, placed, sizes, k, metric)
    return _merge(first.select("query", "id", "distance").unionAll(rest), k).select("query", "rank", "id", "distance")


def gathered(train: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query, hits array<struct<distance, label>>)`` in rank order; at most k entries per query."""
    with_label = hits.join(train.select("id", "label").dropDuplicates(["id"]), "id")
    return with_label.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", F.col("label").cast("double").alias("label")))).alias("hits")
    )


def vote(hits: Column, k: int, weights: str, n_classes: int | None) -> Column:
    """Class shares (array) for classification, weighted mean for regression, from the first k hits."""
    near = F.slice(hits, 1, k)
    exact = F.exists(near, lambda h: h["distance"] == 0)
    if weights == "uniform":
        w = lambda h: F.lit(1.0)
    elif weights == "distance":
        # an exact hit has infinite weight, so only exact hits count when there is one
        w = lambda h: F.when(exact, (h["distance"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), h["distance"]))
    else:
        raise ConfigurationError("unknown weights", weights=weights)
    total = F.aggregate(near, F.lit(0.0), lambda a, h: a + w(h))
    if n_classes is None:
        return F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, h: a + w(h) * h["label"]), total)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda c: F.try_divide(F.aggregate(near, F.lit(0.0), lambda a, h: a + F.when(h["label"] == c, w(h)).otherwise(F.lit(0.0))), total),
    )


def argmax(shares: Column) -> Column:
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")
