"""Centroid clustering in exact integers: a tournament of bisectors finds the nearest centroid, the last distance is exact.

For centroids i < j the sign of ``normal . x - threshold``, with normal ``2 (c_j - c_i)`` and threshold ``|c_j|^2 - |c_i|^2``, tells
on which side of their bisector x lies: positive is nearer to j, zero (a tie) stays with the smaller number.  k - 1 such tests leave
one centroid.  A round is one scan: each task sums its vectors per cluster, Spark adds the sums, and k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LARGEST = 1 << 27  # components up to here keep every product, test and squared distance of 64 components inside 64 bits


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(normals, thresholds)`` of all centroid pairs: int64 arrays of shapes (k, k, d) and (k, k)."""
    sizes = (centroids * centroids).sum(1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), sizes[None, :] - sizes[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(centroid, squared distance)`` for each row of ``x``; all arrays are int64."""
    winner = np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        for i in np.unique(winner).tolist():  # rows with the same winner share one bisector
            at = np.flatnonzero(winner == i)
            winner[at[x[at] @ normals[i, j] > thresholds[i, j]]] = j
    gap = x - centroids[winner]
    return winner, (gap * gap).sum(1)


def _integers(scale: int, dims: int):
    """Batches of id and vector to packed little-endian int32 components; rows beyond ``LARGEST`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            x = np.floor(scale * x)
            fits = (np.abs(x) <= LARGEST).all(1)
            packed = x[fits].astype("<i4")
            yield pa.record_batch([batch.column(0).filter(pa.array(fits)), pa.array([v.tobytes() for v in packed], pa.binary())], names=["id", "x"])

    return run


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _sums(centroids: np.ndarray):
    """One row per cluster of a task: vectors and component sums, held in Python integers so that no sum wraps."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        counts, sums = [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(1), dims)
                winner, _ = nearest(x, centroids, *planes)
                for c in np.unique(winner).tolist():
                    counts[c] += int((winner == c).sum())
                    sums[c] += x[winner == c].sum(0).astype(object)
        seen = [c for c in range(k) if counts[c]]
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array([counts[c] for c in seen], pa.int64()), pa.array([[int(v) for v in sums[c]] for c in seen], pa.list_(pa.int64()))], names=["cluster", "count", "sums"])

    return run


def _assign(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        for batch in batches:
            winner, distance = nearest(_unpack(batch.column(1), dims), centroids, *planes) if batch.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.record_batch([batch.column(0), pa.array(winner.astype(np.int32)), pa.array(distance.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, k: int, rounds: int, dims: int, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(assignment, centroids)``: ``vec_id, cluster, distance`` per vector, and the final centroids as int64 rows.

    Vectors are the rows with exactly ``dims`` components, none null or non-finite; x becomes the integer floor(scale * x).  Rows
    with an integer beyond ``LARGEST`` in size are left out as well, because a squared distance to them need not fit a bigint.
    Start: the k vectors with the smallest sha256 of ``seed:id``; rows that repeat an id count each, ties go to the smaller vector, a
    null id comes last.  Fewer than k vectors give as many clusters; none give an empty table.  Other columns do not matter.
    """
    v, bad = F.col(f"`{vector}`"), F.lit(float("inf"))
    whole = F.size(v) == dims
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bad))
    kind = dict(rows.dtypes)[key]
    fit = rows.where(v.isNotNull() & whole & F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").alias("id"), v.alias("x"))
    packed = common.settled(fit.mapInArrow(_integers(scale, dims), f"id {kind}, x binary"), "integers")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = packed.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(-1, dims)
    if len(first):
        for _ in range(rounds):
            part = packed.mapInArrow(_sums(centroids), "cluster int, count bigint, sums array<bigint>")
            total = part.groupBy("cluster").agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)])
            moved = centroids.copy()
            for r in total.collect():  # one row per centroid
                moved[r["cluster"]] = [int(r[f"s{d}"]) // r["count"] for d in range(dims)]
            if (moved == centroids).all():
                break  # further rounds would change nothing
            centroids = moved
    return packed.mapInArrow(_assign(centroids), f"vec_id {kind}, cluster int, distance bigint"), centroids


def clusters(rows: DataFrame, k: int, rounds: int, dims: int, **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector.  An inertia above the bigint range is null."""
    found, centroids = cluster(rows, k, rounds, dims, **options)
    found = common.settled(found, "assigned")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # one row per centroid
    total, top = sum(int(r["own"]) for r in per), (1 << 63) - 1
    facts = [(r["cluster"], int(r["own"]) if r["own"] <= top else None, total if total <= top else None, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return found.join(F.broadcast(rows.sparkSession.createDataFrame(facts, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin(k: int, rounds: int, dims: int, scale: int = 1024, seed: int = 3) -> str:
    """The same clustering as DuckDB SQL, by plain distances: one pair of steps a round."""
    steps = [f"""
    good as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as hugeint)) as v from embeddings
             where len(embedding) = {dims} and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false)),
    cells as materialized (select vec_id, generate_subscripts(v, 1) as d, unnest(v) as x from good),
    starts as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from good qualify c < {k}),
    c0 as materialized (select c, d, x from starts join cells using (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} as materialized (select vec_id, min(struct_pack(distance := distance, cluster := c)) as best from
        (select vec_id, c, sum((cells.x - c{i}.x) * (cells.x - c{i}.x)) as distance from cells join c{i} using (d) group by vec_id, c) group by vec_id)""")
        if i < rounds:
            steps.append(f"""
    c{i + 1} as materialized (select c{i}.c, c{i}.d, coalesce(m.x, c{i}.x) as x from c{i} left join
        (select best.cluster as c, d, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) as hugeint) // count(*) as x from a{i} join cells using (vec_id) group by 1, 2) m using (c, d))""")
    return f"""with {",".join(steps)},
    names as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as h from c{rounds} group by c)
    select vec_id, cast(best.cluster as integer) as cluster, cast(best.distance as bigint) as distance,
        cast(sum(best.distance) over (partition by best.cluster) as bigint) as cluster_inertia,
        cast(sum(best.distance) over () as bigint) as inertia, h as centroid_sha256
    from a{rounds} join names on c = best.cluster"""


@common.query("op13_bisector_clusters", twin(8, 10, 64))
def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "embeddings"), 8, 10, 64)
