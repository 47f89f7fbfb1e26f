"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Rows are compared only under equal labels.  Equal vectors fold into one with a multiplicity first.  A table's code is the signs
of a vector against some hyperplanes; the number of planes follows the largest label so that buckets stay small, and the number
of tables follows from it so that a pair at the threshold is missed with the stated chance.  A large bucket is cut into blocks
and every two blocks meet in a task of their own.  A pair that several tables find counts in the first, which both codes tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, usable

MISS = 1e-6        # chance that a pair at the threshold shares no bucket
BUCKET = 32        # rows of a label that a bucket should hold
BLOCK = 1024       # rows of a bucket that meet at once
SEED = 20240229


def tables_for(rows_of_label: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """``(planes, tables)`` for labels of up to so many rows."""
    planes = min(62, max(2, math.ceil(math.log2(max(1, rows_of_label) / BUCKET))) if rows_of_label > BUCKET else 2)
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def _coder(planes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(planes, dtype=np.int64)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.array([len(v) for v in column.to_pylist()], np.int64)
            codes = np.empty((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes).tolist():
                if dim not in drawn:
                    drawn[dim] = np.random.default_rng(SEED).standard_normal((dim, planes * tables))
                at = np.flatnonzero(sizes == dim)
                side = matrix(column.take(pa.array(at))) @ drawn[dim] > 0
                codes[at] = side.reshape(len(at), tables, planes) @ weights
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), lists], names=[*batch.schema.names, "dim", "codes"])

    return run


def _compare(threshold: float):
    """A task's block pair: links that no earlier table finds, as counts per row and a forest that connects them."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, low, high = (key[i].as_py() for i in (3, 4, 5))
        block = group.column("block").to_numpy()
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        codes = matrix(group.column("codes")).astype(np.int64)
        x = matrix(group.column("vector"))
        x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
        p = np.flatnonzero(block == low)
        q = p if low == high else np.flatnonzero(block == high)
        i, j = np.nonzero(x[p] @ x[q].T >= threshold)
        i, j = p[i], q[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        if table and i.size:
            new = ~(codes[i, :table] == codes[j, :table]).any(1)
            i, j = i[new], j[new]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        least = ids.copy()  # smallest id each row can reach inside this task
        while i.size:
            both = np.minimum(least[i], least[j])
            after = least.copy()
            np.minimum.at(after, i, both)
            np.minimum.at(after, j, both)
            if (after == least).all():
                break
            least = after
        hit = np.flatnonzero(links)
        return pa.table({"id": ids[hit], "links": links[hit], "least": least[hit]})

    return run


def near_duplicates(rows: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: rows of equal label and dimension link at cosine >= ``threshold``.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.  Rows
    that repeat an id count as further vectors of that id.  A null id has a null component and is kept.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    fit = usable(every, "vec_id", "vector").where("label is not null")
    folded = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    folded = common.settled(folded, "folded")
    most = folded.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    planes, tables = tables_for(most, threshold, miss)
    kinds = dict(folded.dtypes)
    coded = common.settled(folded.mapInArrow(_coder(planes, tables), f"label {kinds['label']}, vector {kinds['vector']}, id bigint, copies bigint, dim bigint, codes array<bigint>"), "coded")

    spread = coded.select("*", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "dim", "table", "code"]
    sizes = spread.groupBy(*bucket).count().where("count > 1").select(*bucket, F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = spread.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = met.select("label", "dim", "code", "table", "low", "high", "block", "id", "copies", "vector", "codes").groupBy("label", "dim", "code", "table", "low", "high").applyInArrow(_compare(threshold), "id bigint, links bigint, least bigint")
    found = common.settled(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = common.components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))

    own = fit.join(folded, ["label", "vector"]).select("vec_id", "id", "copies")
    own = own.join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    own = own.groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "id")).alias("component_id"))
    out = every.select("vec_id").join(own, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@common.query("op7_hyperplane_dedup")
def op7_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"), 0.98)
