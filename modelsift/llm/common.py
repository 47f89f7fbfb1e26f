"""Helpers the operators share: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    A session without that setting (tests) uses its warehouse folder, which all executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def unused(names: list[str], name: str) -> str:
    """A column name that is not among ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def settled(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this run."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


BROADCAST_IDS = 1_000_000  # ids sent to every executor at most (8 MB); more are joined by a shuffle


def rows_of(rows: DataFrame, ids: DataFrame, key: str = "doc_id", without: bool = False) -> DataFrame:
    """The rows whose key is among ``ids`` (one column ``key``, a table), or those ``without``; a row with a null key is never among
    them.  Few ids, which are counted, go to the rows."""
    few = ids.distinct()
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, key, "left_anti" if without else "left_semi")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: ``(node, component)`` for every node of an edge, component = smallest reachable node.

    ``edges``: bigint columns ``a``, ``b`` (null ends, loops and repeats are ignored).  Alternates the large-star and small-star
    steps: each hangs nodes under the smallest neighbour and at least keeps the number of edges; all state is in Spark tables.
    """
    spark = edges.sparkSession
    e = settled(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    for _ in range(rounds):
        # large star: larger neighbours of a node hang under the smallest of its neighbourhood
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: a node and its smaller neighbours hang under the smallest of them
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(under, "hi")
        nxt = settled(small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "links")
        tops = nxt.select(F.col("lo").alias("hi")).distinct()
        if nxt.join(tops, "hi", "left_semi").isEmpty() and nxt.groupBy("hi").count().where("count > 1").isEmpty():
            return nxt.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(nxt.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        e = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")
