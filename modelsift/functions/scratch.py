"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, or under the warehouse of a session that does not set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``scratch_path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settled(df, kind: str = "table"):
    """Write a frame to the shared folder and read it back: a durable cut of its lineage."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
