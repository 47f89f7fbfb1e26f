"""How much each feature contributes, over all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .diagnostics import top_importances

TOP = 10  # fixed value: features of the attribution plot
ROWS_PER_BUCKET = 50_000


def linear_attribution(df: DataFrame, features: str, weights: Sequence[float], names: Sequence[str], top: int | None = TOP) -> DataFrame:
    """``(feature, importance)``: mean |w (x - mean x)|, the exact Shapley value size of a linear model with independent
    features (Lundberg and Lee 2017)."""
    mean = df.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray().tolist()
    pars = F.arrays_zip(F.lit([float(w) for w in weights]).alias("w"), F.lit(mean).alias("m"))
    part = F.zip_with(vector_to_array(F.col(features)), pars, lambda x, p: F.abs(p["w"] * (x - p["m"])))
    size = df.select(array_to_vector(part).alias("v")).select(vector_to_array(Summarizer.mean(F.col("v"))).alias("v"))
    table = size.select(F.posexplode("v").alias("i", "importance")).select(F.get(F.lit(list(names)), F.col("i")).alias("feature"), "importance")
    return top_importances(table, top) if top else table


def shuffled_columns(df: DataFrame, columns: Sequence[str], key: str, seed: int, rows: int) -> DataFrame:
    """Adds ``_shuffled_<i>``: each column permuted over the rows, every value used once.

    Rows fall into hashed buckets of bounded size and hand their values to the next row of the bucket in hash order, so
    one shuffle permutes all columns and no task sorts the table.
    """
    buckets = max(1, rows // ROWS_PER_BUCKET)
    w = Window.partitionBy("_bucket").orderBy("_order", key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = df.withColumns({
        "_bucket": F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)), "_order": F.xxhash64(F.col(key), F.lit(seed + 1)),
    })
    return tagged.withColumns({
        f"_shuffled_{i}": F.when(F.lead(F.lit(1)).over(w).isNull(), F.first(col(c)).over(whole)).otherwise(F.lead(col(c)).over(w))
        for i, c in enumerate(columns)
    }).drop("_bucket", "_order")


def permutation_importance(
    model: PipelineModel, df: DataFrame, columns: Sequence[str], key: str, loss: Callable[[DataFrame], float], seed: int = 42, top: int | None = TOP
) -> DataFrame:
    """``(feature, importance)``: rise of the loss when one raw column is permuted."""
    rows = df.count()
    mixed = shuffled_columns(df, columns, key, seed, rows).persist()
    try:
        base = loss(model.transform(df))
        out = []
        for i, c in enumerate(columns):
            out.append((c, float(loss(model.transform(mixed.withColumn(c, F.col(f"_shuffled_{i}")).drop(*[f"_shuffled_{j}" for j in range(len(columns))]))) - base)))
    finally:
        mixed.unpersist()
    table = df.sparkSession.createDataFrame(out, "feature string, importance double")
    return top_importances(table, top) if top else table
