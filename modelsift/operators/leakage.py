"""Features that give the target away."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import abs_pearson, agg_row, boolean_columns, chunks, col, field_of, is_numeric, number, numeric_columns, text_columns

# fixed values of the checks
THRESHOLD, RTOL, ATOL = 0.95, 1e-5, 1e-8
PROXY_WORDS = ("target", "label", "result", "outcome", "output")
PAIRS_PER_SCAN = 100
SCREEN_ROWS = 64


def correlation_leaks(df: DataFrame, target: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(feature, abs_r, leak)`` for every numeric feature; one scan."""
    nums = numeric_columns(df, [target])
    y = number(df, target)
    row = df.agg(*[abs_pearson(number(df, c), y).alias(f"c{i}") for i, c in enumerate(nums)])
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"c{i}").alias("abs_r"),
            F.coalesce(F.col(f"c{i}") > threshold, F.lit(False)).alias("leak"),
        )
        for i, c in enumerate(nums)
    ])))


def _holds(df: DataFrame, a: str, b: str, target: str) -> Column:
    y = number(df, target)
    close = F.abs(number(df, a) * number(df, b) - y) <= ATOL + RTOL * F.abs(y)
    return F.coalesce(F.bool_and(F.coalesce(close, F.lit(False))), F.lit(False))


def identity_leaks(df: DataFrame, target: str, max_columns: int | None = None) -> DataFrame:
    """Pairs whose product equals the target on every row: ``(feature_a, feature_b)``.

    A pair that fails on any row is no identity, so a handful of rows rules out nearly all pairs; only the
    survivors are tested on the whole table.  ``max_columns`` skips the check on wider tables, which is logged.
    """
    nums = numeric_columns(df, [target])
    schema = "feature_a string, feature_b string"
    if max_columns is not None and len(nums) > max_columns:
        logging.getLogger(__name__).warning("product check skipped: %d numeric columns, %d allowed", len(nums), max_columns)
        return df.sparkSession.createDataFrame([], schema)
    kept = []
    for part in chunks(_screened(df, nums, target), PAIRS_PER_SCAN):
        seen = df.agg(*[_holds(df, a, b, target).alias(f"p{i}") for i, (a, b) in enumerate(part)]).first()
        kept += [pair for i, pair in enumerate(part) if seen[f"p{i}"]]
    return df.sparkSession.createDataFrame(kept, schema)


def _screened(df: DataFrame, nums: list[str], target: str) -> list[tuple[str, str]]:
    """Pairs that hold on a few rows."""
    rows = df.select(*[number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate([*nums, target])]).limit(SCREEN_ROWS).collect()
    if not rows:
        return []
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    y, out = x[:, -1], []
    with np.errstate(all="ignore"):
        for i in range(len(nums)):
            close = np.abs(x[:, i : i + 1] * x[:, i + 1 : -1] - y[:, None]) <= (ATOL + RTOL * np.abs(y))[:, None]
            out += [(nums[i], nums[i + 1 + j]) for j in np.flatnonzero(close.all(0))]
    return out


def name_leaks(df: DataFrame, target: str) -> list[str]:
    """Text or boolean columns whose name says they stand for the target."""
    named = text_columns(df, [target]) + boolean_columns(df, [target])
    return [c for c in named if any(w in c.lower() for w in PROXY_WORDS)]


def crosstab(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Contingency table in long form ``(feature value, target value, n)``; rows null on either side are left out."""
    return (
        df.filter(col(feature).isNotNull() & col(target).isNotNull())
        .groupBy(col(feature).alias("feature_value"), col(target).alias("target_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def one_to_one_leaks(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, n_feature, n_target, n_pairs, leak)``: a feature leaks when all three counts agree.

    Grouping ``(feature value, target value)`` first makes the counts over small frames with partial aggregation,
    and keeps one column's distinct set from multiplying the rows of the others.
    """
    columns = list(columns if columns is not None else text_columns(df, [target]) + boolean_columns(df, [target]))
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "feature string, n_feature bigint, n_target bigint, n_pairs bigint, leak boolean")
    n_target = df.agg(F.count_distinct(col(target))).scalar()
    out = None
    for c in columns:
        cells = df.groupBy(col(c).alias("f"), col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
        counts = cells.agg(
            F.count_distinct("f").alias("n_feature"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_pairs")
        ).select(F.lit(c).alias("feature"), "n_feature", n_target.alias("n_target"), "n_pairs")
        out = counts if out is None else out.unionAll(counts)
    same = (F.col("n_feature") == F.col("n_target")) & (F.col("n_pairs") == F.col("n_feature"))
    return out.withColumn("leak", same)


def _could_be_one_to_one(df: DataFrame, target: str, columns: Sequence[str]) -> list[str]:
    """Columns a few rows do not already rule out; exact only when neither side holds nulls."""
    nulls = agg_row(df, {c: F.count_if(col(c).isNull()) for c in [*columns, target]})
    few = df.limit(SCREEN_ROWS)
    out = []
    for c in columns:
        if nulls[c] or nulls[target]:
            out.append(c)
            continue
        seen = few.agg(
            F.count_distinct(col(c)).alias("f"), F.count_distinct(col(target)).alias("t"),
            F.count_distinct(F.struct(col(c), col(target))).alias("p"),
        ).first()
        if seen["p"] == seen["f"] == seen["t"]:
            out.append(c)
    return out


def find_leaks(df: DataFrame, target: str, threshold: float = THRESHOLD, max_columns: int | None = None) -> dict[str, str]:
    """``{feature: reason}`` over all checks; nothing is checked for a non-numeric target."""
    if target not in df.columns or not is_numeric(field_of(df, target)):
        return {}
    found: dict[str, str] = {}
    if numeric_columns(df, [target]):
        for r in correlation_leaks(df, target, threshold).filter("leak").collect():
            found[r["feature"]] = "correlation"
        for r in identity_leaks(df, target, max_columns).collect():
            found.setdefault(r["feature_a"], "product")
            found.setdefault(r["feature_b"], "product")
    for c in name_leaks(df, target):
        found.setdefault(c, "name")
    rest = [c for c in text_columns(df, [target]) + boolean_columns(df, [target]) if c not in found]
    rest = _could_be_one_to_one(df, target, rest) if rest else []
    if rest:
        for r in one_to_one_leaks(df, target, rest).filter("leak").collect():
            found[r["feature"]] = "one-to-one"
    return found


def drop_leaks(df: DataFrame, target: str, threshold: float = THRESHOLD, max_columns: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    found = find_leaks(df, target, threshold, max_columns)
    return df.drop(*found), found
