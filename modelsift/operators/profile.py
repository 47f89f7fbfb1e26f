"""Table profile: size, sparsity, normality, linearity, class shares and the rules read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INTEGRAL, abs_pearson, chunks, col, field_of, is_numeric, number, numeric_columns, ratio
from .schema import FEW_LEVELS, split_features

# fixed values of the rules
LARGE_ROWS, STRONG_R, WEAK_R, WEAK_MIN_ROWS, RARE_SHARE, ALPHA = 20_000, 0.7, 0.2, 100, 0.1, 0.05
COLUMNS_PER_SCAN = 3
RULES = ("large_table", "wide_table", "normal_features", "strong_linear", "weak_linear", "rare_class")


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Jarque-Bera over whole columns: ``(feature, n, skewness, kurtosis, jarque_bera, p_value)``; one scan."""
    named = {f"c{i}": c for i, c in enumerate(columns)}
    aggs = []
    for k, c in named.items():
        v = number(df, c)
        aggs += [F.count(v).alias(f"{k}_n"), F.skewness(v).alias(f"{k}_s"), F.kurtosis(v).alias(f"{k}_k")]
    row = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_s").alias("skewness"), F.col(f"{k}_k").alias("kurtosis"))
        for k, c in named.items()
    ])
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return (
        row.select(F.inline(items))
        .withColumn("jarque_bera", F.when(F.col("n") >= 3, jb))
        .withColumn("p_value", F.exp(-F.col("jarque_bera") / 2.0))
    )


def linearity(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Absolute correlation of each numeric feature with the target: ``(feature, abs_r)``; one scan."""
    columns = list(columns or numeric_columns(df, [target]))
    y = number(df, target)
    row = df.agg(*[abs_pearson(number(df, c), y).alias(f"c{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("abs_r")) for i, c in enumerate(columns)
    ])))


def class_share(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, share)`` over non-null targets."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("class", "n", ratio(F.col("n"), total).alias("share"))


def _column_facts(df: DataFrame, target: str, columns: Sequence[str], numeric_y: bool) -> DataFrame:
    """One row per numeric column: ``(total, zeros, n, skewness, kurtosis, r)``.

    A few columns share one aggregate and the aggregates are unioned: each branch scans only its own columns, and its
    generated code stays small enough to be compiled to machine code.
    """
    out = None
    for part in chunks(columns, COLUMNS_PER_SCAN):
        view = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(part)], *([number(df, target).alias("y")] if numeric_y else []))
        aggs = [F.count(F.lit(1)).alias("total")]
        for i in range(len(part)):
            v = F.col(f"v{i}")
            aggs += [F.count_if(v == 0).alias(f"z{i}"), F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"s{i}"), F.kurtosis(v).alias(f"k{i}")]
            aggs.append((abs_pearson(v, F.col("y")) if numeric_y else F.max(F.lit(None).cast("double"))).alias(f"r{i}"))
        rows = view.agg(*aggs).select("total", F.inline(F.array(*[
            F.struct(*[F.col(f"{k}{i}").alias(name) for k, name in (("z", "zeros"), ("n", "n"), ("s", "skewness"), ("k", "kurtosis"), ("r", "r"))])
            for i in range(len(part))
        ])))
        out = rows if out is None else out.unionAll(rows)
    return out


def profile(df: DataFrame, target: str) -> DataFrame:
    """One row ``(n_samples, n_features, ratio, sparsity, is_gaussian, linearity_score, max_linear_score)``."""
    features, _ = split_features(df, target)
    nums = numeric_columns(df, [target])
    numeric_y = is_numeric(field_of(df, target))
    if nums:
        facts = _column_facts(df, target, nums, numeric_y)
        p = F.exp(-F.col("n") / 12.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0))
        tested = F.when(F.col("n") >= 3, p)
        row = facts.agg(
            F.max("total").alias("n"), F.coalesce(ratio(F.sum("zeros"), F.sum("total")), F.lit(0.0)).alias("sparsity"),
            F.coalesce(F.bool_and(tested > ALPHA), F.lit(False)).alias("is_gaussian"),
            *([F.avg("r").alias("mean_r"), F.max("r").alias("max_r")] if numeric_y else [F.max(F.lit(0.0)).alias("mean_r"), F.max(F.lit(0.0)).alias("max_r")]),
        )
    else:
        row = df.agg(F.count(F.lit(1)).alias("n")).withColumns(
            {"sparsity": F.lit(0.0), "is_gaussian": F.lit(False), "mean_r": F.lit(0.0), "max_r": F.lit(0.0)}
        )
    return row.select(
        F.col("n").alias("n_samples"), F.lit(len(features)).cast("bigint").alias("n_features"),
        (F.col("n") / F.lit(float(max(len(features), 1)))).alias("ratio"), "sparsity", "is_gaussian",
        F.col("mean_r").alias("linearity_score"), F.col("max_r").alias("max_linear_score"),
    )


def _minority(df: DataFrame, target: str) -> DataFrame:
    """Smallest class share and number of classes, as one row."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(ratio(F.min("n"), F.sum("n")).alias("share"), F.count(F.lit(1)).alias("levels"))


def profile_rules(df: DataFrame, target: str, profiled: DataFrame | None = None) -> DataFrame:
    """The rules that fire: ``(rule, message)``."""
    row = profiled if profiled is not None else profile(df, target)
    f = field_of(df, target)
    numeric_y = is_numeric(f)
    n, p, r = F.col("n_samples"), F.col("n_features"), F.coalesce("max_linear_score", F.lit(0.0))
    rules = [
        (n > LARGE_ROWS, RULES[0], F.lit("more than 20000 rows: margin and neighbour models will be slow")),
        (p > n, RULES[1], F.lit("more features than rows: prefer a regularised model")),
        (F.col("is_gaussian"), RULES[2], F.lit("numeric features look normally distributed")),
        (r > STRONG_R, RULES[3], F.lit("a feature is strongly linear in the target")),
        ((r < WEAK_R) & (n > WEAK_MIN_ROWS) & F.lit(numeric_y), RULES[4], F.lit("no feature is more than weakly linear in the target")),
    ]
    if not numeric_y or isinstance(f.dataType, INTEGRAL):
        # a numeric target must first be seen to have few levels, so its level count is computed on the same row
        small = _minority(df, target).select(
            F.when((F.lit(not numeric_y)) | (F.col("levels") < FEW_LEVELS), F.col("share"))
        ).scalar()
        row = row.withColumn("_share", small)
        rules.append((
            F.col("_share") < RARE_SHARE, RULES[5],
            F.concat(F.lit("rarest class holds "), F.round(F.col("_share") * 100, 1).cast("string"), F.lit(" percent of the rows")),
        ))
    fired = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("rule"), msg.alias("message"))) for cond, k, msg in rules
    ])
    return row.select(F.inline(F.array_compact(fired)))
