"""Metrics over a predictions frame.  Every metric is an aggregate; results are one-row or class-sized frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.columns import col, ratio
from .running import running_totals

EPS = 2.220446049250313e-16  # machine epsilon, the clip of the log loss
LOG_LOSS_PENALTY, AUC_FALLBACK = 10.0, 0.5  # fixed values
AVERAGES = ("weighted", "macro", "micro", "binary")


def regression_metrics(df: DataFrame, label: str, prediction: str, n_features: int | None = None) -> DataFrame:
    """One row: ``rmse, mae, r2`` and, when the feature count is known, ``adjusted_r2``."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    row = df.agg(
        F.count(y).alias("n"), F.avg(F.pow(y - p, F.lit(2))).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var"),
    )
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    out = row.select(F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "n")
    if n_features is not None:
        left = F.col("n") - n_features - 1
        adjusted = F.when(left <= 0, F.lit(float("nan"))).otherwise(1 - (1 - F.col("r2")) * (F.col("n") - 1) / left)
        out = out.withColumn("adjusted_r2", adjusted)
    return out.drop("n")


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., y, p, n)``; at most classes squared rows per group."""
    return df.groupBy(*by, col(label).cast("double").alias("y"), col(prediction).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., class, tp, support, predicted, precision, recall, f1)`` from confusion counts."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    long = counts.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )))
    table = long.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731 - zero division counts as zero
    return table.select(
        *by, "class", "tp", "support", "predicted",
        zero(ratio(F.col("tp"), F.col("predicted"))).alias("precision"),
        zero(ratio(F.col("tp"), F.col("support"))).alias("recall"),
        zero(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    )


def averaged(table: DataFrame, average: str = "weighted", by: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """``(by..., accuracy, precision, recall, f1)`` over the classes of ``per_class``."""
    scores = ("precision", "recall", "f1")
    share = F.coalesce(ratio(F.sum("tp"), F.sum("support")), F.lit(0.0))
    if average == "weighted":
        cols = [F.coalesce(ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")), F.lit(0.0)) for s in scores]
    elif average == "macro":
        cols = [F.avg(s) for s in scores]
    elif average == "micro":
        cols = [share] * 3  # every row is predicted once, so the three scores coincide
    elif average == "binary":
        cols = [F.coalesce(F.max(F.when(F.col("class") == positive, F.col(s))), F.lit(0.0)) for s in scores]
    else:
        raise ConfigurationError("unknown average", average=average, known=AVERAGES)
    aggs = [share.alias("accuracy"), *[c.alias(s) for s, c in zip(scores, cols)]]
    return table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)


def classification_metrics(df: DataFrame, label: str, prediction: str, average: str = "weighted", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., accuracy, precision, recall, f1)``; one shuffle of class-sized partial counts."""
    return averaged(per_class(confusion_counts(df, label, prediction, by), by), average, by)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((col(label).cast("double") == col(prediction).cast("double")).cast("int")).alias("accuracy"))


def precision_recall(df: DataFrame, label: str, prediction: str, average: str = "weighted") -> DataFrame:
    return classification_metrics(df, label, prediction, average).select("precision", "recall")


def score_counts(long: DataFrame, group: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives at each distinct score: partial aggregation folds repeated scores before the shuffle."""
    return (
        long.filter(F.col(score).isNotNull())
        .groupBy(*group, F.col(score).alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def grouped_auc(long: DataFrame, group: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Exact tie-averaged area under the curve ``(group..., pos, neg, auc)``; null when a side is empty."""
    counts = score_counts(long, group, score, positive)
    cum = running_totals(counts, group, "score", ["neg"])
    # each positive beats the negatives below it and half of those at its own score
    wins = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2)
    aggs = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(wins).alias("wins")]
    row = cum.groupBy(*group).agg(*aggs) if group else cum.agg(*aggs)
    pairs = F.nullif(F.col("pos").cast("double") * F.col("neg"), F.lit(0.0))
    return row.select(*group, "pos", "neg", ratio(F.col("wins"), pairs).alias("auc"))


def _probabilities(df: DataFrame, probability: str) -> Column:
    t = next(f for f in df.schema.fields if f.name == probability).dataType
    if isinstance(t, T.ArrayType):
        return col(probability)
    if isinstance(t, T.NumericType):
        return F.array(1 - col(probability).cast("double"), col(probability).cast("double"))
    return vector_to_array(col(probability))


def roc_auc(
    df: DataFrame, label: str, probability: str, n_classes: int = 2, strategy: str = "ovr", average: str = "weighted"
) -> DataFrame:
    """One row ``roc_auc``.  Two classes use P(1); more use one-vs-rest or one-vs-one.  Undefined gives 0.5."""
    if strategy not in ("ovr", "ovo") or average not in ("weighted", "macro"):
        raise ConfigurationError("unknown strategy or average", strategy=strategy, average=average)
    y = col(label).cast("int")
    base = df.select(y.alias("y"), _probabilities(df, probability).alias("pr"))
    if n_classes == 2:
        one = grouped_auc(base.select("y", F.get("pr", F.lit(1)).alias("s")), [], "s", F.col("y") == 1)
        return one.select(F.coalesce("auc", F.lit(AUC_FALLBACK)).alias("roc_auc"))
    if strategy == "ovr":
        long = base.select("y", F.posexplode("pr").alias("g", "s"))
        table = grouped_auc(long, ["g"], "s", F.col("y") == F.col("g"))
        weight = F.col("pos").cast("double") if average == "weighted" else F.lit(1.0)
    else:
        # a row of class c takes part in the pairs {c, d}; each pair is scored once from either side
        other = F.filter(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda d: d != F.col("y"))
        long = base.select("y", "pr", F.explode(other).alias("d")).select(
            "y", F.least("y", "d").alias("a"), F.greatest("y", "d").alias("b"),
            F.inline(F.array(
                F.struct(F.least("y", "d").alias("g"), F.get("pr", F.least("y", "d")).alias("s")),
                F.struct(F.greatest("y", "d").alias("g"), F.get("pr", F.greatest("y", "d")).alias("s")),
            )),
        )
        table = grouped_auc(long, ["a", "b", "g"], "s", F.col("y") == F.col("g"))
        weight = (F.col("pos") + F.col("neg")).cast("double") if average == "weighted" else F.lit(1.0)
    any_undefined = F.count_if(F.col("auc").isNull() | F.isnan("auc")) > 0
    value = ratio(F.sum(F.col("auc") * weight), F.sum(weight))
    return table.agg(F.when(any_undefined | value.isNull(), F.lit(AUC_FALLBACK)).otherwise(value).alias("roc_auc"))


def log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row ``log_loss``: mean of -ln P(true), clipped; a label without a probability gives the penalty."""
    p = F.get(_probabilities(df, probability), col(label).cast("int"))
    row = df.agg(
        F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS)))).alias("v"), F.count_if(p.isNull()).alias("bad")
    )
    return row.select(F.when(F.col("bad") > 0, F.lit(LOG_LOSS_PENALTY)).otherwise(F.col("v")).alias("log_loss"))
