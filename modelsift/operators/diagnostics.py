"""The tables behind the diagnostic plots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DiagnosticsError
from ..functions.columns import agg_row, col, field_of, is_numeric, number, numeric_columns, pearson, ratio
from .encode import label_encode
from .metrics import confusion_counts, score_counts
from .order_stats import quantiles
from .running import running_totals, sorted_quantiles

TOP = 15  # fixed value: rows of a ranking plot
MAX_BINS = 100


def correlation_matrix(df: DataFrame, target: str, top: int = TOP) -> DataFrame:
    """Long matrix ``(feature_a, feature_b, r)`` of the columns most (signed) correlated with the target.

    The choice uses pairwise-complete values; the matrix itself is null wherever a column holds a null.
    """
    if not is_numeric(field_of(df, target)):
        df, _ = label_encode(df.withColumn(target, F.coalesce(col(target).cast("string"), F.lit("nan"))), target)
    nums = numeric_columns(df)
    y = number(df, target)
    seen = agg_row(df, {c: pearson(number(df, c), y) for c in nums})
    kept = [c for c in sorted((c for c in nums if seen[c] is not None), key=lambda c: (-seen[c], nums.index(c)))][:top]
    if not kept:
        raise DiagnosticsError("no numeric column correlates with the target", column=target)
    nulls = agg_row(df, {c: F.count_if(number(df, c).isNull()) for c in kept})
    whole = [c for c in kept if not nulls[c]]
    r: dict = {}
    if len(whole) > 1:
        vec = VectorAssembler(inputCols=[f"c{i}" for i in range(len(whole))], outputCol="v").transform(
            df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(whole)])
        )
        m = Correlation.corr(vec, "v").first()[0].toArray()  # top x top
        r = {(a, b): float(m[i, j]) for i, a in enumerate(whole) for j, b in enumerate(whole)}
    elif whole:
        r = {(whole[0], whole[0]): 1.0}
    rows = [(a, b, r.get((a, b))) for a in kept for b in kept]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def histogram(df: DataFrame, columns: Sequence[str], max_bins: int = MAX_BINS) -> DataFrame:
    """``(feature, bin, lower, upper, n, density)``.

    Bin width is the smaller of the Freedman-Diaconis and Sturges widths; the density is a Gaussian kernel sum over
    bin centres with Scott's bandwidth.
    """
    q = quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.75])
    exprs = {}
    for c in columns:
        v = number(df, c)
        exprs[f"{c}|n"], exprs[f"{c}|lo"], exprs[f"{c}|hi"], exprs[f"{c}|sd"] = F.count(v), F.min(v), F.max(v), F.stddev_samp(v)
    s = agg_row(df, exprs)
    items = []
    for c in columns:
        n, lo, hi = s[f"{c}|n"], s[f"{c}|lo"], s[f"{c}|hi"]
        if not n:
            continue
        bins = 1
        if hi > lo:
            sturges = (hi - lo) / (math.log2(n) + 1)
            fd = 2 * (q[c][1] - q[c][0]) / n ** (1 / 3)
            bins = max(1, min(max_bins, math.ceil((hi - lo) / (min(fd, sturges) if fd > 0 else sturges))))
        width = (hi - lo) / bins if hi > lo else 1.0
        band = (s[f"{c}|sd"] or 0.0) * n ** -0.2
        v = number(df, c)
        b = F.least(F.floor((v - lo) * bins / F.lit((hi - lo) if hi > lo else 1.0)), F.lit(bins - 1)).cast("int")
        items.append((c, F.struct(F.lit(c).alias("feature"), b.alias("bin")), (c, bins, float(lo), width, n, band)))
    long = df.select(F.inline(F.array(*[i[1] for i in items]))).filter("bin is not null")
    counts = long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    plan = df.sparkSession.createDataFrame(
        [i[2] for i in items], "feature string, bins int, lo double, width double, total bigint, band double"
    ).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    table = plan.join(counts, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    centre = lambda b: F.col("lo") + (b + 0.5) * F.col("width")
    # at most max_bins rows per feature
    packed = F.collect_list(F.struct("bin", "n")).over(Window.partitionBy("feature"))
    kernel = F.aggregate(
        F.col("_all"), F.lit(0.0),
        lambda a, x: a + x["n"] * F.exp(-F.pow((centre(F.col("bin")) - centre(x["bin"])) / F.col("band"), F.lit(2)) / 2),
    )
    return table.withColumn("_all", packed).select(
        "feature", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"), "n",
        F.when(F.col("band") > 0, kernel / (F.col("total") * F.col("band") * math.sqrt(2 * math.pi))).alias("density"),
    )


def _cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    counts = score_counts(df.select(col(label).alias("_y"), col(score).cast("double").alias("_s")), [], "_s", F.col("_y").cast("int") == 1)
    down = counts.select((-F.col("score")).alias("order"), "pos", "neg")
    return running_totals(down, [], "order", ["pos", "neg"]).withColumn("threshold", -F.col("order"))


def _side_totals(df: DataFrame, label: str, score: str):
    y = col(label).cast("int") == 1
    seen = col(score).isNotNull()
    return df.agg(F.struct(F.count_if(y & seen).alias("pos"), F.count_if(~y & seen).alias("neg"))).scalar()


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, with the (0, 0) start at an infinite threshold."""
    t = _side_totals(df, label, score)
    cum = _cumulative(df, label, score)
    points = cum.select("threshold", ratio(F.col("cum_neg"), t["neg"]).alias("fpr"), ratio(F.col("cum_pos"), t["pos"]).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return points.unionAll(start)


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score, with the closing point (recall 0, precision 1) at an infinite threshold."""
    t = _side_totals(df, label, score)
    cum = _cumulative(df, label, score)
    points = cum.select(
        "threshold", ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), t["pos"]).alias("recall"),
    )
    return points.unionAll(df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], points.schema))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the sum of precision times the recall gained at each distinct score."""
    cum = _cumulative(df, label, score)
    gain = F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg(ratio(F.sum(gain), F.sum("pos")).alias("average_precision"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence | None = None) -> DataFrame:
    """``(true_class, predicted_class, n)`` with zero cells; classes default to the codes seen on either side."""
    counts = confusion_counts(df, label, prediction)
    codes = counts.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("y", "p"))))).alias("codes"))
    cells = codes.select(F.explode("codes").alias("y"), "codes").select("y", F.explode("codes").alias("p"))
    out = cells.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))
    if classes is None:
        return out.select(F.col("y").alias("true_class"), F.col("p").alias("predicted_class"), "n")
    names = F.lit([str(c) for c in classes])
    return out.select(
        F.get(names, F.col("y").cast("int")).alias("true_class"), F.get(names, F.col("p").cast("int")).alias("predicted_class"), "n"
    )


def predicted_vs_actual(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.select(col(label).cast("double").alias("actual"), col(prediction).cast("double").alias("predicted"))


def value_range(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """End points of the ideal line: ``(low, high)``."""
    return df.agg(
        F.least(F.min(col(label)), F.min(col(prediction))).alias("low"), F.greatest(F.max(col(label)), F.max(col(prediction))).alias("high")
    )


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.select(col(prediction).cast("double").alias("predicted"), (col(label) - col(prediction)).cast("double").alias("residual"))


def filliben(m: int) -> list[float]:
    """Median plotting positions of ``m`` ordered values."""
    ends = 0.5 ** (1 / m)
    return [1 - ends, *[(i - 0.3175) / (m + 0.365) for i in range(2, m)], ends]


def qq_table(df: DataFrame, label: str, prediction: str, points: int = 99) -> DataFrame:
    """``(theoretical, sample, fitted, slope, intercept, r)`` at fixed plotting positions of the residuals."""
    probs = filliben(points)
    r = (col(label) - col(prediction)).cast("double")
    values = sorted_quantiles(df, r, probs)
    normal = NormalDist()
    rows = [(normal.inv_cdf(p), v) for p, v in zip(probs, values)]
    table = df.sparkSession.createDataFrame(rows, "theoretical double, sample double")
    fit = table.agg(F.struct(
        F.regr_slope("sample", "theoretical").alias("a"), F.regr_intercept("sample", "theoretical").alias("b"),
        pearson(F.col("sample"), F.col("theoretical")).alias("r"),
    )).scalar()
    return table.select(
        "theoretical", "sample", (fit["a"] * F.col("theoretical") + fit["b"]).alias("fitted"),
        fit["a"].alias("slope"), fit["b"].alias("intercept"), fit["r"].alias("r"),
    )


def top_importances(table: DataFrame, top: int = TOP) -> DataFrame:
    """``(feature, importance)`` rows, largest first."""
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def top_coefficients(table: DataFrame, top: int = TOP, odds_ratio: bool = False) -> DataFrame:
    """``(feature, value)``: the largest by absolute value, shown in value order."""
    value = F.exp("coefficient") if odds_ratio else F.col("coefficient")
    kept = table.select("feature", value.alias("value")).orderBy(F.desc(F.abs(F.col("value"))), "feature").limit(top)
    return kept.orderBy("value")
