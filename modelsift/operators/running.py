"""Running totals over a global order without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 10_000


def bucket_edges(df: DataFrame, order: str, buckets: int) -> list[float]:
    """Quantile cut points of the order column (a bounded sketch)."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order, probs, max(10_000, 4 * buckets)).alias("q")).first()["q"] or []
    return [-float("inf"), *sorted(set(float(c) for c in cuts)), float("inf")]


def running_totals(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``cum_<s>`` for each of ``sums``: the inclusive total in ``order`` within ``group``.

    ``df`` must already hold one row per (group, order value), so a heavily repeated value is a single row.
    The order column is cut into quantile buckets; each bucket is accumulated by its own task and shifted by the
    totals of the buckets before it.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2, min(buckets, MAX_BUCKETS))
    cut = Bucketizer(splits=bucket_edges(df, order, buckets), inputCol=order, outputCol="_bucket", handleInvalid="keep")
    tagged = cut.transform(df)
    keys = list(group)
    totals = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_BUCKETS rows per group, so this frame is small whatever the input
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(s).over(within).alias(f"_c_{s}") for s in sums])
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *[c for c in df.columns], *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    )


def sorted_quantiles(df: DataFrame, value: Column, probs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated exact quantiles at many probabilities of one column, read off its running counts."""
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    n = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not n:
        return [None] * len(probs)
    spots = [p * (n - 1) for p in probs]
    ranks = sorted({r for h in spots for r in (math.floor(h), math.ceil(h))})
    cum = running_totals(counts, [], "v", ["n"])
    mine = F.filter(F.lit(ranks), lambda r: (r >= F.col("cum_n") - F.col("n")) & (r < F.col("cum_n")))
    at = {r["rank"]: r["v"] for r in cum.select("v", F.explode(mine).alias("rank")).collect()}  # one row per wanted rank
    out = []
    for h in spots:
        a, b = at[math.floor(h)], at[math.ceil(h)]
        out.append(float(a + (b - a) * (h - math.floor(h))))
    return out
