"""Deterministic train/test split, folds and class weights.

Rows are ordered by a keyed hash and cut at exact order statistics, so sizes are exact, the result does not depend
on partitioning, and no row is sorted or shuffled: a split is a few aggregate scans plus a projection.  Without key
columns the hash covers all columns; copies of a row then share a side, so give a key when copies are common.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DataValidationError, InsufficientDataError
from ..functions.columns import col, ratio
from ..functions.hashing import hash60, row_keys
from .encode import require_few_levels, sorted_levels
from .order_stats import order_statistics

TEST_SHARE, SEED, FOLDS = 0.2, 42, 3  # fixed values
HASH, MAX_CLASSES = "_hash", 1000
FEW = 16


SPAN = 1 << 60  # hashes are uniform on [0, SPAN)
SIGMAS, GATHER = 7.0, 100_000


def _levels(df: DataFrame, by: str) -> list:
    return sorted_levels(df, [by], MAX_CLASSES)[by]


def _by_level(pairs: list[tuple], by: Column) -> Column:
    """The value of a row's level; a few comparisons, which compile to plain code, or a small map."""
    if 0 < len(pairs) <= FEW:
        out = None
        for v, x in pairs:
            out = F.when(by == F.lit(v), x) if out is None else out.when(by == F.lit(v), x)
        return out
    return F.element_at(F.create_map(*[F.lit(v) if not isinstance(v, Column) else v for kv in pairs for v in kv]), by)


def _intervals(n: int, probs: Sequence[float]) -> list[tuple[int, int]]:
    """Where the order statistics near each probability lie, as disjoint hash ranges."""
    out: list[tuple[int, int]] = []
    for p in sorted(probs):
        half = SIGMAS * math.sqrt(p * (1 - p) / n) + 3.0 / n
        lo, hi = max(0, int((p - half) * SPAN)), min(SPAN, int((p + half) * SPAN))
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def hash_cutoffs(
    df: DataFrame, h: Column, by: str | None, levels: Sequence | None, probs: Sequence[float], ranks: Callable[[int, float], int],
) -> dict:
    """``{level: (n, {p: hash at rank ranks(n, p)})}``, exact.

    The hash is uniform, so the place of each cut is known up to a few standard errors from the level counts alone.
    One aggregation then counts the rows between those ranges and the distinct hashes inside them: about the square
    root of the row count per cut.  Copies of one key fold into one counted hash.
    """
    tagged = df.select(h.alias(HASH), (col(by) if by else F.lit("all")).alias("_by"))
    levels = ["all"] if by is None else list(levels if levels is not None else _levels(df, by))
    counted = {r["_by"]: r["n"] for r in tagged.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counted.get(None):
        raise DataValidationError("rows without a class cannot be stratified", column=by, rows=counted[None])
    counts = {v: counted.get(v, 0) for v in levels}
    live = [v for v in levels if counts[v]]
    out = {v: (counts[v], dict.fromkeys(probs)) for v in levels}
    large = [v for v in live if 2 * SIGMAS * math.sqrt(counts[v]) > GATHER]
    small = [v for v in live if v not in large]
    if small:
        zones = {v: _intervals(counts[v], probs) for v in small}
        arrays = [(v, F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in zones[v]])) for v in small]
        h = F.col(HASH)
        spots = _by_level(arrays, F.col("_by"))
        cells = (
            tagged.filter(F.col("_by").isin(small)).withColumn("_z", spots)
            .select(
                "_by", F.size(F.filter("_z", lambda z: h > z["hi"])).alias("seg"),
                F.when(F.exists("_z", lambda z: h.between(z["lo"], z["hi"])), h).alias("h"),
            )
            .groupBy("_by", "seg", "h").agg(F.count(F.lit(1)).alias("n")).collect()
        )
        for v in small:
            rows = sorted((r for r in cells if r["_by"] == v), key=lambda r: (r["seg"], -1 if r["h"] is None else r["h"]))
            for p in probs:
                want, below = min(max(ranks(counts[v], p), 0), counts[v] - 1), 0
                for r in rows:
                    if below <= want < below + r["n"]:
                        out[v][1][p] = r["h"]
                        break
                    below += r["n"]
    # a table too large for one gathering, or a cut outside its range, goes through the general search
    rest = [v for v in live if any(out[v][1][p] is None for p in probs)]
    if rest:
        series = {str(i): F.when(F.col("_by") == F.lit(v), F.col(HASH)) for i, v in enumerate(rest)}
        found = order_statistics(tagged, series, probs, lambda n, p: [ranks(n, p)])
        for i, v in enumerate(rest):
            out[v] = (counts[v], {p: found[str(i)][1][p][0] for p in probs})
    return out


def train_test_flag(
    df: DataFrame, key: Sequence[str] | str | None = None, stratify: str | None = None,
    test_share: float = TEST_SHARE, seed: int = SEED, output: str = "is_test", levels: Sequence | None = None, hashed: str | None = None,
) -> DataFrame:
    """Adds a boolean column: the ``test_share`` of rows (of each class when stratified) with the lowest hashes.

    ``hashed`` names a column that already holds ``hash60`` of the keys, so that no scan works it out again.
    """
    if not 0 < test_share < 1:
        raise ConfigurationError("test share must lie between 0 and 1", share=test_share)
    keys = row_keys(df, key)

    def size(n: int) -> int:
        return math.floor(test_share * n + 0.5) if stratify else math.ceil(test_share * n - 1e-9)

    h = col(hashed) if hashed else hash60(keys, seed)
    found = hash_cutoffs(df, h, stratify, levels, [test_share], lambda n, p: size(n) - 1)
    cuts = []
    for v, (n, by_p) in found.items():
        if stratify and n < 2:
            raise InsufficientDataError("a class needs at least two rows", column=stratify, value=v)
        cuts.append((v, by_p[test_share] if size(n) > 0 else -1))
    return df.withColumn(output, h <= _by_level(cuts, col(stratify) if stratify else F.lit("all")))


def train_test_split(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    flagged = train_test_flag(df, **kw, output="_is_test")
    return flagged.filter(~F.col("_is_test")).drop("_is_test"), flagged.filter("_is_test").drop("_is_test")


def fold_column(
    df: DataFrame, folds: int = FOLDS, key: Sequence[str] | str | None = None, stratify: str | None = None,
    seed: int = SEED, output: str = "fold", levels: Sequence | None = None, hashed: str | None = None,
) -> DataFrame:
    """Adds an int fold number; fold sizes (per class when stratified) differ by at most one row.  ``hashed``: see ``train_test_flag``."""
    if folds < 2:
        raise ConfigurationError("at least two folds are needed", folds=folds)
    keys = row_keys(df, key)
    probs = [j / folds for j in range(1, folds)]
    first = lambda n, p: -(-round(p * folds) * n // folds)  # noqa: E731 - first rank of the fold
    h = col(hashed) if hashed else hash60(keys, seed)
    found = hash_cutoffs(df, h, stratify, levels, probs, first)
    cuts = []
    for v, (n, by_p) in found.items():
        if stratify is None and n < folds:
            raise InsufficientDataError("fewer rows than folds", rows=n, folds=folds)
        # a fold without rows starts above every hash
        starts = [by_p[p] if n and first(n, p) < n else SPAN for p in probs]
        cuts.append((v, F.array(*[F.lit(int(x)) for x in starts])))
    starts = _by_level(cuts, col(stratify) if stratify else F.lit("all"))
    return df.withColumn(output, sum(((h >= F.get(starts, F.lit(j))).cast("int") for j in range(folds - 1)), F.lit(0)))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights ``(class, n, weight)`` with weight = rows / (classes * class rows)."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select("class", "n", ratio(both["n"], both["k"] * F.col("n")).alias("weight"))


def with_class_weight(df: DataFrame, target: str, output: str = "weight") -> DataFrame:
    require_few_levels(df, [target], MAX_CLASSES)
    rows = class_weights(df, target).collect()
    return df.withColumn(output, _by_level([(r["class"], float(r["weight"])) for r in rows], col(target)))
