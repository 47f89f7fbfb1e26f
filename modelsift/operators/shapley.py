"""Shapley values of trees and forests, path-dependent: a feature outside the coalition follows both branches by their cover.

A leaf is a box: per feature on its path an interval, and the share ``z`` of the rows that the splits on that feature keep.  With
``o`` telling whether x lies in the interval, feature i of a path of m features is worth, in that leaf,

    value * (o_i - z_i) * sum over coalitions S of the others of |S|! (m - 1 - |S|)! / m! * prod_{S} o_j * prod_{not S} z_j
  = value * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (o_j t + z_j (1 - t)),

and Gauss-Legendre points integrate that polynomial of degree m - 1 exactly.  So no coalition is listed, and all rows and leaves of an
Arrow batch go through the same few array products.  Leaves add up, so they are sent to the tasks in pieces.

What a leaf adds depends on x through the m values ``o`` alone.  Where all 2^m of them fit in memory (``CELLS``), they are worked out
once, and a row only looks up its place between the thresholds of each feature; rows between the same thresholds are told once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import settled
from .contraction import ancestors
from .growth import NODES_AT_ONCE, outcome

CELLS = 2_000_000  # numbers of one array product


def leaf_boxes(nodes: DataFrame, classes: int) -> DataFrame:
    """``(tree, id, says, share, path)``: the outcome of each leaf, the share of rows in it, and its intervals ``(feature, low, high, z)``."""
    steps = nodes.where("left < 0").select("tree", F.col("id").alias("leaf"), F.explode(ancestors(F.col("id"), F.col("depth"))).alias("id"))
    cover = nodes.select("tree", "id", "weight")
    above = nodes.select("tree", F.col("id").alias("parent"), "feature", "threshold", F.col("weight").alias("whole"))
    steps = steps.where("id > 1").withColumn("parent", F.floor(F.col("id") / 2).cast("int")).join(cover, ["tree", "id"]).join(above, ["tree", "parent"])
    right = F.col("id") % 2 == 1
    spans = steps.groupBy("tree", "leaf", "feature").agg(
        F.coalesce(F.max(F.when(right, F.col("threshold"))), F.lit(float("-inf"))).alias("low"),
        F.coalesce(F.min(F.when(~right, F.col("threshold"))), F.lit(float("inf"))).alias("high"),
        F.product(F.col("weight") / F.col("whole")).alias("z"),
    )
    paths = spans.groupBy("tree", F.col("leaf").alias("id")).agg(F.sort_array(F.collect_list(F.struct("feature", "low", "high", "z"))).alias("path"))
    leaves = nodes.where("left < 0").select("tree", "id", outcome(classes).alias("says"))
    empty = F.array().cast("array<struct<feature:int,low:double,high:double,z:double>>")
    out = leaves.join(paths, ["tree", "id"], "left").withColumn("path", F.coalesce("path", empty))
    return out.withColumn("share", F.aggregate("path", F.lit(1.0), lambda a, p: a * p["z"]))


def _by_length(rows: pa.Table, trees: int) -> list[tuple[np.ndarray, ...]]:
    """Leaves grouped by the length of their path: features, lows, highs, shares (leaves x m) and outcomes (leaves x classes)."""
    found: dict[int, list] = {}
    for path, says in zip(rows["path"].to_pylist(), rows["says"].to_pylist()):
        if path:
            found.setdefault(len(path), []).append(([p["feature"] for p in path], [p["low"] for p in path], [p["high"] for p in path], [p["z"] for p in path], says))
    return [(np.array([x[0] for x in v]), *[np.array([x[i] for x in v], float) for i in (1, 2, 3)], np.array([x[4] for x in v], float) / trees) for v in found.values()]


def _inside(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return ~(v <= low) & ((v <= high) | (high == np.inf))  # a missing value goes right


def _gauss(m: int) -> tuple[np.ndarray, np.ndarray]:
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    return (points + 1) / 2, weights / 2


def _listed(width: int, leaves: int, m: int) -> bool:
    """Whether all that leaves with paths of ``m`` features can add is worked out beforehand."""
    return m < 20 and max(width, m * ((m + 1) // 2)) * leaves << m <= CELLS


def worth(features: np.ndarray, low: np.ndarray, high: np.ndarray, z: np.ndarray, width: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per feature its thresholds and the bits that each place between them sets in the pattern of each leaf, and what each pattern
    of each leaf is worth to each feature (features x leaves x patterns)."""
    leaves, m = features.shape
    t, w = _gauss(m)
    on = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)   # patterns x m
    base = z[:, None, :, None] * (1 - t) + on[None, :, :, None] * t
    rest = np.prod(base, axis=2, keepdims=True) / base
    part = (rest @ w) * (on - z[:, None, :])                             # leaves x patterns x m
    value, bits = np.zeros((width, leaves, 1 << m)), {}
    for j in range(m):
        value[features[:, j], np.arange(leaves), :] = part[:, :, j]
    for f in np.unique(features).tolist():
        leaf, j = np.nonzero(features == f)
        edges = np.concatenate([low[leaf, j], high[leaf, j]])
        cuts = np.unique(edges[np.isfinite(edges)])
        told = np.zeros((len(cuts) + 1, leaves), np.int64)
        told[:, leaf] = _inside(np.append(cuts, np.inf)[:, None], low[leaf, j], high[leaf, j]).astype(np.int64) << j
        bits[f] = cuts, told
    return bits, value


def _looked_up(x: np.ndarray, bits: dict[int, tuple[np.ndarray, np.ndarray]], value: np.ndarray, says: np.ndarray, total: np.ndarray) -> None:
    """Adds the contributions of listed leaves to ``total``."""
    width, leaves, patterns = value.shape
    places = np.stack([np.searchsorted(cuts, x[:, f], side="left") for f, (cuts, _) in bits.items()], 1)  # a missing value sorts last
    key = np.zeros(len(x), np.int64)
    for i, (cuts, _) in enumerate(bits.values()):
        if len(x) * (len(cuts) + 1) * (int(key.max(initial=0)) + 1) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * (len(cuts) + 1) + places[:, i]
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    places, found = places[one], np.zeros((len(one), *total.shape[1:]))
    some = max(1, CELLS // leaves)
    for a in range(0, len(places), some):
        code = np.arange(leaves) * patterns + sum(told[places[a:a + some, i]] for i, (_, told) in enumerate(bits.values()))
        for c in range(total.shape[1]):
            for f in bits:
                found[a:a + some, c, f] = (value[f] * says[:, c, None]).ravel()[code].sum(1)
    total += found[back]


def contributions(x: np.ndarray, groups: Sequence[tuple[np.ndarray, ...]], out: int, listed: dict | None = None) -> np.ndarray:
    """Rows x (classes x features) contributions of the leaves in ``groups``; ``listed`` keeps what is worked out beforehand."""
    n, width = x.shape
    total, listed = np.zeros((n, out, width)), {} if listed is None else listed
    for g, (features, low, high, z, says) in enumerate(groups):
        m = features.shape[1]
        if _listed(width, len(features), m):
            if g not in listed:
                listed[g] = worth(features, low, high, z, width)
            _looked_up(x, *listed[g], says, total)
            continue
        t, w = _gauss(m)
        some = max(1, CELLS // (m * len(t) * len(features)))
        for a in range(0, n, some):
            v = x[a:a + some][:, features]                              # rows x leaves x m
            inside = _inside(v, low, high)
            base = z[None, :, :, None] * (1 - t) + inside[..., None] * t
            rest = np.prod(base, axis=2, keepdims=True) / base          # the product over the others
            part = (rest @ w) * (inside - z)
            rows = np.repeat(np.arange(a, a + len(v)), features.size)
            for c in range(out):
                np.add.at(total[:, c, :], (rows, np.tile(features.ravel(), len(v))), (part * says[None, :, c, None]).ravel())
    return total.reshape(n, -1)


def _adder(groups: list[tuple[np.ndarray, ...]], out: int):
    listed: dict = {}

    def add(x: pa.Array, before: pa.Array) -> pa.Array:
        n = len(x)
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        sums = before.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) + contributions(rows, groups, out, listed)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))

    return F.arrow_udf(add, "array<double>")


def shapley_values(df: DataFrame, features: str, nodes: DataFrame, trees: int, classes: int, width: int, output: str = "shapley") -> tuple[DataFrame, list[float]]:
    """Adds ``output``: for each class (or once, for a mean) one array of ``width`` contributions, and returns the base values.

    Base value plus contributions is the prediction of the ensemble (class shares averaged over trees, or the mean of the trees).
    ``features`` is an array column.  A row without features (null) has no contributions.
    """
    out = classes or 1
    boxes = settled(leaf_boxes(nodes, classes), "boxes")
    base = boxes.select(F.posexplode("says").alias("c", "v"), "share").groupBy("c").agg((F.sum(F.col("v") * F.col("share")) / trees).alias("v")).collect()
    parts = max(1, math.ceil(boxes.count() / (NODES_AT_ONCE / 10)))
    usable = F.col(features).isNotNull()
    flat = F.array_repeat(F.lit(0.0), out * width)
    whole = df.withColumn("_row_values", F.when(usable, F.col(features)).otherwise(F.array_repeat(F.lit(0.0), width))).withColumn("_flat", flat)
    for i in range(parts):
        part = boxes if parts == 1 else boxes.where(F.pmod(F.hash("tree", "id"), F.lit(parts)) == i)
        whole = whole.withColumn("_flat", _adder(_by_length(part.select("path", "says").toArrow(), trees), out)("_row_values", "_flat"))
    split = F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda c: F.slice("_flat", c * width + 1, F.lit(width)))
    found = {r["c"]: r["v"] for r in base}
    return whole.withColumn(output, F.when(usable, split)).drop("_row_values", "_flat"), [found.get(c, 0.0) for c in range(out)]


def shapley_importance(df: DataFrame, names: Sequence[str], shapley: str = "shapley") -> DataFrame:
    """``(feature, importance)``: mean size of the contributions over all rows, averaged over the classes."""
    each = df.where(F.col(shapley).isNotNull()).select(F.explode(shapley).alias("v")).select(F.posexplode("v").alias("i", "v"))
    sizes = each.groupBy("i").agg(F.avg(F.abs("v")).alias("importance"))
    return sizes.select(F.get(F.lit(list(names)), F.col("i")).alias("feature"), "importance")
