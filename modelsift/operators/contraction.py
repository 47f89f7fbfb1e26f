"""Cost-complexity pruning of grown trees as frames: a bottom-up contraction of all trees and settings together.

Trees are cut into bands of ``BAND`` levels.  A step takes one band, deals its subtrees out by their top node, and lets costs rise
inside each: children add theirs under a node, and a node that costs no more as a leaf takes its subtree in.  The top nodes carry
their costs into the band above.  Leaves then find the topmost node that took them in through the ids of their ancestors, which a
heap id tells without walking.  Trees of up to ``WHOLE`` nodes are one band: a task gets a tree and a setting, and does both steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import settled

WHOLE = 1_000_000  # nodes of a tree that one task holds
BAND = 8  # levels contracted in one step; a subtree of a band has at most 2 ** (BAND + 1) nodes


@dataclass(frozen=True)
class Cut:
    """What is cut off the grown tree ``tree``: nodes under ``max_depth``, under nodes of fewer than ``min_split`` rows, and subtrees that
    do not pay ``ccp_alpha`` per leaf."""

    tree: int
    max_depth: int | None = None
    min_split: int = 2
    ccp_alpha: float = 0.0


def ancestors(node: Column, depth: Column) -> Column:
    """The ids from a node up to the root, itself first."""
    return F.transform(F.sequence(F.lit(0), depth), lambda j: F.floor(node / F.pow(F.lit(2), j)).cast("int"))


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of whole subtrees; a row with a cost already is the top of a subtree of the band below."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    setting, tree, node, depth = (rows[c].to_numpy().astype(np.int64) for c in ("setting", "tree", "id", "depth"))
    own, stopped, cost = (rows[c].to_numpy(zero_copy_only=False) for c in ("own", "stopped", "cost"))
    key, fresh = setting << 48 | tree << 32 | node, rows["cost"].is_null().to_numpy()
    leaf, cost = _contracted(setting, tree, node, depth, own, stopped, cost, key)
    out = [pa.array(v.astype(np.int32)) for v in (setting, tree, node, depth)] + [pa.array(leaf), pa.array(cost)]
    yield pa.record_batch([v.filter(pa.array(fresh)) for v in out], names=["setting", "tree", "id", "depth", "leaf", "cost"])


def _contracted(setting, tree, node, depth, own, stopped, cost, key) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are leaves, and the costs of their subtrees; a node whose cost is not NaN has it already."""
    order = np.argsort(key)
    under, leaf, cost = np.zeros(len(key)), stopped.astype(bool).copy(), cost.astype(float).copy()
    for d in range(depth.max(), depth.min() - 1, -1):
        at = np.flatnonzero(depth == d)
        mine = at[np.isnan(cost[at])]
        leaf[mine] |= own[mine] <= under[mine] + 1e-15
        cost[mine] = np.where(leaf[mine], own[mine], under[mine])
        above = setting[at] << 48 | tree[at] << 32 | node[at] >> 1
        spot = np.minimum(np.searchsorted(key, above, sorter=order), len(key) - 1)
        found = key[order[spot]] == above
        np.add.at(under, order[spot][found], cost[at][found])
    return leaf, cost


def _whole(group: pa.Table) -> pa.Table:
    """``ends`` of one tree and setting, from all its nodes."""
    setting, tree, node, depth = (group[c].to_numpy().astype(np.int64) for c in ("setting", "tree", "id", "depth"))
    stops = group["stopped"].to_numpy(zero_copy_only=False).astype(bool)
    if group["ccp_alpha"][0].as_py() > 0:
        stops, _ = _contracted(setting, tree, node, depth, group["own"].to_numpy(zero_copy_only=False), stops, np.full(len(node), np.nan), setting << 48 | tree << 32 | node)
    tops = np.sort(node[stops])
    grown = group["grown"].to_numpy(zero_copy_only=False).astype(bool)
    leaf, deep = node[grown], depth[grown]
    end = np.zeros(len(leaf), np.int64)
    for d in range(int(deep.max(initial=-1)) + 1):  # from the root down: the first that took the leaf in
        above = leaf >> np.maximum(deep - d, 0)
        spot = np.minimum(np.searchsorted(tops, above), len(tops) - 1)
        end = np.where((end == 0) & (deep >= d) & (tops[spot] == above), above, end)
    out = [np.full(len(leaf), setting[0]), np.full(len(leaf), tree[0]), leaf, end]
    return pa.table({c: pa.array(v.astype(np.int32)) for c, v in zip(("setting", "tree", "leaf", "end"), out)})


def ends(nodes: DataFrame, cuts: Sequence[Cut]) -> DataFrame:
    """``(setting, tree, leaf, end)``: for each grown leaf the node that is its leaf under setting ``i`` of ``cuts``.

    The result under a cost is the smallest tree of least cost: a tie takes the subtree in.
    """
    spark = nodes.sparkSession
    rules = spark.createDataFrame([(i, *astuple(c)) for i, c in enumerate(cuts)], "setting int, tree int, max_depth int, min_split int, ccp_alpha double")
    total = nodes.where("id = 1").select("tree", F.col("weight").alias("total"))
    every = nodes.join(F.broadcast(rules), "tree").join(F.broadcast(total), "tree")  # one row per setting, one per tree
    every = every.select(
        "setting", "tree", "id", "depth", "ccp_alpha", (F.col("impurity") * F.col("weight") / F.col("total") + F.col("ccp_alpha")).alias("own"),
        ((F.col("left") < 0) | F.coalesce(F.col("depth") >= F.col("max_depth"), F.lit(False)) | (F.col("n") < F.col("min_split"))).alias("stopped"),
        (F.col("left") < 0).alias("grown"),
    )
    if (nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0) <= WHOLE:
        return every.groupBy("setting", "tree").applyInArrow(_whole, "setting int, tree int, leaf int, end int")
    every = settled(every, "costs")
    stops = every.where("stopped").select("setting", "tree", "id")
    paying = every.where("ccp_alpha > 0")
    deepest = paying.agg(F.max("depth")).first()[0]
    if deepest is not None:
        tops = None
        for band in range(deepest // BAND, -1, -1):
            low = band * BAND
            rows = paying.where(F.col("depth").between(low, low + BAND - 1)).select("setting", "tree", "id", "depth", "own", "stopped", F.lit(None).cast("double").alias("cost"))
            if tops is not None:
                rows = rows.unionAll(tops.select("setting", "tree", "id", "depth", F.lit(0.0), F.lit(True), "cost"))
            top = F.floor(F.col("id") / F.pow(F.lit(2), F.col("depth") - low)).cast("int")
            risen = settled(rows.repartition("setting", "tree", top).mapInArrow(_rise, "setting int, tree int, id int, depth int, leaf boolean, cost double"), "band")
            tops = risen.where(F.col("depth") == low)
            stops = stops.unionAll(risen.where("leaf").select("setting", "tree", "id"))
        stops = stops.distinct()
    leaves = nodes.where("left < 0").join(F.broadcast(rules.select("setting", "tree")), "tree")
    up = leaves.select("setting", "tree", F.col("id").alias("leaf"), F.explode(ancestors(F.col("id"), F.col("depth"))).alias("id"))
    return up.join(stops, ["setting", "tree", "id"], "left_semi").groupBy("setting", "tree", "leaf").agg(F.min("id").alias("end"))


def pruned(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The node table of one setting, from its rows of ``ends``; nodes that took subtrees in are leaves."""
    tops = found.select("tree", F.col("end").alias("id")).distinct()
    up = tops.select("tree", "id", F.explode(ancestors(F.col("id"), F.floor(F.log2(F.col("id"))).cast("int"))).alias("above"))
    kept = up.groupBy("tree", F.col("above").alias("id")).agg(F.max(F.col("above") == F.col("id")).alias("ends"))
    joined = nodes.join(kept, ["tree", "id"])
    shut = {"feature": F.lit(None), "cut_bin": F.lit(None), "threshold": F.lit(None), "left": F.lit(-1), "right": F.lit(-1)}
    return joined.select(*[F.when(F.col("ends"), v).otherwise(F.col(c)).cast(nodes.schema[c].dataType).alias(c) if (v := shut.get(c)) is not None else F.col(c) for c in nodes.columns])
