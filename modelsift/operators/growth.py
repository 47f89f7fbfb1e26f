"""Histogram growth of decision trees and forests, level by level, over binned rows.

Features are cut into at most 256 bins once.  A level is one pass over the rows: tasks count rows and label sums per ``(tree, node,
feature, bin)``, Spark adds them, running sums over the bins of a feature give the gain of every cut, and the best cut of a node is
one row of a table.  All trees of a call grow together, so a forest, or all settings of a search, costs as many passes as its deepest
tree.  Bag weights are a function of the row and the tree, so they lie inside the histograms and tell the out-of-bag votes later.

A node of up to ``SMALL`` rows leaves the passes: its rows are dealt out by ``(tree, node)`` once, and the task that gets them grows
the subtree to its leaves by the same rules.  So passes follow the logarithm of the rows, not the depth of the trees.

Rows of equal bins are one cell: they take every cut together, so only their number and label sums count.  Without bags the cells are
made once for all trees; a bag weighs rows anew in every tree, so there the rows of a task are added up as they are dealt out.  Where
the cells of all rows are few enough for one task, it grows a whole tree from them, whatever the number of rows.

Node ids are those of a heap: the root is 1, the children of i are 2 i and 2 i + 1.  The node table is a Spark table.  Tasks get the
cuts made so far and walk their rows down to the level in hand; when those pass ``NODES_AT_ONCE``, the places reached are written and
the next cuts start from there, so driver and tasks never hold more than that many nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash60
from ..functions.scratch import scratch_path, settled

NODES_AT_ONCE = 1_000_000  # nodes that the driver and a task hold at once; larger tables go in pieces
SMALL = 100_000            # rows of the bag up to which one task grows the whole subtree of a node
VALUES = 20                # cells times the features looked at, for each of SMALL, up to which one task grows a whole tree
CELLS_AT_ONCE = 500_000    # sums that a task holds before it passes them on
ROWS_AT_ONCE = 200_000     # rows that a task adds up at once
DEEPEST = 30               # ids of deeper nodes would not fit 32 bits
BINS = 64
PURE = 1e-12               # an impurity up to here counts as zero
PRIME = 2_147_483_647      # fixed value: 2^31 - 1
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])  # fixed values: cumulative Poisson(1) probabilities


@dataclass(frozen=True)
class TreeSpec:
    """How one tree grows; ``tries`` features are looked at per node (0: all), ``bag`` draws Poisson(1) row weights."""

    min_leaf: int = 1
    min_split: int = 2
    max_depth: int = DEEPEST
    criterion: str = "gini"
    tries: int = 0
    bag: bool = False
    seed: int = 42


# --- keyed draws


def _factors(seed: int, tree: int) -> tuple[int, int]:
    h = hashlib.md5(f"{seed}|{tree}".encode()).hexdigest()
    return 1 + int(h[:15], 16) % (PRIME - 1), int(h[15:30], 16) % PRIME


def bag_weight(h: Column, tree: int, seed: int) -> Column:
    """Poisson(1) multiplicity of a row, given its 60-bit hash, in one tree's bag; any engine can repeat it."""
    a, b = _factors(seed, tree)
    u = F.pmod(F.pmod(h, F.lit(PRIME)) * a + b, F.lit(PRIME)) / float(PRIME)
    w = F.lit(0)
    for p in POISSON:
        w = w + (u >= float(p)).cast("int")
    return w


def bag_weights(h: np.ndarray, specs: Sequence[TreeSpec], start: int = 0) -> np.ndarray:
    """``bag_weight`` for rows x trees; the first of ``specs`` is that of tree ``start``."""
    out = np.ones((len(h), len(specs)), np.int64, order="F")
    h = h % PRIME
    for t, s in enumerate(specs):
        if s.bag:
            a, b = _factors(s.seed, start + t)
            out[:, t] = np.searchsorted(POISSON, (h * a + b) % PRIME / float(PRIME), side="right")
    return out


def tried(trees: np.ndarray, nodes: np.ndarray, seeds: np.ndarray, tries: int, features: int) -> np.ndarray:
    """The ``tries`` features a node looks at: those with the smallest keyed hash, in ascending order."""
    with np.errstate(over="ignore"):
        key = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ trees.astype(np.uint64) << np.uint64(32) ^ nodes.astype(np.uint64)
        z = key[:, None] + (np.arange(features, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the finalizer of splitmix64
            z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.sort(np.argsort(z, axis=1, kind="stable")[:, :tries], axis=1)


# --- bins


def _distinct(width: int, most: int):
    """Distinct values per feature of a task, or a mark that there are more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0) for _ in range(width)]
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for i in range(width):
                if len(seen[i]) <= most:
                    seen[i] = np.unique(np.concatenate([seen[i], x[:, i][~np.isnan(x[:, i])]]))[: most + 1]
        f = np.repeat(np.arange(width, dtype=np.int32), [len(v) for v in seen])
        yield pa.record_batch([pa.array(f), pa.array(np.concatenate(seen) if width else np.empty(0))], names=["feature", "value"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def bin_cuts(frame: DataFrame, features: str, bins: int = BINS) -> list[list[float]]:
    """Ascending cuts per feature; a value belongs to the bin numbered by the cuts below it, so ``x <= cut`` is the left side.

    A feature of at most ``bins`` distinct values is cut at each of them, another one at approximate quantiles of all rows.
    """
    first = frame.select(features).head()
    if first is None:
        return []
    width = len(first[0])
    arrays = frame.select(vector_to_array(F.col(features)).alias("x"))
    few = arrays.mapInArrow(_distinct(width, bins), "feature int, value double").distinct()
    counted = few.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("feature"))).where(F.col("n") <= bins)
    cuts: dict[int, list[float]] = {r["feature"]: sorted(r["v"]) for r in counted.groupBy("feature").agg(F.collect_list("value").alias("v")).collect()}
    many = [i for i in range(width) if i not in cuts]
    if many:
        shares = [k / bins for k in range(1, bins)]
        long = arrays.select(F.posexplode("x").alias("feature", "value")).where(F.col("feature").isin(many) & ~F.isnan("value"))
        for r in long.groupBy("feature").agg(F.percentile_approx("value", shares, 10_000).alias("v"), F.max("value").alias("top")).collect():
            cuts[r["feature"]] = sorted(set(r["v"]) | {r["top"]})
    return [cuts.get(i, [])[:-1] for i in range(width)]  # the largest value cuts nothing off


def _binned(cuts: list[list[float]]):
    cuts = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), len(cuts))
            bins = np.empty(x.shape, np.uint8)
            for i, c in enumerate(cuts):
                bins[:, i] = np.searchsorted(c, x[:, i], side="left")
            yield pa.record_batch([batch.column(0), batch.column(1), _packed(bins), _packed(bins[:, :0])], names=["label", "h", "bins", "at"])

    return run


STATE = "label double, h bigint, bins binary, at binary"


def distinct_rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of integers, and for every row the number of its distinct one."""
    codes = np.ascontiguousarray(codes)
    n, size = len(codes), codes.shape[1] * codes.itemsize
    if size <= 8:  # one number tells a row
        flat = np.zeros((n, 8), np.uint8)
        flat[:, :size] = codes.view(np.uint8).reshape(n, size)
        key = flat.view(np.uint64).ravel()
    else:
        key = codes.view(np.dtype((np.void, size))).ravel()
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    return first, kind.ravel()


def _packed(rows: np.ndarray) -> pa.Array:
    """A row of bytes each as binary values of equal length."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``ROWS_AT_ONCE`` rows; rows that carry places with them stay in their batches."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if len(batch.column("at")[0].as_py()):
            yield batch
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cells(width: int, classes: int):
    """Number and label sums of the rows of equal bins, for trees that weigh all rows the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            bins, label = _bins(batch, width), batch.column("label").to_numpy(zero_copy_only=False)
            one, kind = distinct_rows(bins)
            columns = [np.bincount(kind, minlength=len(one)).astype(float), *[np.bincount(kind, s, len(one)) for s in _sums(label, np.ones(len(label)), classes)]]
            yield pa.record_batch([_packed(bins[one]), *[pa.array(c) for c in columns]], names=["bins", "n", *[f"s{i}" for i in range(classes or 3)]])

    return run


STUCK, FEW, MANY = 0, 1, 2  # what comes of a node: a leaf, a subtree of one task, a cut of the next pass
CODES = 4                   # a place is the id of a node times this, plus what comes of it


def _bins(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, width)


def _read(batch: pa.RecordBatch, width: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bins and places (``first`` until places are written) of a batch, and whether places are written."""
    told = b"".join(batch["at"].to_pylist())
    at = np.frombuffer(told, "<i8").reshape(-1, len(first)) if told else np.broadcast_to(first, (batch.num_rows, len(first)))
    return _bins(batch, width), at, bool(told)


def _counted(batch: pa.RecordBatch, specs: Sequence[TreeSpec], classes: int, start: int = 0):
    """Which rows the bags of ``specs`` hold (rows x trees), and the row count and label sums of given places of rows and trees."""
    if "h" in batch.schema.names:
        label, weights = batch["label"].to_numpy(zero_copy_only=False), bag_weights(batch["h"].to_numpy(), specs, start)
        return weights > 0, lambda r, tree: [np.ones(len(r)), *_sums(label[r], weights[r, tree], classes)]
    held = [batch[c].to_numpy() for c in ["n", *[f"s{i}" for i in range(classes or 3)]]]
    return np.broadcast_to(True, (batch.num_rows, len(specs))), lambda r, tree: [c[r] for c in held]


# --- one level


def _sums(label: np.ndarray, weight: np.ndarray, classes: int) -> list[np.ndarray]:
    """What a node keeps besides its rows: weighted rows per class, or weighted sums of 1, y and y squared."""
    if classes:
        return [weight * (label == c) for c in range(classes)]
    return [weight, weight * label, weight * label * label]


def _roots(specs: Sequence[TreeSpec], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(specs), 1 + (classes or 3)))
        for batch in batches:
            if "h" not in batch.schema.names:
                total += [batch[c].to_numpy().sum() for c in ["n", *[f"s{i}" for i in range(classes or 3)]]]
                continue
            label, h = batch["label"].to_numpy(zero_copy_only=False), batch["h"].to_numpy()
            w = bag_weights(h, specs)
            total[:, 0] += (w > 0).sum(0)
            for i, s in enumerate(_sums(label[:, None], w, classes)):
                total[:, 1 + i] += s.sum(0)
        yield pa.record_batch([pa.array(np.arange(len(specs), dtype=np.int32)), *[pa.array(c) for c in total.T]], names=["tree", "n", *[f"s{i}" for i in range(total.shape[1] - 1)]])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of equal cells of a task; those held are passed on when they get too many."""
    held, rows = [], 0

    def folded() -> pa.Table:
        table = pa.Table.from_batches(held)
        sums = [c for c in table.column_names if c not in CELL]
        return table.group_by(CELL, use_threads=False).aggregate([(c, "sum") for c in sums]).select([*CELL, *[f"{c}_sum" for c in sums]]).rename_columns(table.column_names)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 2 * CELLS_AT_ONCE:
            done = folded()
            if done.num_rows > CELLS_AT_ONCE:
                yield from done.to_batches()
                held, rows = [], 0
            else:
                held, rows = done.combine_chunks().to_batches(), done.num_rows
    if held:
        yield from folded().to_batches()


CELL = ["tree", "id", "feature", "bin"]


def _histograms(specs: Sequence[TreeSpec], width: int, bins: int, classes: int, level: int, held: list[dict], first: np.ndarray):
    """Rows and label sums per (tree, node, feature, bin) of a task, for the nodes of this level that the pass cuts."""
    seeds, tries = np.array([s.seed for s in specs]), np.array([s.tries or width for s in specs])
    k = classes or 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            binned, at, _ = _read(batch, width, first)
            at, (present, counts) = _placed(at, binned, held), _counted(batch, specs, classes)
            for t in np.unique(tries).tolist():
                r, tree = np.nonzero((at >= CODES << level) & (at % CODES == MANY) & present & (tries == t))
                if not len(r):
                    continue
                key, own = np.unique(tree.astype(np.int64) << 32 | at[r, tree] // CODES, return_inverse=True)
                trees, nodes = key >> 32, key & 0xFFFFFFFF
                looked = tried(trees, nodes, seeds[trees], t, width) if t < width else np.broadcast_to(np.arange(width), (len(key), width))
                f = looked[own]                                        # row of a node x feature place
                cell = ((own[:, None] * t + np.arange(t)) * bins + binned[r[:, None], f]).ravel()
                places, cell = np.unique(cell, return_inverse=True) if len(key) * t * bins > 4 * len(cell) else (np.arange(len(key) * t * bins), cell)
                columns = [np.bincount(cell, np.repeat(v, t), len(places)) for v in counts(r, tree)]
                hit = np.flatnonzero(columns[0])
                node, rest = np.divmod(places[hit], t * bins)
                yield pa.record_batch(
                    [pa.array(trees[node].astype(np.int32)), pa.array(nodes[node].astype(np.int32)), pa.array(looked[node, rest // bins].astype(np.int32)), pa.array((rest % bins).astype(np.int32)), *[pa.array(c[hit]) for c in columns]],
                    names=[*CELL, "n", *[f"s{i}" for i in range(k)]],
                )

    return lambda batches: _folded(run(batches))


def _placed(at: np.ndarray, bins: np.ndarray, held: list[dict[str, np.ndarray]], least: int = MANY, start: int = 0) -> np.ndarray:
    """Rows at a cut node go down to the last child that ``held`` tells of; only nodes from ``least`` on are looked up.  The first column
    is that of tree ``start``."""
    at = at.astype(np.int64)
    for chunk in held:
        r, tree = np.nonzero(at % CODES >= least)
        while len(r):  # a turn a level
            node = at[r, tree] // CODES
            key = tree.astype(np.int64) + start << 32 | node
            spot = np.minimum(np.searchsorted(chunk["key"], key), len(chunk["key"]) - 1)
            hit = chunk["key"][spot] == key
            r, tree, c = r[hit], tree[hit], spot[hit]
            right = bins[r, chunk["feature"][c]] > chunk["bin"][c]
            code = np.where(right, chunk["right"][c], chunk["left"][c])
            at[r, tree] = (2 * node[hit] + right) * CODES + code
            r, tree = r[code >= least], tree[code >= least]
    return at


def _advance(held: list[dict[str, np.ndarray]], width: int, first: np.ndarray, least: int = MANY):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, at, _ = _read(batch, width, first)
                at = _placed(at, bins, held, least).astype("<i8")
                yield batch.set_column(batch.schema.names.index("at"), "at", pa.array([v.tobytes() for v in at], pa.binary()))

    return run


# --- subtrees of one task


def _dealt(specs: Sequence[TreeSpec], width: int, classes: int, held: list[dict], first: np.ndarray):
    """The rows of every small node, those of a task with equal bins added up for each tree that holds them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            bins, at, written = _read(batch, width, first)
            one, kind = distinct_rows(bins)
            step = max(1, CELLS_AT_ONCE // batch.num_rows)
            for t in range(0, len(specs), step):
                present, counts = _counted(batch, specs[t:t + step], classes, t)
                if written or held:
                    place = _placed(at[:, t:t + step], bins, held, start=t)
                    r, tree = np.nonzero((place % CODES == FEW) & present)
                    key, node = np.unique(tree.astype(np.int64) + t << 32 | place[r, tree] // CODES, return_inverse=True)
                else:  # all rows of a tree are at its root
                    r, tree = np.nonzero(present & (first[t:t + step] % CODES == FEW))
                    key, node = np.arange(t, t + present.shape[1], dtype=np.int64) << 32 | first[t:t + step] // CODES, tree
                if not len(r):
                    continue
                cell = node * len(one) + kind[r]
                places, cell = np.unique(cell, return_inverse=True) if len(key) * len(one) > 4 * len(cell) else (np.arange(len(key) * len(one)), cell)
                columns = [np.bincount(cell, v, len(places)) for v in counts(r, tree)]
                hit = np.flatnonzero(columns[0])
                node, own = np.divmod(places[hit], len(one))
                yield pa.record_batch(
                    [pa.array((key[node] >> 32).astype(np.int32)), pa.array((key[node] & 0xFFFFFFFF).astype(np.int32)), _packed(bins[one[own]]), *[pa.array(c[hit]) for c in columns]],
                    names=["tree", "id", "bins", "n", *[f"s{i}" for i in range(classes or 3)]],
                )

    return run


def _disorder(sums: Sequence[np.ndarray], criterion: str, classes: int) -> np.ndarray:
    """``impurity`` over arrays, term by term as there."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if not classes:
            w, y, yy = sums
            return np.maximum(np.nan_to_num(yy / w - (y / w) ** 2), 0.0)
        whole, gini, bits = sum(sums[1:], sums[0]), 1.0, 0.0
        for s in sums:
            p = np.nan_to_num(s / whole)
            gini, bits = gini - p * p, bits - np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0)
        return bits if criterion == "entropy" else gini


def _below(values: np.ndarray, start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Running sums within runs of cells; ``start`` holds the first cell of each run, ``run`` the run of each cell."""
    total = np.cumsum(values.astype(np.longdouble))
    return (total - (total[start] - values[start])[run]).astype(float)


def _subtree(specs: Sequence[TreeSpec], width: int, bins: int, classes: int, scale: Sequence[float]):
    """All cuts below one node, from its cells, by the rules of the passes: level by level, over the nodes of a level at once."""
    names = ["n", *[f"s{i}" for i in range(classes or 3)]]

    def run(group: pa.Table) -> pa.Table:
        tree, top = group["tree"][0].as_py(), group["id"][0].as_py()
        spec, level = specs[tree], top.bit_length() - 1
        t = spec.tries or width
        x, sums = _bins(group, width), [group[c].to_numpy() for c in names]
        rows, own, ids, found = np.arange(len(x)), np.zeros(len(x), np.int64), np.array([top], np.int64), []

        def goes_on(n: np.ndarray, s: list[np.ndarray], depth: int) -> np.ndarray:
            return (n >= spec.min_split) & (n >= 2 * spec.min_leaf) & (min(spec.max_depth, DEEPEST) > depth) & (_disorder(s, spec.criterion, classes) > PURE)

        def scaled(s: list[np.ndarray]) -> list[np.ndarray]:
            return [v * f for v, f in zip(s, scale)]

        while len(ids):
            looked = tried(np.full(len(ids), tree), ids, np.full(len(ids), spec.seed), t, width) if t < width else np.broadcast_to(np.arange(width), (len(ids), width))
            cell = ((own[:, None] * t + np.arange(t)) * bins + x[rows[:, None], looked[own]]).ravel()
            if len(ids) * t * bins > 8 * len(cell):
                hit, cell = np.unique(cell, return_inverse=True)
                columns = [np.bincount(cell, np.repeat(s[rows], t), len(hit)) for s in sums]
            else:
                hit = np.flatnonzero(np.bincount(cell, minlength=len(ids) * t * bins))
                columns = [np.bincount(cell, np.repeat(s[rows], t), len(ids) * t * bins)[hit] for s in sums]
            place = hit // bins
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            part = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(hit)]))
            last = np.r_[start[1:], len(hit)] - 1
            left = [_below(c, start, part) for c in columns]
            right = [v[last][part] - v for v in left]
            usable = np.flatnonzero((left[0] >= spec.min_leaf) & (right[0] >= spec.min_leaf))
            left, right, hit = [v[usable] for v in left], [v[usable] for v in right], hit[usable]
            ls, rs = scaled(left[1:]), scaled(right[1:])
            lw, rw = (sum(s[1:], s[0]) if classes else s[0] for s in (ls, rs))
            loss = lw * _disorder(ls, spec.criterion, classes) + rw * _disorder(rs, spec.criterion, classes)
            if not classes:
                both = [a + b for a, b in zip(left[1:], right[1:])]
                loss = np.floor(loss / (both[0] * _disorder(both, "variance", 0)) * 1e9 + 0.5) / 1e9
            node = hit // (t * bins)
            order = np.lexsort((hit, loss, node))
            best = order[np.r_[True, node[order][1:] != node[order][:-1]]] if len(order) else order
            node, rest = node[best], hit[best] % (t * bins)
            feature, cut = looked[node, rest // bins], rest % bins
            sides = [[v[best] for v in left], [v[best] for v in right]]
            go = [goes_on(s[0], scaled(s[1:]), level + 1) for s in sides]
            found.append([ids[node], feature, cut, *sides[0], *sides[1], *go, np.full(len(node), level)])
            child = np.full((len(ids), 2), -1)  # number of a child on the next level
            fresh = np.stack(go, 1)
            child[node] = np.where(fresh, np.cumsum(fresh.ravel()).reshape(-1, 2) - 1, -1)
            split_on, at = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            split_on[node], at[node] = feature, cut
            own = child[own, (x[rows, split_on[own]] > at[own]).astype(int)]
            ids = np.stack([2 * ids[node], 2 * ids[node] + 1], 1)[fresh]
            rows, own, level = rows[own >= 0], own[own >= 0], level + 1
        out = [np.concatenate(v) for v in zip(*found)]
        kinds = [np.int32] * 3 + [float] * (2 * len(names)) + [np.int32] * 3
        table = {c: pa.array(v.astype(k)) for c, v, k in zip(["id", "feature", "bin", *[f"{p}{c}" for p in ("l", "r") for c in names], "left", "right", "level"], out, kinds)}
        return pa.table({"tree": pa.array(np.full(len(out[0]), tree, np.int32)), "criterion": pa.array([spec.criterion] * len(out[0]), pa.string()), **table})

    return run


def pieces(table: DataFrame, columns: Sequence[str], most: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a node table in pieces of about ``most``, sorted by tree and id, as arrays."""
    most = most or NODES_AT_ONCE
    parts = max(1, math.ceil(table.count() / most))
    for i in range(parts):
        part = table if parts == 1 else table.where(F.pmod(F.hash("tree", "id"), F.lit(parts)) == i)
        rows = part.select("tree", "id", *columns).toArrow()
        if not rows.num_rows:
            continue
        key = rows["tree"].to_numpy().astype(np.int64) << 32 | rows["id"].to_numpy()
        order = np.argsort(key)
        out = {"key": key[order]}
        for c in columns:
            v = rows[c].combine_chunks()
            out[c] = v.flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)[order] if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False)[order]
        yield out


def impurity(sums: Sequence[Column], criterion: Column | str, classes: int) -> Column:
    """Gini, entropy in bits, or variance of a node, from its label sums."""
    if not classes:
        w, y, yy = sums
        return F.greatest(F.coalesce(F.try_divide(yy, w) - F.try_divide(y, w) ** 2, F.lit(0.0)), F.lit(0.0))
    w = sum(sums[1:], sums[0])
    shares = [F.coalesce(F.try_divide(s, w), F.lit(0.0)) for s in sums]
    gini, bits = F.lit(1.0), F.lit(0.0)
    for p in shares:
        gini = gini - p * p
        bits = bits - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    kind = F.lit(criterion) if isinstance(criterion, str) else criterion
    return F.when(kind == "entropy", bits).otherwise(gini)


def _weight(sums: Sequence[Column], classes: int) -> Column:
    return sum(sums[1:], sums[0]) if classes else sums[0]


class Grown:
    """``nodes``: tree, id, parent, depth, feature, cut_bin, threshold (null at leaves), n, sums (weighted label sums), impurity,
    weight, left, right (-1 at leaves).  ``state``: the binned training rows, whose places start at ``first``; after ``held`` cuts and
    those of ``small``, the cuts that single tasks made, each is at its leaf in each tree."""

    def __init__(self, nodes: DataFrame, state: DataFrame, held: list[dict], specs: list[TreeSpec], classes: int, width: int, first: np.ndarray, small: DataFrame | None):
        self.nodes, self.state, self.held, self.specs, self.classes, self.width = nodes, state, held, specs, classes, width
        self.first, self.small = first, small

    def release(self) -> None:
        self.state.unpersist()

    def walked(self) -> tuple[DataFrame, list[dict]]:
        """State and cuts that lead each row to its leaf; cuts that are too many to hold are walked from above, and places written."""
        state, held = self.state, list(self.held)
        if self.small is None:
            return state, held
        whole = self.small.count() + sum(len(c["key"]) for c in held) <= NODES_AT_ONCE
        parts = [self.small] if whole else [self.small.where(F.col("level") == r["level"]) for r in self.small.select("level").distinct().orderBy("level").collect()]
        for part in parts:
            for chunk in pieces(part, ["feature", "bin", "left", "right"]):
                if held and sum(len(c["key"]) for c in held) + len(chunk["key"]) > NODES_AT_ONCE:
                    state, held = settled(state.mapInArrow(_advance(held, self.width, self.first, FEW), STATE), "places"), []
                held.append(chunk)
        return state, held


def grow(frame: DataFrame, specs: Sequence[TreeSpec], classes: int, label: str = "label", features: str = "features", row: str = "row_id", bins: int = BINS, class_weights: Sequence[float] | None = None) -> Grown:
    """Grow one tree per spec.  ``classes`` 0 is regression.  A node splits at the cut of largest weighted impurity decrease (ties, for
    means to nine digits: smallest feature, then smallest cut) among those that leave ``min_leaf`` rows of the bag on both sides; it stays a leaf when it
    is pure, at the depth limit, or has fewer than ``min_split`` rows of the bag.  Rows are counted, not weighted, in both minima.
    Missing values (NaN) go right.  Rows without a label are left out.  ``row`` is read where some tree has a bag."""
    specs = list(specs)
    bagged = any(s.bag for s in specs)
    trees, k = len(specs), classes or 3
    spark = frame.sparkSession
    usable = frame.where(F.col(label).isNotNull() & ~F.isnan(F.col(label)))
    cuts = bin_cuts(usable, features, bins)
    width, most_bins = len(cuts), max((len(c) for c in cuts), default=0) + 1
    scale = [float(v) for v in class_weights] if class_weights else [1.0] * k
    h = hash60([row], 0) if bagged else F.lit(0).cast("bigint")
    rows = usable.select(F.col(label).cast("double").alias("label"), h.alias("h"), vector_to_array(F.col(features)).alias("x")).mapInArrow(_binned(cuts), STATE)
    names = [f"s{i}" for i in range(k)]
    told = "n double, " + ", ".join(f"{s} double" for s in names)
    shape, state = STATE, rows
    if not bagged:
        added = rows.mapInArrow(_cells(width, classes), f"bins binary, {told}").groupBy("bins").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        shape, state = f"{told}, bins binary, at binary", added.select("n", *names, "bins", F.lit(b"").alias("at"))
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    rules = F.broadcast(spark.createDataFrame([(t, s.min_leaf, s.min_split, min(s.max_depth, DEEPEST), s.criterion) for t, s in enumerate(specs)], "tree int, min_leaf int, min_split int, max_depth int, criterion string"))

    def scaled(prefix: str) -> list[Column]:
        return [F.col(f"{prefix}{i}") * scale[i] for i in range(k)]

    def comes_of(n: str, prefix: str, depth: int) -> Column:
        splits = (F.col(n) >= F.col("min_split")) & (F.col(n) >= 2 * F.col("min_leaf")) & (F.col("max_depth") > depth) & (impurity(scaled(prefix), F.col("criterion"), classes) > PURE)
        return F.when(splits & (F.col(n) <= SMALL), FEW).when(splits, MANY).otherwise(STUCK)

    roots = state.mapInArrow(_roots(specs, classes), f"tree int, {told}")
    roots = roots.groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n > 0")
    roots = settled(roots.join(rules, "tree").select("tree", F.lit(1).alias("id"), "n", *names, comes_of("n", "s", 0).alias("go"), "criterion"), "roots")
    first = np.full(trees, CODES + STUCK, np.int64)
    for r in roots.select("tree", "go").collect():  # one row a tree
        first[r["tree"]] = CODES + r["go"]
    if (first % CODES == MANY).any():
        cells = (state.select("bins").distinct() if bagged else state).count()
        if cells * max(s.tries or width for s in specs) <= VALUES * SMALL:
            first[first % CODES == MANY] = CODES + FEW
    by_feature = Window.partitionBy("tree", "id", "feature")
    below, whole = by_feature.orderBy("bin"), by_feature.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = [(_weight(scaled(p), classes), impurity(scaled(p), F.col("criterion"), classes)) for p in ("ls", "rs")]
    loss = sides[0][0] * sides[0][1] + sides[1][0] * sides[1][1]
    if not classes:  # sums of real labels differ in the last digits with the order of the rows; equal cuts must stay equal
        whole_sums = [F.col(f"l{c}") + F.col(f"r{c}") for c in names]
        loss = F.round(loss / (whole_sums[0] * impurity(whole_sums, "variance", 0)), 9)
    best = F.struct((-loss).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    both = [f"{p}{c}" for p in ("l", "r") for c in ("n", *names)]
    found = scratch_path(spark, "cuts")
    held: list[dict] = []
    some, large = bool((first % CODES == FEW).any()), bool((first % CODES == MANY).any())
    levels = min(DEEPEST, max((s.max_depth for s in specs), default=0)) if large else 0
    cuts_made, small = None, None
    for level in range(levels):
        part = state.mapInArrow(_histograms(specs, width, most_bins, classes, level, held, first), f"tree int, id int, feature int, bin int, {told}")
        cells = part.groupBy("tree", "id", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).repartition("tree", "id")
        run = cells.select("tree", "id", "feature", "bin", *[F.sum(c).over(below).alias(f"l{c}") for c in ("n", *names)], *[F.sum(c).over(whole).alias(f"t{c}") for c in ("n", *names)])
        run = run.select("tree", "id", "feature", "bin", *[F.col(f"l{c}") for c in ("n", *names)], *[(F.col(f"t{c}") - F.col(f"l{c}")).alias(f"r{c}") for c in ("n", *names)])
        run = run.join(rules, "tree").where((F.col("ln") >= F.col("min_leaf")) & (F.col("rn") >= F.col("min_leaf")))
        cut = run.groupBy("tree", "id").agg(F.max_by(F.struct("feature", "bin", *both, "min_leaf", "min_split", "max_depth", "criterion"), best).alias("c")).select("tree", "id", "c.*")
        cut = cut.select("tree", "id", "feature", "bin", *both, "criterion", comes_of("ln", "ls", level + 1).alias("left"), comes_of("rn", "rs", level + 1).alias("right"))
        cut.write.parquet(f"{found}/level={level}")
        cuts_made, alive = T.StructType([*cut.schema, T.StructField("level", T.IntegerType())]), False
        for chunk in pieces(spark.read.schema(cut.schema).parquet(f"{found}/level={level}"), ["feature", "bin", "left", "right"]):
            if sum(len(c["key"]) for c in held) + len(chunk["key"]) > NODES_AT_ONCE and held:
                state, old = settled(state.mapInArrow(_advance(held, width, first), shape), "places"), state
                old.unpersist()
                held = []
            held.append(chunk)
            codes = np.concatenate([chunk["left"], chunk["right"]])
            alive, some = alive or bool((codes == MANY).any()), some or bool((codes == FEW).any())
        if not alive:
            break
    if cuts_made is not None:
        cuts_made = spark.read.schema(cuts_made).parquet(found)
    if some:
        dealt = state.mapInArrow(_dealt(specs, width, classes, held, first), f"tree int, id int, bins binary, {told}")
        # a task has added up its own rows: what is left to add comes together where the subtree is grown
        dealt = dealt.repartition("tree", "id").groupBy("tree", "id", "bins").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        cut_shape = "tree int, criterion string, id int, feature int, bin int, " + ", ".join(f"{c} double" for c in both) + ", left int, right int, level int"
        small = settled(dealt.groupBy("tree", "id").applyInArrow(_subtree(specs, width, most_bins, classes, scale), cut_shape), "subtrees")
        cuts_made = small if cuts_made is None else cuts_made.unionByName(small)

    threshold = F.get(F.get(F.lit([[float(v) for v in c] or [0.0] for c in cuts] or [[0.0]]), F.col("feature")), F.col("cut_bin"))
    table = roots.select("tree", "id", F.lit(0).alias("depth"), "n", *names, "criterion")
    if cuts_made is not None:
        for side, p in ((0, "l"), (1, "r")):
            table = table.unionAll(cuts_made.select("tree", (F.col("id") * 2 + side).alias("id"), F.col("level") + 1, F.col(f"{p}n"), *[F.col(f"{p}{s}") for s in names], "criterion"))
        table = table.join(cuts_made.select("tree", "id", "feature", F.col("bin").alias("cut_bin")), ["tree", "id"], "left")
    else:
        table = table.withColumns({"feature": F.lit(None).cast("int"), "cut_bin": F.lit(None).cast("int")})
    inner = F.col("feature").isNotNull()
    table = table.select(
        "tree", "id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("int")).alias("parent"), "depth", "feature", "cut_bin", F.when(inner, threshold).alias("threshold"),
        F.col("n").cast("bigint").alias("n"), F.array(*scaled("s")).alias("sums"), impurity(scaled("s"), F.col("criterion"), classes).alias("impurity"), _weight(scaled("s"), classes).alias("weight"),
        F.when(inner, F.col("id") * 2).otherwise(-1).alias("left"), F.when(inner, F.col("id") * 2 + 1).otherwise(-1).alias("right"),
    )
    nodes = settled(table, "nodes")
    if not bagged:  # rows are walked by themselves, from the root, and only where votes are asked for
        state.unpersist()
        state, held, small = rows, [], cuts_made
    return Grown(nodes, state, held, specs, classes, width, first, small)


def outcome(classes: int) -> Column:
    """What a node says: class shares, or its mean in a list of one."""
    if classes:
        total = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
        return F.transform("sums", lambda s: F.coalesce(F.try_divide(s, total), F.lit(0.0)))
    return F.array(F.coalesce(F.try_divide(F.get("sums", F.lit(1)), F.get("sums", F.lit(0))), F.lit(0.0)))


def prediction(classes: int, says: Column) -> Column:
    """The class of the largest share (the smallest of equals), or the mean."""
    return (F.array_position(says, F.array_max(says)) - 1).cast("double") if classes else F.get(says, F.lit(0))


def _votes(chunk: dict[str, np.ndarray], held: list[dict], specs: Sequence[TreeSpec], width: int, out: int, unseen: bool, first: np.ndarray):
    trees = len(specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            h, (bins, at, written) = batch["h"].to_numpy(), _read(batch, width, first)
            # rows of equal bins that start from the same places end in the same leaves
            one, kind = (np.arange(len(h)),) * 2 if written else distinct_rows(bins)
            votes = np.frombuffer(b"".join(batch["votes"].to_pylist()), "<f8").reshape(-1, out + 1).copy()
            step = max(1, CELLS_AT_ONCE // len(h))
            for start in range(0, trees, step):
                key = np.arange(start, min(start + step, trees), dtype=np.int64) << 32 | _placed(at[one, start:start + step], bins[one], held, FEW, start) // CODES
                spot = np.minimum(np.searchsorted(chunk["key"], key), len(chunk["key"]) - 1)
                hit = chunk["key"][spot] == key
                unbagged = bag_weights(h, specs[start:start + step], start) == 0 if unseen else np.ones((len(h), key.shape[1]), bool)
                for t in range(key.shape[1]):
                    r = np.flatnonzero(unbagged[:, t] & hit[kind, t])
                    votes[r, 0] += 1
                    votes[r, 1:] += chunk["says"][spot[kind[r], t]]
            yield pa.record_batch([*batch.columns[:4], pa.array([v.tobytes() for v in votes], pa.binary())], names=["label", "h", "bins", "at", "votes"])

    return run


def _unpacked(out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(-1, out + 1)
            yield pa.record_batch([batch.column(0), pa.array(votes[:, 0]), pa.array(list(votes[:, 1:]), pa.list_(pa.float64()))], names=["label", "votes", "total"])

    return run


def votes(grown: Grown, unseen: bool = True) -> DataFrame:
    """``label, votes, says``: per training row, how many trees vote (``unseen``: only those whose bag lacks the row) and their mean."""
    out = grown.classes or 1
    blank = np.zeros(out + 1, "<f8").tobytes()
    state, held = grown.walked()
    tally = state.withColumn("votes", F.lit(blank))
    leaves = grown.nodes.where("left < 0").select("tree", "id", outcome(grown.classes).alias("says"))
    for chunk in pieces(leaves, ["says"]):
        tally = tally.mapInArrow(_votes(chunk, held, grown.specs, grown.width, out, unseen, grown.first), STATE + ", votes binary")
    told = tally.select("label", "votes").mapInArrow(_unpacked(out), "label double, votes double, total array<double>")
    return told.select("label", "votes", F.transform("total", lambda s: F.try_divide(s, F.col("votes"))).alias("says"))


def out_of_bag(grown: Grown) -> DataFrame:
    """One row ``(oob_score, rows)`` from the forest's own trees: accuracy or R2 over the rows that some bag lacks."""
    seen = votes(grown).where("votes > 0").select("label", prediction(grown.classes, F.col("says")).alias("p"))
    if grown.classes:
        return seen.agg(F.avg((F.col("label") == F.col("p")).cast("double")).alias("oob_score"), F.count(F.lit(1)).alias("rows"))
    error = F.avg((F.col("label") - F.col("p")) ** 2)
    return seen.agg((1 - F.try_divide(error, F.nullif(F.var_pop("label"), F.lit(0.0)))).alias("oob_score"), F.count(F.lit(1)).alias("rows"))
