"""Kernel machines in the dual: decomposition over a shared working set, many problems side by side.

A problem is a pair of classes (hinge loss) or a tube around a real label, with its own kernel and bound.  A round is one pass:
tasks keep the score ``u = sum beta K(x_j, x)`` of their rows and offer those that break the optimality conditions most; per problem
the best offers form a working set of at most ``WORKING`` variables, whose small quadratic program is solved exactly; the rows that
moved go back to all tasks.  Rows that moved are held until ``HELD`` of them, then scores and multipliers are written and the next
round starts from there.  The number of passes grows with the support rows, as for any exact kernel solver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import settled

WORKING = 2_048  # variables of one small problem; its matrix has that many rows and columns
MERGE = 64      # tasks whose offers one task can take; those of more tasks are merged on the way
HELD = 8_000    # moved rows that tasks hold before scores are written
TOLERANCE = 1e-3  # fixed value: largest violation of the optimality conditions


@dataclass(frozen=True)
class Dual:
    """``pair``: the classes of +1 and -1, or None for a real label with tube half width ``epsilon``; bounds are ``c`` times the weights."""

    kernel: str
    gamma: float
    c: float
    pair: tuple[int, int] | None = None
    weights: tuple[float, float] = (1.0, 1.0)
    epsilon: float = 0.1

    def gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = a @ b.T
        if self.kernel == "linear":
            return dots
        if self.kernel == "poly":
            return (self.gamma * dots) ** 3  # fixed values: degree 3 and no constant
        return np.exp(-self.gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dots, 0))

    def sides(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs, linear terms and bounds of the two variables of each row; a bound of zero switches a variable off."""
        n = len(label)
        y = np.tile([1.0, -1.0], (n, 1))
        if self.pair is None:
            return y, np.stack([self.epsilon - label, self.epsilon + label], 1), np.full((n, 2), self.c)
        on = np.stack([label == self.pair[0], label == self.pair[1]], 1)
        return y, np.full((n, 2), -1.0), on * self.c * np.array(self.weights)


def _violations(y, p, bound, alpha, u):
    """Values whose largest over ``up`` may not pass the smallest over ``low``."""
    value = -y * (y * u + p)
    free_up, free_low = alpha < bound - 1e-12 * bound, alpha > 1e-12 * bound
    up = np.where(y > 0, free_up, free_low) & (bound > 0)
    low = np.where(y > 0, free_low, free_up) & (bound > 0)
    return value, up, low


def _leaders(value: np.ndarray, up: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Places of the strongest violators of both kinds."""
    picked = []
    for mask, sign in ((up, -1.0), (low, 1.0)):
        at = np.flatnonzero(mask)
        picked.append(at[np.argsort(sign * value[at], kind="stable")[: most // 2]])
    return np.unique(np.concatenate(picked))


def solve_small(gram: np.ndarray, y: np.ndarray, bound: np.ndarray, alpha: np.ndarray, grad: np.ndarray, tol: float) -> np.ndarray:
    """Multipliers of a working set: pairwise steps on the largest violation, chosen by second-order gain."""
    alpha, grad = alpha.copy(), grad.copy()
    q = gram * y
    q *= y[:, None]
    diagonal = np.diag(q).copy()
    for _ in range(200 * len(y)):
        value = -y * grad
        up = np.where(y > 0, alpha < bound, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < bound)
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, value, -np.inf)))
        gap = value[i] - value
        if np.max(np.where(low, gap, -np.inf)) < tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * y[i] * y * q[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / curve, -np.inf)))
        step = gap[j] / curve[j]
        room_i = bound[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else bound[j] - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        for k in (i, j):  # a multiplier that reaches its bound is exactly there
            alpha[k] = 0.0 if alpha[k] < 1e-14 * bound[k] else bound[k] if alpha[k] > bound[k] * (1 - 1e-14) else alpha[k]
        grad += step * (y[i] * q[i] - y[j] * q[j])  # symmetric: rows lie together in memory
    return alpha


@dataclass
class Moved:
    """Rows that moved since the scores were written: ids in order, features, change of beta and multipliers per problem."""

    ids: np.ndarray
    x: np.ndarray
    beta: np.ndarray
    alpha: np.ndarray
    known: np.ndarray

    @classmethod
    def none(cls, problems: int) -> Moved:
        return cls(np.empty(0, np.int64), np.empty((0, 0)), np.empty((0, problems)), np.empty((0, problems, 2)), np.empty((0, problems), bool))


def _now(batch: pa.RecordBatch, duals: Sequence[Dual], moved: Moved):
    """Ids, labels, features, multipliers and scores of a batch after the rows that moved."""
    n, k = batch.num_rows, len(duals)
    ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(n, -1)
    alpha = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f8").reshape(n, k, 2).copy()
    u = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(n, k).copy()
    if len(moved.ids):
        groups: dict[tuple, list[int]] = {}
        for p, d in enumerate(duals):
            groups.setdefault((d.kernel, d.gamma if d.kernel != "linear" else 0.0), []).append(p)
        for members in groups.values():
            u[:, members] += duals[members[0]].gram(x, moved.x) @ moved.beta[:, members]
        spot = np.minimum(np.searchsorted(moved.ids, ids), len(moved.ids) - 1)
        hit = np.flatnonzero(moved.ids[spot] == ids)
        alpha[hit] = np.where(moved.known[spot[hit]][:, :, None], moved.alpha[spot[hit]], alpha[hit])
    return ids, label, x, alpha, u


OFFER = "problem int, id bigint, label double, x binary, a0 double, a1 double, u double"


def _strongest(duals: Sequence[Dual], rows: pa.Table, most: int) -> pa.Table:
    """The rows of each problem that hold its strongest violators."""
    kept, problem = [], rows["problem"].to_numpy()
    label, u = rows["label"].to_numpy(), rows["u"].to_numpy()
    alpha = np.stack([rows["a0"].to_numpy(), rows["a1"].to_numpy()], 1)
    for p in np.unique(problem).tolist():
        at = np.flatnonzero(problem == p)
        y, linear, bound = duals[p].sides(label[at])
        value, up, low = _violations(y, linear, bound, alpha[at], u[at, None])
        kept.append(at[np.unique(_leaders(value.ravel(), up.ravel(), low.ravel(), most) // 2)])
    return rows.take(pa.array(np.concatenate(kept))) if kept else rows


def _merged(duals: Sequence[Dual], most: int):
    """The strongest rows of all batches of a task; what is held does not grow with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = _strongest(duals, pa.concat_tables([held, rows]) if held is not None else rows, most).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return run


def _offers(duals: Sequence[Dual], active: Sequence[int], moved: Moved, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, label, x, alpha, u = _now(batch, duals, moved)
            for p in active:
                y, linear, bound = duals[p].sides(label)
                value, up, low = _violations(y, linear, bound, alpha[:, p], u[:, p, None])
                rows = np.unique(_leaders(value.ravel(), up.ravel(), low.ravel(), most) // 2)
                yield pa.record_batch(
                    [pa.array(np.full(len(rows), p, np.int32)), pa.array(ids[rows]), pa.array(label[rows]), pa.array([v.tobytes() for v in x[rows]], pa.binary()), pa.array(alpha[rows, p, 0]), pa.array(alpha[rows, p, 1]), pa.array(u[rows, p])],
                    names=["problem", "id", "label", "x", "a0", "a1", "u"],
                )

    return lambda batches: _merged(duals, most)(run(batches))


def _work(duals: Sequence[Dual], most: int, tol: float):
    """The small problem of one group of offers: rows that moved, and on every row the violation that was left."""

    def run(group: pa.Table) -> pa.Table:
        p = group["problem"][0].as_py()
        label, u = group["label"].to_numpy(), group["u"].to_numpy()
        x = np.frombuffer(b"".join(group["x"].to_pylist()), "<f8").reshape(len(label), -1)
        before = np.stack([group["a0"].to_numpy(), group["a1"].to_numpy()], 1)
        y, linear, bound = duals[p].sides(label)
        value, up, low = _violations(y, linear, bound, before, u[:, None])
        top = np.max(value[up]) if up.any() else -np.inf
        bottom = np.min(value[low]) if low.any() else np.inf
        after, rows = before.copy(), np.empty(0, np.int64)
        if top - bottom >= tol:
            chosen = _leaders(value.ravel(), up.ravel(), low.ravel(), most)
            r, v = np.divmod(chosen, 2)
            after[r, v] = solve_small(duals[p].gram(x[r], x[r]), y[r, v], bound[r, v], before[r, v], (y * u[:, None] + linear)[r, v], tol / 10)
            rows = np.unique(r[after[r, v] != before[r, v]])
        rows = rows if len(rows) else np.array([0])  # the violation is told even where nothing moved
        beta = (y * (after - before)).sum(1)
        n = len(rows)
        return pa.table({
            "problem": pa.array(np.full(n, p, np.int32)), "id": pa.array(group["id"].to_numpy()[rows]), "x": pa.array([w.tobytes() for w in x[rows]], pa.binary()), "beta": pa.array(beta[rows]),
            "a0": pa.array(after[rows, 0]), "a1": pa.array(after[rows, 1]), "top": pa.array(np.full(n, top)), "bottom": pa.array(np.full(n, bottom)),
        })

    return run


def _written(duals: Sequence[Dual], moved: Moved):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, label, _, alpha, u = _now(batch, duals, moved)
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([v.tobytes() for v in alpha], pa.binary()), pa.array([v.tobytes() for v in u], pa.binary())], names=["id", "label", "x", "alpha", "u"])

    return run


def _support(duals: Sequence[Dual], moved: Moved):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, label, x, alpha, _ = _now(batch, duals, moved)
                r, p = np.nonzero(alpha.any(2))
                yield pa.record_batch(
                    [pa.array(p.astype(np.int32)), pa.array(ids[r]), pa.array(label[r]), pa.array(list(x[r]), pa.list_(pa.float64())), pa.array(alpha[r, p, 0]), pa.array(alpha[r, p, 1])],
                    names=["problem", "id", "label", "x", "plus", "minus"],
                )

    return run


STATE = "id bigint, label double, x binary, alpha binary, u binary"
SUPPORT = "problem int, id bigint, label double, x array<double>, plus double, minus double"


@dataclass
class Solved:
    """``support``: problem, id, label, x and the multipliers of both sides (their difference is the coefficient), a row per support
    row.  ``offsets``, ``gaps``: per problem; a gap of ``TOLERANCE`` or more means that the rounds ran out."""

    support: DataFrame
    offsets: list[float]
    gaps: list[float]
    rounds: int


def solve(frame: DataFrame, duals: Sequence[Dual], label: str = "label", features: str = "features", rounds: int = 2_000, tol: float = TOLERANCE) -> Solved:
    """Solve all problems on the rows of ``frame``.  A problem without rows on both sides has no support rows and offset 0.

    Rows with a null label are left out; equal rows each have multipliers of their own."""
    duals, k = list(duals), len(duals)
    blank = [np.zeros(2 * k).tobytes(), np.zeros(k).tobytes()]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(v, "<f8").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.binary()), pa.array([blank[0]] * len(x), pa.binary()), pa.array([blank[1]] * len(x), pa.binary())], names=["id", "label", "x", "alpha", "u"])

    rows = frame.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("double").alias("label"), vector_to_array(F.col(features)).alias("x"))
    state = settled(rows, "rows").mapInArrow(begin, STATE).persist(StorageLevel.MEMORY_AND_DISK)
    many = state.rdd.getNumPartitions() > MERGE
    moved, active = Moved.none(k), list(range(k))
    offsets, gaps, done = [0.0] * k, [0.0] * k, 0
    try:
        while active and done < rounds:
            offers = state.mapInArrow(_offers(duals, active, moved, WORKING), OFFER)
            if many:
                offers = offers.repartition(MERGE, F.pmod(F.col("id"), F.lit(MERGE))).mapInArrow(_merged(duals, WORKING), OFFER)
            out = offers.groupBy("problem").applyInArrow(_work(duals, WORKING, tol), "problem int, id bigint, x binary, beta double, a0 double, a1 double, top double, bottom double").toArrow()
            done += 1
            p, ids = out["problem"].to_numpy(), out["id"].to_numpy()
            top, bottom = out["top"].to_numpy(), out["bottom"].to_numpy()
            for a in list(active):
                own = np.flatnonzero(p == a)
                if not len(own) or not np.isfinite(top[own[0]]) or not np.isfinite(bottom[own[0]]):
                    active.remove(a)  # no rows on one side
                    continue
                gaps[a], offsets[a] = float(top[own[0]] - bottom[own[0]]), float(top[own[0]] + bottom[own[0]]) / 2
                if gaps[a] < tol:
                    active.remove(a)
            if not len(p):
                break
            x = np.frombuffer(b"".join(out["x"].to_pylist()), "<f8").reshape(len(p), -1)
            every, back = np.unique(np.concatenate([moved.ids, ids]), return_inverse=True)
            old, new = back[: len(moved.ids)], back[len(moved.ids):]
            after = Moved(every, np.empty((len(every), x.shape[1])), np.zeros((len(every), k)), np.zeros((len(every), k, 2)), np.zeros((len(every), k), bool))
            if len(old):
                after.x[old], after.beta[old], after.alpha[old], after.known[old] = moved.x, moved.beta, moved.alpha, moved.known
            after.x[new] = x
            np.add.at(after.beta, (new, p), out["beta"].to_numpy())
            after.alpha[new, p, 0], after.alpha[new, p, 1], after.known[new, p] = out["a0"].to_numpy(), out["a1"].to_numpy(), True
            moved = after
            if len(moved.ids) > HELD:
                fresh = settled(state.mapInArrow(_written(duals, moved), STATE), "scores")
                state.unpersist()
                state, moved = fresh, Moved.none(k)
        support = settled(state.mapInArrow(_support(duals, moved), SUPPORT), "support")
    finally:
        state.unpersist()
    return Solved(support, offsets, gaps, done)
