"""Kernel machines as a saveable pipeline stage: scores from support rows, one-vs-one votes, coupled pairwise probabilities."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernel_dual import SUPPORT, Dual, Solved

ROWS_AT_ONCE = 50_000  # support rows sent to the tasks in one piece


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _scorer(dual: Dual, x: np.ndarray, beta: np.ndarray):
    """Adds the scores of one kernel: ``beta`` holds a column per problem."""

    def add(rows: pa.Array, before: pa.Array) -> pa.Array:
        return _lists(_matrix(before) + (dual.gram(_matrix(rows), x) @ beta if len(rows) else 0.0))

    return F.arrow_udf(add, "array<double>")


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities from pairwise ones, rows x K x K with ``r[i, j] = P(i | i or j)``: the minimum of the sum over pairs of
    ``(r_ji p_i - r_ij p_j)^2`` under a sum of one, a linear system per row (Wu, Lin and Weng 2004)."""
    n, k, _ = r.shape
    q = -np.swapaxes(r, 1, 2) * r
    inside = np.einsum("nji,nji->ni", r, r) - np.einsum("nii->ni", r) ** 2
    q[:, np.arange(k), np.arange(k)] = inside
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k], system[:, :k, k], system[:, k, :k] = q, 1.0, 1.0
    target = np.zeros((n, k + 1, 1))
    target[:, k] = 1.0
    p = np.clip(np.linalg.solve(system, target)[:, :k, 0], 0.0, None)
    return p / p.sum(1, keepdims=True)


def _coupler(pairs: list[tuple[int, int]], curves: list[tuple[float, float]], k: int):
    def run(scores: pa.Array) -> pa.Array:
        f = _matrix(scores)
        r = np.zeros((len(f), k, k))
        for p, (i, j) in enumerate(pairs):
            z = np.clip(curves[p][0] * f[:, p] + curves[p][1], -700, 700)
            r[:, i, j] = np.clip(1 / (1 + np.exp(z)), 1e-7, 1 - 1e-7)
            r[:, j, i] = 1 - r[:, i, j]
        return _lists(couple(r)) if len(f) else pa.array([], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def fit_sigmoids(scores: DataFrame, pairs: int, rounds: int = 100, tol: float = 1e-5) -> list[tuple[float, float]]:
    """``(A, B)`` per pair of ``P(+1 | f) = 1 / (1 + exp(A f + B))`` on rows ``(pair, positive, f)``: Newton steps with a line search
    on smoothed targets, every sum from one aggregate over all pairs."""
    held = scores.persist(StorageLevel.MEMORY_AND_DISK)
    spark = held.sparkSession
    try:
        counts = {r["pair"]: (r["up"], r["n"] - r["up"]) for r in held.groupBy("pair").agg(F.count_if("positive").alias("up"), F.count(F.lit(1)).alias("n")).collect()}
        curves = {p: (0.0, math.log((counts[p][1] + 1) / (counts[p][0] + 1))) for p in counts}
        high = {p: (n + 1) / (n + 2) for p, (n, _) in counts.items()}
        low = {p: 1 / (m + 2) for p, (_, m) in counts.items()}

        def with_curves(tries: list[tuple[int, int, float, float]]) -> DataFrame:
            table = spark.createDataFrame([(p, i, a, b, high[p], low[p]) for p, i, a, b in tries], "pair int, i int, a double, b double, high double, low double")
            z = F.col("a") * F.col("f") + F.col("b")
            return held.join(F.broadcast(table), "pair").withColumn("z", z).withColumn("t", F.when(F.col("positive"), F.col("high")).otherwise(F.col("low")))

        # -(t log p + (1 - t) log(1 - p)) without overflow
        loss = F.sum(F.when(F.col("z") >= 0, F.col("t") * F.col("z") + F.log1p(F.exp(-F.col("z")))).otherwise((F.col("t") - 1) * F.col("z") + F.log1p(F.exp(F.col("z")))))
        active = sorted(counts)
        for _ in range(rounds):
            if not active:
                break
            one = with_curves([(p, 0, *curves[p]) for p in active])
            share = 1 / (1 + F.exp(F.col("z")))
            d1, d2, f = F.col("t") - share, share * (1 - share), F.col("f")
            sums = {r["pair"]: r for r in one.groupBy("pair").agg(F.sum(f * d1).alias("ga"), F.sum(d1).alias("gb"), F.sum(f * f * d2).alias("haa"), F.sum(f * d2).alias("hab"), F.sum(d2).alias("hbb"), loss.alias("loss")).collect()}
            steps, tries = {}, []
            for p in list(active):
                s = sums[p]
                if abs(s["ga"]) < tol and abs(s["gb"]) < tol:
                    active.remove(p)
                    continue
                h = np.array([[s["haa"] + 1e-12, s["hab"]], [s["hab"], s["hbb"] + 1e-12]])
                da, db = -np.linalg.solve(h, np.array([s["ga"], s["gb"]]))
                steps[p] = (da, db, s["ga"] * da + s["gb"] * db)
                tries += [(p, i, float(curves[p][0] + da / 2**i), float(curves[p][1] + db / 2**i)) for i in range(12)]
            if not tries:
                break
            found = {(r["pair"], r["i"]): r["loss"] for r in with_curves(tries).groupBy("pair", "i").agg(loss.alias("loss")).collect()}
            for p in list(active):
                da, db, slope = steps[p]
                good = [i for i in range(12) if found[p, i] < sums[p]["loss"] + 1e-4 * slope / 2**i]
                if good:
                    curves[p] = (float(curves[p][0] + da / 2 ** good[0]), float(curves[p][1] + db / 2 ** good[0]))
                else:
                    active.remove(p)
    finally:
        held.unpersist()
    return [tuple(map(float, curves.get(p, (0.0, 0.0)))) for p in range(pairs)]


class _Writer(MLWriter):
    def __init__(self, stage: KernelMachine):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.support.write.parquet(f"{path}/support")


class _Reader(MLReader):
    def load(self, path: str) -> KernelMachine:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = KernelMachine()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.support = self.sparkSession.read.schema(SUPPORT).parquet(f"{path}/support")
        return stage


class KernelMachine(Model, MLReadable, MLWritable):
    """Scores of all class pairs (or of one tube).  Two classes or more vote pair by pair, the smaller class wins ties."""

    facts = Param(Params._dummy(), "facts", "problems, offsets, classes and sigmoids as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output, empty: none", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(facts="{}", featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self.support: DataFrame | None = None
        self._pieces: list | None = None

    @classmethod
    def of(cls, solved: Solved, duals: Sequence[Dual], problems: Sequence[int], classes: int, curves: Sequence[tuple[float, float]] | None = None) -> KernelMachine:
        """The machine of some problems of ``solved``, numbered anew in their order; class pairs go +1 first."""
        stage = cls()
        facts = {"duals": [asdict(duals[p]) for p in problems], "offsets": [solved.offsets[p] for p in problems], "classes": classes, "curves": [list(c) for c in curves] if curves else None}
        stage._set(facts=json.dumps(facts))
        number = F.array_position(F.lit(list(problems)), F.col("problem")) - 1
        stage.support = solved.support.where(F.col("problem").isin(list(problems))).withColumn("problem", number.cast("int"))
        return stage

    def setPredictionCol(self, name: str) -> KernelMachine:
        return self._set(predictionCol=name)

    def setProbabilityCol(self, name: str) -> KernelMachine:
        return self._set(probabilityCol=name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _parts(self, duals: list[Dual]):
        """Support rows in pieces, with a column of coefficients per problem; kept where one piece holds all."""
        if self._pieces is not None:
            return self._pieces
        n = self.support.count()
        pieces = max(1, math.ceil(n / ROWS_AT_ONCE))

        def read():
            for i in range(pieces):
                part = self.support if pieces == 1 else self.support.where(F.pmod(F.hash("id"), F.lit(pieces)) == i)
                rows = part.toArrow()
                if not rows.num_rows:
                    continue
                ids, first, back = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
                x = _matrix(rows["x"].combine_chunks())[first]
                beta = np.zeros((len(ids), len(duals)))
                signs = np.stack([rows["plus"].to_numpy(), -rows["minus"].to_numpy()], 1).sum(1)
                beta[back, rows["problem"].to_numpy()] = signs
                yield x, beta

        if pieces == 1:
            self._pieces = list(read())
            return self._pieces
        return read()

    def scores(self, df: DataFrame, output: str = "scores") -> DataFrame:
        """Adds the score of each problem, offset included."""
        facts = json.loads(self.getOrDefault(self.facts))
        duals = [Dual(**{**d, "pair": tuple(d["pair"]) if d["pair"] else None, "weights": tuple(d["weights"])}) for d in facts["duals"]]
        out = df.withColumn("_x", vector_to_array(F.col(self.getOrDefault(self.featuresCol)))).withColumn(output, F.lit([float(b) for b in facts["offsets"]]))
        kinds = {(d.kernel, d.gamma): d for d in duals}
        for x, beta in self._parts(duals):
            for kind, d in kinds.items():
                own = np.array([(e.kernel, e.gamma) == kind for e in duals])
                rows = np.flatnonzero((beta[:, own] != 0).any(1))
                if len(rows):
                    out = out.withColumn(output, _scorer(d, x[rows], beta[rows] * own)("_x", output))
        return out.drop("_x")

    def _transform(self, df: DataFrame) -> DataFrame:
        facts = json.loads(self.getOrDefault(self.facts))
        out, name = self.scores(df, "_scores"), self.getOrDefault(self.predictionCol)
        k = facts["classes"]
        if not k:
            return out.withColumn(name, F.get("_scores", F.lit(0))).drop("_scores")
        pairs = [tuple(d["pair"]) for d in facts["duals"]]
        votes = [F.lit(0) for _ in range(k)]
        for p, (a, b) in enumerate(pairs):
            wins = F.get("_scores", F.lit(p)) > 0
            votes[a] = votes[a] + wins.cast("int")
            votes[b] = votes[b] + (~wins).cast("int")
        tally = F.array(*votes)
        out = out.withColumn(name, (F.array_position(tally, F.array_max(tally)) - 1).cast("double"))
        shares = self.getOrDefault(self.probabilityCol)
        if facts["curves"] and shares:
            out = out.withColumn(shares, array_to_vector(_coupler(pairs, facts["curves"], k)("_scores")))
        return out.drop("_scores")
