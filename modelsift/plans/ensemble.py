"""Grown trees as a saveable pipeline stage: a node table and the walk through it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.growth import NODES_AT_ONCE, distinct_rows, outcome, pieces, prediction
from ..operators.shapley import shapley_importance, shapley_values

KNOWN = 50_000  # results of rows on different sides of some threshold that a task keeps
NODE_COLUMNS = "tree int, id int, parent int, depth int, feature int, cut_bin int, threshold double, n bigint, sums array<double>, impurity double, weight double, left int, right int"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _spots(chunk: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.arange(at.shape[1], dtype=np.int64) << 32 | at
    spot = np.minimum(np.searchsorted(chunk["key"], key), len(chunk["key"]) - 1)
    return spot, chunk["key"][spot] == key


def _walked(chunk: dict, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where rows get to from their places ``at`` (rows x trees) by the cuts of ``chunk``."""
    while at.size:  # one level a turn
        spot, hit = _spots(chunk, at)
        r, t = np.nonzero(hit)
        if not len(r):
            break
        c = spot[r, t]
        at[r, t] = 2 * at[r, t] + ~(rows[r, chunk["feature"][c]] <= chunk["threshold"][c])  # a missing value goes right
    return at


def _voted(chunk: dict, at: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Adds what the leaves of ``chunk`` say to ``votes``, for the rows that are there."""
    spot, hit = _spots(chunk, at)
    r, t = np.nonzero(hit)
    for c in range(votes.shape[1]):
        np.add.at(votes[:, c], r, chunk["says"][spot[r, t], c])
    return votes


def _walker(chunk: dict):
    return F.arrow_udf(lambda x, at: _lists(_walked(chunk, _matrix(x, float), _matrix(at, np.int64)).astype(np.int32)), "array<int>")


def _teller(chunk: dict):
    return F.arrow_udf(lambda at, before: _lists(_voted(chunk, _matrix(at, np.int64), _matrix(before, float).copy())), "array<double>")


def _whole(inner: list[dict], leaves: list[dict], trees: int, out: int):
    """The leaves of a row in all trees, or with ``out`` the sums of what they say, where a task holds all nodes.  Rows on the same side
    of every threshold get the same, so one of them is walked."""
    seen = [np.unique(np.concatenate([c["threshold"][c["feature"] == f] for c in inner])) for f in range(1 + max((int(c["feature"].max()) for c in inner), default=-1))]
    known: dict[bytes, int] = {}
    results = [np.empty((0, out or trees), float if out else np.int32)]

    def found(rows: np.ndarray) -> np.ndarray:
        at = np.ones((len(rows), trees), np.int64)
        for chunk in inner:
            at = _walked(chunk, rows, at)
        if not out:
            return at.astype(np.int32)
        votes = np.zeros((len(rows), out))
        for chunk in leaves:
            votes = _voted(chunk, at, votes)
        return votes

    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return _lists(results[0][:0])
        rows = _matrix(x, float)
        codes = np.stack([np.searchsorted(c, rows[:, f]) for f, c in enumerate(seen)], 1).astype(np.int32) if seen else np.zeros((len(rows), 0), np.int32)
        one, kind = distinct_rows(codes)
        names = [codes[i].tobytes() for i in one]
        fresh = np.array([i for i, name in enumerate(names) if name not in known], np.int64)
        if len(fresh):
            if len(known) + len(fresh) > KNOWN:
                known.clear()
                results[0], fresh = results[0][:0], np.arange(len(names))
            known.update((names[i], len(results[0]) + j) for j, i in enumerate(fresh.tolist()))
            results[0] = np.concatenate([results[0], found(rows[one[fresh]])])
        return _lists(results[0][np.array([known[name] for name in names])][kind])

    return F.arrow_udf(run, "array<double>" if out else "array<int>")


class _Writer(MLWriter):
    def __init__(self, stage: TreeEnsemble):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.nodes.write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> TreeEnsemble:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = TreeEnsemble()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.nodes = self.sparkSession.read.schema(NODE_COLUMNS).parquet(f"{path}/nodes")
        return stage


class TreeEnsemble(Model, MLReadable, MLWritable):
    """Mean of the class shares (or of the means) of the leaves that a row reaches.

    A table of up to ``NODES_AT_ONCE`` inner nodes, and as many leaves, is sent to the tasks whole; a larger one in bands of levels, in
    pieces of that size.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output, empty: none", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(trees=1, classes=0, featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self.nodes: DataFrame | None = None
        self._pieces: tuple | None = None

    @classmethod
    def of(cls, nodes: DataFrame, trees: int, classes: int, features: str = "features") -> TreeEnsemble:
        stage = cls()
        stage._set(trees=trees, classes=classes, featuresCol=features)
        stage.nodes = nodes.select([c.split()[0] for c in NODE_COLUMNS.split(", ")])
        return stage

    def setPredictionCol(self, name: str) -> TreeEnsemble:
        return self._set(predictionCol=name)

    def setProbabilityCol(self, name: str) -> TreeEnsemble:
        return self._set(probabilityCol=name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _steps(self) -> tuple:
        """Pieces of inner nodes, from the root down, and of leaves; kept where all fit in one."""
        if self._pieces:
            return self._pieces
        inner, leaves = self.nodes.where("left >= 0"), self.nodes.where("left < 0").select("tree", "id", outcome(self.getOrDefault(self.classes)).alias("says"))
        deep = sorted((r["depth"], r["count"]) for r in inner.groupBy("depth").count().collect())
        if max(sum(n for _, n in deep), leaves.count()) <= NODES_AT_ONCE:
            self._pieces = (list(pieces(inner, ["feature", "threshold"])), list(pieces(leaves, ["says"])))
            return self._pieces
        bands: list[list[int]] = []  # first and last depth and nodes of the levels that go together
        for d, n in deep:
            if bands and bands[-1][2] + n <= NODES_AT_ONCE:
                bands[-1][1:] = [d, bands[-1][2] + n]
            else:
                bands.append([d, d, n])
        return (chunk for a, b, _ in bands for chunk in pieces(inner.where(F.col("depth").between(a, b)), ["feature", "threshold"])), pieces(leaves, ["says"])

    def leaves(self, df: DataFrame, output: str = "leaves") -> DataFrame:
        """Adds the leaf of each row in each tree."""
        inner, leaves = self._steps()
        if self._pieces:
            return df.withColumn(output, _whole(inner, leaves, self.getOrDefault(self.trees), 0)(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        out = df.withColumn("_x", vector_to_array(F.col(self.getOrDefault(self.featuresCol)))).withColumn(output, F.array_repeat(F.lit(1), self.getOrDefault(self.trees)))
        for chunk in inner:
            out = out.withColumn(output, _walker(chunk)("_x", output))
        return out.drop("_x")

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, trees = self.getOrDefault(self.classes), self.getOrDefault(self.trees)
        inner, leaves = self._steps()
        if self._pieces:
            votes = _whole(inner, leaves, trees, classes or 1)
            out = df.withColumn("_votes", votes(vector_to_array(F.col(self.getOrDefault(self.featuresCol)))))
        else:
            out = self.leaves(df, "_leaves").withColumn("_votes", F.array_repeat(F.lit(0.0), classes or 1))
            for chunk in leaves:
                out = out.withColumn("_votes", _teller(chunk)("_leaves", "_votes"))
            out = out.drop("_leaves")
        says = F.transform("_votes", lambda v: v / trees)
        out = out.withColumn("_says", says).withColumn(self.getOrDefault(self.predictionCol), prediction(classes, F.col("_says")))
        name = self.getOrDefault(self.probabilityCol)
        if classes and name:
            out = out.withColumn(name, array_to_vector(F.col("_says")))
        return out.drop("_votes", "_says")

    def shapley(self, df: DataFrame, width: int, output: str = "shapley") -> tuple[DataFrame, list[float]]:
        """Adds the contributions of all features, per class, and returns the base values."""
        held = df.withColumn("_array", vector_to_array(F.col(self.getOrDefault(self.featuresCol))))
        out, base = shapley_values(held, "_array", self.nodes, self.getOrDefault(self.trees), self.getOrDefault(self.classes), width, output)
        return out.drop("_array"), base

    def shapley_importance(self, df: DataFrame, names: list[str]) -> DataFrame:
        return shapley_importance(self.shapley(df.select(self.getOrDefault(self.featuresCol)), len(names))[0], names)

    def importances(self, names: list[str]) -> DataFrame:
        """``(feature, importance)``: impurity decrease by feature, shared out to one per tree and averaged."""
        kids = self.nodes.select("tree", F.col("parent").alias("id"), (F.col("weight") * F.col("impurity")).alias("own")).groupBy("tree", "id").agg(F.sum("own").alias("under"))
        gain = self.nodes.where("left >= 0").join(kids, ["tree", "id"]).groupBy("tree", "feature").agg(F.sum(F.col("weight") * F.col("impurity") - F.col("under")).alias("gain"))
        whole = gain.groupBy("tree").agg(F.sum("gain").alias("whole"))
        mean = gain.join(whole, "tree").where("whole > 0").groupBy("feature").agg((F.sum(F.col("gain") / F.col("whole")) / self.getOrDefault(self.trees)).alias("importance"))
        every = self.nodes.sparkSession.createDataFrame(list(enumerate(names)), "i int, name string")
        return every.join(mean, F.col("i") == F.col("feature"), "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def shape(self) -> DataFrame:
        """``(tree, depth, leaves)``."""
        return self.nodes.groupBy("tree").agg(F.max("depth").alias("depth"), F.count_if(F.col("left") < 0).alias("leaves"))
