"""Nearest-neighbour classification and regression over the exact neighbour join."""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelNotFittedError
from ..functions.scratch import settled
from ..operators.neighbours import argmax, gathered, nearest, vector_key, vote
from .base import FEATURES, LABEL, ROW, Candidate, branch_stages, class_scores, error_scores
from .registry import register_model
from .tuning import Choice, IntRange, Search, tpe_search


class KnnModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Holds the train vectors as a table; prediction is a join."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "distance", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(k=5, weights="uniform", metric="euclidean", classes=0, featuresCol=FEATURES)
        self.train: DataFrame | None = None

    @classmethod
    def of(cls, train: DataFrame, setting: dict, n_classes: int):
        m = cls()
        m._set(k=setting["n_neighbors"], weights=setting["weights"], metric=setting["metric"], classes=n_classes)
        m.train = train
        return m

    def neighbours(self, df: DataFrame) -> DataFrame:
        if self.train is None:
            raise ModelNotFittedError("the model holds no rows")
        queries = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"))
        return nearest(self.train, queries, self.getOrDefault(self.k), self.getOrDefault(self.metric))

    def _transform(self, df: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.classes) or None
        hits = gathered(self.train, self.neighbours(df))
        shares = vote(F.col("hits"), self.getOrDefault(self.k), self.getOrDefault(self.weights), n)
        votes = hits.select(F.col("query").alias("_q"), shares.alias("_v"))
        out = df.withColumn("_q", vector_key(vector_to_array(F.col(self.getFeaturesCol())))).join(votes, "_q", "left")
        if n is None:
            return out.withColumn("prediction", F.col("_v")).drop("_q", "_v")
        return out.withColumns({"prediction": argmax(F.col("_v")), "probability": array_to_vector(F.col("_v"))}).drop("_q", "_v")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: KnnModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.parquet(f"{path}/train")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KnnModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.train = self.sparkSession.read.parquet(f"{path}/train")
        return model


def train_rows(frame: DataFrame) -> DataFrame:
    return frame.select(F.col(ROW).alias("id"), vector_to_array(F.col(FEATURES)).alias("x"), F.col(LABEL).alias("label"))


@register_model("both")
class Knn(Candidate):
    """The widest neighbourhood is found once per fold and metric and serves every k and weighting."""

    name = "KNN"
    # fixed values: the default search ranges
    defaults = {
        "n_neighbors": (3, 15), "weights": ("uniform", "distance"), "metric": ("euclidean", "manhattan", "minkowski"), "scaler": "minmax",
        "reduction": "pca", "n_components": 0.95, "n_trials": 10,
    }
    descriptions = {"n_neighbors": "neighbours that vote", "metric": "distance", "weights": "how neighbours are weighted"}

    def __init__(self, problem, config=None):
        super().__init__(problem, config)
        self.name = self.label_for(problem.task)

    @classmethod
    def label_for(cls, task):
        return f"KNN ({task.capitalize()})"

    def stages(self) -> list:
        c, reduce = self.config, None
        if c["reduction"] == "nca" and self.problem.is_classification:
            reduce = ("nca", c["n_components"] if isinstance(c["n_components"], int) else 0)
        elif c["reduction"]:
            reduce = ("pca", c["n_components"])
        return branch_stages(self.problem, scaler="standard" if c["scaler"] == "standard" else "minmax", reduce=reduce)

    def run_search(self, evaluate) -> Search:
        c = self.config
        space = {"n_neighbors": IntRange(*c["n_neighbors"]), "weights": Choice(c["weights"]), "metric": Choice(c["metric"])}
        return tpe_search(space, evaluate, c["n_trials"], seed=self.problem.seed)

    def score(self, train, valid, settings):
        out = [-math.inf] * len(settings)
        # minkowski with its default power is the euclidean distance
        groups: dict[str, list[int]] = {}
        for i, s in enumerate(settings):
            groups.setdefault("euclidean" if s["metric"] == "minkowski" else s["metric"], []).append(i)
        n = self.problem.n_classes or None
        rows = train_rows(train)
        keyed = valid.select(LABEL, vector_to_array(F.col(FEATURES)).alias("x")).withColumn("query", vector_key(F.col("x")))
        for metric, members in groups.items():
            held: list = []
            try:
                widest = max(settings[i]["n_neighbors"] for i in members)
                hits = gathered(rows, nearest(rows, keyed, widest, metric, held))
                votes = [vote(F.col("hits"), settings[i]["n_neighbors"], settings[i]["weights"], n) for i in members]
                picks = [argmax(v) if n else v for v in votes]
                table = hits.select("query", *[p.alias(f"p{j}") for j, p in enumerate(picks)])
                joined = keyed.select(LABEL, "query").join(table, "query")
                long = joined.select(LABEL, F.inline(F.array(*[F.struct(F.lit(j).alias("setting"), F.col(f"p{j}").alias("p")) for j in range(len(members))])))
                found = class_scores(long, "accuracy") if n else error_scores(long, "mae")
                for j, i in enumerate(members):
                    out[i] = found.get(j, -math.inf)
            finally:
                for df in held:
                    df.unpersist()
        return out

    def build(self, frame, setting):
        # the table of train vectors is the model, so it is written once and outlives the training session's caches
        self.knn = KnnModel.of(settled(train_rows(frame), "knn"), setting, self.problem.n_classes)
        return self.knn

    def tailored(self, spark):
        self._fitted()
        return {"elbow": self.search.elbow(spark, "n_neighbors"), "best_k": spark.createDataFrame([(int(self.best["n_neighbors"]),)], "best_k int")}

    def inspected(self, test: DataFrame, rows: int = 5) -> DataFrame:
        """Neighbours of the first test rows by row id: ``(row_id, rank, neighbour, distance)``."""
        first = self._fitted().stages[0].transform(test.orderBy(ROW).limit(rows)).select(ROW, FEATURES)
        keyed = first.select(ROW, vector_key(vector_to_array(F.col(FEATURES))).alias("query"))
        found = self.knn.neighbours(first)
        return keyed.join(found, "query").select(ROW, "rank", F.col("id").alias("neighbour"), "distance")
