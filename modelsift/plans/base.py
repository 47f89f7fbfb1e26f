"""The candidate contract: preprocessing stages, scoring of settings on a fold, and the final model.

A candidate works on a training frame with the raw feature columns, a double ``label``, an int ``fold`` and a text
``row_id``.  Preprocessing is refitted inside every fold, once per fold and not once per setting.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelExportError, ModelNotFittedError, ModelTrainingError
from ..operators.encode import Ordinal
from ..operators.impute import Imputer
from ..operators.metrics import averaged, confusion_counts, per_class
from ..operators.reduce import LevelVectors, ModelSelect, PcaReduce, UnivariateSelect
from ..operators.scale import LogTransform, PowerTransform, Scaler
from ..operators.schema import CLASSIFICATION, require_target_present
from .tuning import Search

LABEL, FOLD, ROW, FEATURES = "label", "fold", "row_id", "features"
SIDE_BY_SIDE = 10_000_000  # train rows up to which folds share the cores and the cache; beyond, the fits of one fold fill both


@dataclass
class Problem:
    task: str
    numeric: list[str]
    text: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)  # booleans already cast to 0/1
    classes: list | None = None
    seed: int = 42
    folds: int = 3

    @property
    def is_classification(self) -> bool:
        return self.task == CLASSIFICATION

    @property
    def n_classes(self) -> int:
        return len(self.classes) if self.classes else 0


def parallel(jobs: Sequence[Callable], width: int) -> list:
    """Run independent Spark jobs side by side; the first error is raised."""
    if width <= 1 or len(jobs) <= 1:
        return [j() for j in jobs]
    with ThreadPool(min(width, len(jobs))) as pool:
        keep_session = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
        spark_safe = [keep_session(j) for j in jobs]
        return pool.map(lambda j: j(), spark_safe)


def branch_stages(
    problem: Problem, *, impute: str = "median", power: str | None = None, scaler: str | None = None, select: tuple | None = None,
    reduce: tuple | None = None, encoding: str = "onehot", drop_first: bool = False, keep_flags: bool = False,
) -> list:
    """Numeric branch, text branch, then one assembled vector: numeric slots first, text slots after, flags last."""
    num, parts, stages = problem.numeric, [], []
    if num:
        stages.append(Imputer(inputCols=num, strategy=impute))
        if power == "log":
            stages.append(LogTransform(inputCols=num))
        elif power:
            stages.append(PowerTransform(inputCols=num, method=power))
        if scaler:
            stages.append(Scaler(inputCols=num, kind=scaler))
        out = "_num"
        if select and select[0] in ("f_classif", "f_regression", "chi2", "mutual_info_classif", "variance"):
            stages.append(UnivariateSelect(inputCols=num, outputCol=out, labelCol=LABEL, score=select[0], k=select[1]))
        else:
            stages.append(VectorAssembler(inputCols=num, outputCol=out))
            if select:
                stages.append(ModelSelect(inputCol=out, outputCol="_sel", labelCol=LABEL, kind=select[0], keepCount=select[1], classes=problem.n_classes))
                out = "_sel"
        if reduce and reduce[0] == "pca":
            stages.append(PcaReduce(inputCol=out, outputCol="_pca", components=float(reduce[1])))
            out = "_pca"
        elif reduce:
            from ..operators.nca import NcaReduce

            stages.append(NcaReduce(inputCol=out, outputCol="_nca", labelCol=LABEL, components=reduce[1] or 0, seed=problem.seed))
            out = "_nca"
        parts.append(out)
    if problem.text:
        stages.append(Imputer(inputCols=problem.text, strategy="most_frequent"))
        if encoding == "ordinal":
            stages.append(Ordinal(inputCols=problem.text))
            parts += problem.text
        else:
            stages.append(LevelVectors(inputCols=problem.text, outputCol="_txt", dropFirst=drop_first))
            parts.append("_txt")
    if keep_flags:
        parts += problem.flags
    if not parts:
        raise ModelTrainingError("no usable feature")
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return stages


class Candidate(ABC):
    name = "candidate"
    defaults: dict = {}
    descriptions: dict[str, str] = {}
    keyed = True  # whether scoring or building reads the row key
    one_batch = False  # whether the search asks for all settings at once, so that a fold is done with when it is scored

    def __init__(self, problem: Problem, config: dict | None = None):
        self.problem = problem
        self.config = {"parallelism": 4, "hold_folds": True, **self.defaults, **(config or {})}
        self.search: Search | None = None
        self.model: PipelineModel | None = None
        self.best: dict = {}
        self.width: int = self.config["parallelism"]  # folds side by side

    # --- what a candidate supplies

    @abstractmethod
    def stages(self) -> list:
        """Unfitted preprocessing stages ending in the ``features`` vector."""

    @abstractmethod
    def run_search(self, evaluate: Callable[[list[dict]], list[float]]) -> Search: ...

    @abstractmethod
    def score(self, train: DataFrame, valid: DataFrame, settings: list[dict]) -> list[float]:
        """Score of each setting (larger is better), fitted on ``train`` and read on ``valid``."""

    @abstractmethod
    def build(self, frame: DataFrame, setting: dict):
        """Final transformer from ``features`` to ``prediction`` (and ``probability``)."""

    def tailored(self, spark) -> dict[str, DataFrame]:
        return {}

    def held(self, frame: DataFrame) -> bool:
        """Whether a preprocessed frame is read often enough to be worth a place in the cache."""
        return True

    # --- what they share

    @classmethod
    def label_for(cls, task: str) -> str:
        return cls.name

    def _fold_frame(self, train: DataFrame, f: int) -> DataFrame:
        return self._frame(Pipeline(stages=self.stages()).fit(train.filter(F.col(FOLD) != f)), train)

    def _frame(self, pre: PipelineModel, train: DataFrame) -> DataFrame:
        frame = pre.transform(train).select(LABEL, FOLD, *([ROW] if self.keyed else []), FEATURES)
        return frame.persist(StorageLevel.MEMORY_AND_DISK) if self.held(frame) else frame

    def fit(self, train: DataFrame) -> Candidate:
        require_target_present(train, LABEL)
        frames: dict[int, DataFrame] = {}
        hold = self.config["hold_folds"] and not self.one_batch
        if self.one_batch and train.count() > SIDE_BY_SIDE:
            self.width = 1

        def on_fold(f: int, settings: list[dict]) -> list[float]:
            frame = frames.get(f)
            if frame is None:
                frame = self._fold_frame(train, f)
                if hold:
                    frames[f] = frame
            try:
                return self.score(frame.filter(F.col(FOLD) != f), frame.filter(F.col(FOLD) == f), settings)
            finally:
                if not hold and self.held(frame):
                    frame.unpersist()

        def evaluate(settings: list[dict]) -> list[float]:
            width = self.width if self.config["hold_folds"] else 1
            per_fold = parallel([lambda f=f: on_fold(f, settings) for f in range(self.problem.folds)], width)
            means = [sum(v) / len(v) for v in zip(*per_fold)]
            return [m if math.isfinite(m) else -math.inf for m in means]

        frame = None
        try:
            self.search = self.run_search(evaluate)
            self.best, _ = self.search.best
            pre = Pipeline(stages=self.stages()).fit(train)
            frame = self._frame(pre, train)
            self.model = PipelineModel(stages=[pre, self.build(frame, self.best)])
        finally:
            for df in [*frames.values(), frame]:
                if df is not None and self.held(df):
                    df.unpersist()
        return self

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise ModelNotFittedError("fit the model first", model=self.name)
        return self.model

    def predict(self, df: DataFrame) -> DataFrame:
        return self._fitted().transform(df)

    def export(self, path: str) -> None:
        model = self._fitted()
        try:
            model.write().overwrite().save(path)
        except Exception as e:
            raise ModelExportError("the model could not be written", path=path, cause=str(e)[:200]) from e

    def parameters(self, spark) -> DataFrame:
        self._fitted()
        rows = [(self.name, k, f"{v:.4f}" if isinstance(v, float) else str(v), self.descriptions.get(k, "")) for k, v in self.best.items()]
        return spark.createDataFrame(rows, "model string, param string, value string, description string")

    def trials(self, spark) -> DataFrame:
        if self.search is None:
            raise ModelNotFittedError("fit the model first", model=self.name)
        return self.search.table(spark)


def balanced(train: DataFrame, label: str = LABEL, output: str = "weight") -> DataFrame:
    """Balanced class weights as a column; the class counts are the only data brought to the driver."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    case = None
    for c, m in sorted(counts.items()):
        test, w = F.col(label) == F.lit(c), F.lit(n / (k * m))
        case = F.when(test, w) if case is None else case.when(test, w)
    return train.withColumn(output, case)


def _side_by_side(models: Sequence, valid: DataFrame) -> DataFrame:
    """``(label, setting, p)`` from all models over one scan of the validation rows."""
    out = valid.select(LABEL, FEATURES)
    for i, m in enumerate(models):
        m = m.copy()
        m.setPredictionCol(f"p{i}")
        for quiet in ("setRawPredictionCol", "setProbabilityCol"):
            if hasattr(m, quiet):
                getattr(m, quiet)("")
        out = m.transform(out).select(LABEL, FEATURES, *[f"p{j}" for j in range(i + 1)])
    return out.select(LABEL, F.inline(F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"p{i}").alias("p")) for i in range(len(models))])))


def class_scores(long: DataFrame, metric: str = "f1") -> dict[int, float]:
    """Weighted F1 or accuracy per setting of a ``(label, setting, p)`` frame."""
    table = averaged(per_class(confusion_counts(long, LABEL, "p", ["setting"]), ["setting"]), "weighted", ["setting"])
    return {r["setting"]: r[metric] for r in table.collect()}


def error_scores(long: DataFrame, kind: str = "rmse") -> dict[int, float]:
    """Negative error per setting."""
    e = F.col(LABEL) - F.col("p")
    v = {"rmse": F.sqrt(F.avg(e * e)), "mse": F.avg(e * e), "mae": F.avg(F.abs(e))}[kind]
    return {r["setting"]: -r["v"] for r in long.groupBy("setting").agg(v.alias("v")).collect()}


def score_models(models: Sequence, valid: DataFrame, scorer: Callable[[DataFrame], dict[int, float]]) -> list[float]:
    """Scores in order; a setting whose fit failed holds ``None`` and scores minus infinity."""
    good = [(i, m) for i, m in enumerate(models) if m is not None]
    out = [-math.inf] * len(models)
    if good:
        found = scorer(_side_by_side([m for _, m in good], valid))
        for j, (i, _) in enumerate(good):
            out[i] = found.get(j, -math.inf)
    return out
