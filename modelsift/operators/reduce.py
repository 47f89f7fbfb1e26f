"""Selectors and projections as pipeline stages.

Selection never copies data: a fitted selector is the ``VectorAssembler`` or ``VectorSlicer`` of the kept features.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .encode import MAX_LEVELS, BoundedIndexer
from .projection import LinearMap, covariance, spectrum
from .select import above_variance, k_best


def vector_size(df: DataFrame, c: str) -> int:
    meta = df.schema[c].metadata.get("ml_attr", {})
    if meta.get("num_attrs"):
        return int(meta["num_attrs"])
    row = df.select(c).first()
    return int(row[0].size) if row else 0


def feature_names(df: DataFrame, c: str = "features") -> list[str]:
    """Names recorded on the vector; unnamed slots get ``<column>_<position>``."""
    n = vector_size(df, c)
    names = [f"{c}_{i}" for i in range(n)]
    for group in df.schema[c].metadata.get("ml_attr", {}).get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a.get("name") or names[a["idx"]]
    return [_plain(n) for n in names]


def _plain(name: str) -> str:
    """Drop the marks of the internal branch columns from a slot name."""
    for mark in ("_all_", "_sel_", "_num_", "_txt_"):
        if name.startswith(mark):
            name = name[len(mark):]
    for mark in ("__tail", "__vec"):
        name = name.replace(mark, "")
    return name.lstrip("_")


class _Stage(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def _keep(self, kw: dict) -> None:
        self._set(**{k: v for k, v in kw.items() if v is not None})


class UnivariateSelect(_Stage, HasInputCols, HasOutputCol, HasLabelCol):
    """``k_best`` by a named score, or ``variance`` above a threshold; fitted form assembles the kept columns."""

    score = Param(Params._dummy(), "score", "score name or 'variance'", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "features kept", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "variance threshold", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, labelCol="label", score="f_classif", k=10, threshold=0.0):
        super().__init__()
        self._setDefault(score="f_classif", k=10, threshold=0.0, labelCol="label")
        self._keep(self._input_kwargs)

    def _fit(self, df: DataFrame) -> VectorAssembler:
        cols, score = self.getInputCols(), self.getOrDefault(self.score)
        if score == "variance":
            rows = above_variance(df, cols, self.getOrDefault(self.threshold)).collect()
        elif len(cols) <= self.getOrDefault(self.k):
            return VectorAssembler(inputCols=cols, outputCol=self.getOutputCol())
        else:
            rows = k_best(df, cols, self.getLabelCol(), self.getOrDefault(self.k), score).collect()
        kept = {r["feature"] for r in rows}
        return VectorAssembler(inputCols=[c for c in cols if c in kept], outputCol=self.getOutputCol())


def _weights_of(model) -> np.ndarray:
    """Coefficients as (classes, features)."""
    if hasattr(model, "coefficientMatrix"):
        return np.atleast_2d(model.coefficientMatrix.toArray())
    return np.atleast_2d(model.coefficients.toArray())


def _plain_logistic(n: int, features: str, label: str, max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False)


def rfe_support(df: DataFrame, features: str, label: str, keep: int = 10, step: float = 1, estimator=None) -> list[int]:
    """Indices kept by recursive elimination: refit, drop the smallest squared coefficients, repeat."""
    p = vector_size(df, features)
    keep = keep if keep >= 1 else max(1, int(keep * p))
    drop = int(step) if step >= 1 else max(1, int(step * p))
    alive = list(range(p))
    if p <= keep:
        return alive
    data = df.select(features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        while len(alive) > keep:
            cut = VectorSlicer(inputCol=features, outputCol="_rfe", indices=alive).transform(data)
            est = estimator.copy({estimator.featuresCol: "_rfe"}) if estimator is not None else _plain_logistic(n, "_rfe", label)
            power = (_weights_of(est.fit(cut)) ** 2).sum(0)
            order = np.argsort(power, kind="stable")[: min(drop, len(alive) - int(keep))]
            gone = {alive[i] for i in order}
            alive = [i for i in alive if i not in gone]
    finally:
        data.unpersist()
    return alive


def model_support(df: DataFrame, features: str, label: str, estimator, threshold="median") -> list[int]:
    """Indices whose importance in a fitted model reaches the threshold (median, mean or a number)."""
    model = estimator.fit(df.select(features, label))
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
    else:
        imp = np.abs(_weights_of(model)).sum(0)
    if threshold == "median":
        t = float(np.median(imp))
    elif threshold == "mean":
        t = float(np.mean(imp))
    elif isinstance(threshold, (int, float)):
        t = float(threshold)
    else:
        raise ConfigurationError("threshold is median, mean or a number", threshold=threshold)
    return [i for i, v in enumerate(imp) if v >= t]


class ModelSelect(_Stage, HasInputCol, HasOutputCol, HasLabelCol):
    """``rfe``, ``logistic`` or ``forest`` selection over a vector column."""

    kind = Param(Params._dummy(), "kind", "rfe, logistic or forest", TypeConverters.toString)
    keepCount = Param(Params._dummy(), "keepCount", "features kept by rfe", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "median, mean or a number as text", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol="label", kind="rfe", keepCount=10, threshold="median", classes=0, seed=42):
        super().__init__()
        self._setDefault(kind="rfe", keepCount=10, threshold="median", classes=0, seed=42, labelCol="label")
        self._keep(self._input_kwargs)

    def _fit(self, df: DataFrame) -> VectorSlicer:
        f, y, kind = self.getInputCol(), self.getLabelCol(), self.getOrDefault(self.kind)
        t = self.getOrDefault(self.threshold)
        t = t if t in ("median", "mean") else float(t)
        if kind == "rfe":
            kept = rfe_support(df, f, y, self.getOrDefault(self.keepCount))
        elif kind == "logistic":
            kept = model_support(df, f, y, _plain_logistic(df.count(), f, y), t)
        elif kind == "forest":
            forest = RandomForestClassifier if self.getOrDefault(self.classes) else RandomForestRegressor
            est = forest(featuresCol=f, labelCol=y, numTrees=50, maxDepth=5, seed=self.getOrDefault(self.seed))
            kept = model_support(df, f, y, est, t)
        else:
            raise ConfigurationError("unknown selector", kind=kind)
        return VectorSlicer(inputCol=f, outputCol=self.getOutputCol(), indices=kept or [0])


def _shares(values: np.ndarray) -> np.ndarray:
    return values / values.sum() if values.sum() > 0 else np.zeros(len(values))


def _components(share: np.ndarray, want: float) -> int:
    """A count, or the fewest components whose cumulative share exceeds a fraction."""
    return min(len(share), int(want) if want >= 1 else int(np.searchsorted(np.cumsum(share), want, side="right")) + 1)


class PcaReduce(_Stage, HasInputCol, HasOutputCol):
    """Principal components: a count, or the fewest whose cumulative variance share exceeds a fraction."""

    components = Param(Params._dummy(), "components", "count (>= 1) or variance share (< 1)", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, components=0.95):
        super().__init__()
        self._setDefault(components=0.95)
        self._keep(self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearMap:
        _, mean, cov = covariance(df, self.getInputCol())
        values, rows = spectrum(cov)
        k = _components(_shares(values), self.getOrDefault(self.components))
        return LinearMap.of(rows[:k], self.getInputCol(), self.getOutputCol(), mean)


class LevelVectors(_Stage, HasInputCols, HasOutputCol):
    """Sparse 0/1 vectors of text columns: sorted levels, unseen and null are all zero."""

    dropFirst = Param(Params._dummy(), "dropFirst", "leave out the first level", TypeConverters.toBoolean)
    maxLevels = Param(Params._dummy(), "maxLevels", "widest level set accepted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, dropFirst=False, maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(dropFirst=False, maxLevels=MAX_LEVELS)
        self._keep(self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        cols = self.getInputCols()
        codes, vecs = [f"{c}__code" for c in cols], [f"{c}__vec" for c in cols]
        indexer = BoundedIndexer(inputCols=cols, outputCols=codes, maxLevels=self.getOrDefault(self.maxLevels)).fit(df)
        # the last slot belongs to unseen values and is the one dropped
        encoder = OneHotEncoder(inputCols=codes, outputCols=vecs, dropLast=True).fit(indexer.transform(df))
        stages, parts = [indexer, encoder], vecs
        if self.getOrDefault(self.dropFirst):
            parts = []
            for c, v, levels in zip(cols, vecs, indexer.labelsArray):
                if len(levels) > 1:
                    stages.append(VectorSlicer(inputCol=v, outputCol=f"{c}__tail", indices=list(range(1, len(levels)))))
                    parts.append(f"{c}__tail")
        stages.append(VectorAssembler(inputCols=parts, outputCol=self.getOutputCol()))
        return PipelineModel(stages=stages)


def pca_report(df: DataFrame, features: str, components: float = 0.95, whiten: bool = False):
    """Centred projection of a vector column.

    Returns ``(projected, spectrum, metrics)``: the input with ``pca`` added, ``(component, ratio, cumulative,
    singular_value)``, and one row ``(reconstruction_rmse, explained_variance, n_components)``.
    """
    from pyspark.ml.functions import vector_to_array

    spark, p = df.sparkSession, vector_size(df, features)
    n, mean, cov = covariance(df, features)
    values, rows = spectrum(cov)
    ratio = _shares(values)
    share, k = np.cumsum(ratio), _components(ratio, components)
    kept = LinearMap.of(rows[:k], features, "pca", mean).transform(df)
    # unit vectors make the projection orthogonal: what is lost is the length not explained
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    centred = F.zip_with(vector_to_array(F.col(features)), F.lit(mean.tolist()), lambda a, b: a - b)
    lost = kept.agg(F.sqrt(F.avg(F.greatest(square(centred) - square(vector_to_array(F.col("pca"))), F.lit(0.0))) / p).alias("reconstruction_rmse"))
    metrics = lost.withColumns({"explained_variance": F.lit(float(share[k - 1])), "n_components": F.lit(k)})
    if whiten:
        kept = LinearMap.of(rows[:k] / np.sqrt(np.maximum(values[:k], 1e-300))[:, None], features, "pca", mean).transform(df)
    singular = np.sqrt(values * max(n - 1, 0))
    table = spark.createDataFrame(
        [(i, float(ratio[i]), float(share[i]), float(singular[i])) for i in range(k)],
        "component int, ratio double, cumulative double, singular_value double",
    )
    return kept, table, metrics


__all__ = [
    "LevelVectors", "ModelSelect", "PcaReduce", "UnivariateSelect", "feature_names", "model_support", "pca_report",
    "rfe_support", "vector_size",
]
