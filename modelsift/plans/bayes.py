"""Gaussian and multinomial naive Bayes."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..operators.metrics import averaged, per_class
from .base import FEATURES, LABEL, Candidate, branch_stages
from .registry import register_model
from .tuning import Search, grid_search


def class_moments(df: DataFrame) -> dict:
    """Per class: rows, means and population variances; plus the largest overall feature variance."""
    per = df.groupBy(LABEL).agg(Summarizer.metrics("count", "mean", "variance").summary(F.col(FEATURES)).alias("s")).orderBy(LABEL).collect()
    counts = np.array([r["s"]["count"] for r in per], float)
    means = np.array([r["s"]["mean"].toArray() for r in per])
    var = np.array([r["s"]["variance"].toArray() * (r["s"]["count"] - 1) / r["s"]["count"] for r in per])
    grand = counts @ means / counts.sum()
    overall = counts @ (var + (means - grand) ** 2) / counts.sum()
    return {"codes": [float(r[LABEL]) for r in per], "counts": counts, "means": means, "var": var, "top": float(overall.max())}


WRITTEN_OUT = 200  # most terms of all classes written out as plain arithmetic, which is compiled; a longer sum runs over the array


def _spreads(stats: dict, smoothing: float) -> np.ndarray:
    return np.maximum(stats["var"] + smoothing * stats["top"], 1e-300)


def _joint(x: Column, stats: dict, smoothing: float) -> list[Column]:
    """Log joint density of each class, summed over the feature array from its first element on."""
    prior = np.log(stats["counts"] / stats["counts"].sum())
    var = _spreads(stats, smoothing)
    out = []
    for c in range(len(prior)):
        const = prior[c] - 0.5 * float(np.sum(np.log(2 * math.pi * var[c])))
        if var.size <= WRITTEN_OUT:
            total = F.lit(0.0)
            for j, (m, h) in enumerate(zip(stats["means"][c], 0.5 / var[c])):
                away = F.get(x, F.lit(j)) - F.lit(float(m))
                total = total + away * away * F.lit(float(h))
            out.append(F.lit(const) - total)
            continue
        pars = F.arrays_zip(F.lit([float(v) for v in stats["means"][c]]).alias("m"), F.lit([float(v) for v in 0.5 / var[c]]).alias("h"))
        terms = F.zip_with(x, pars, lambda v, p: (v - p["m"]) * (v - p["m"]) * p["h"])
        out.append(F.lit(const) - F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    return out


Joint = Callable[[np.ndarray], Iterable[np.ndarray]]  # feature rows to a (rows, settings) array of each class


def _gaussian_joint(stats: dict, smoothings: list[float]) -> Joint:
    """The sums of ``_joint``, in the same order, for many smoothings at once."""
    prior, means = np.log(stats["counts"] / stats["counts"].sum()), stats["means"]
    var = np.stack([_spreads(stats, s) for s in smoothings])
    const, half = prior - 0.5 * np.log(2 * math.pi * var).sum(2), 0.5 / var

    def joint(x: np.ndarray) -> Iterator[np.ndarray]:
        for c in range(len(prior)):
            total = np.zeros((len(x), len(var)))
            for j in range(x.shape[1]):
                away = x[:, j] - means[c, j]
                total += (away * away)[:, None] * half[:, c, j]
            yield const[:, c] - total

    return joint


def _multinomial_joint(counts: np.ndarray, sums: np.ndarray, smoothings: list[float]) -> Joint:
    """Smoothed shares as ``pyspark.ml`` fits them, from the rows and feature sums of each class."""
    a = np.array(smoothings)[:, None, None]
    theta = np.log(sums + a) - np.log(sums.sum(1, keepdims=True) + a * sums.shape[1])
    pi = np.log(counts + a[:, 0]) - np.log(counts.sum() + a[:, 0] * len(counts))

    def joint(x: np.ndarray) -> Iterator[np.ndarray]:
        x = np.maximum(x, 0.0)  # min-max scaled validation rows may fall below zero
        for c in range(len(counts)):
            total = np.zeros((len(x), len(a)))
            for j in range(x.shape[1]):
                total += x[:, j : j + 1] * theta[:, c, j]
            yield total + pi[:, c]

    return joint


def _tally(joint: Joint, codes: list[float]) -> Callable:
    """Arrow batches of ``(label, x)`` to counts ``(setting, y, p, n)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            best = top = None
            for c, v in enumerate(joint(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))):
                if top is None:
                    best, top = np.zeros(v.shape, np.int64), v
                    continue
                more = (v > top) | (np.isnan(v) & ~np.isnan(top))  # the first of equals; not-a-number comes last in Spark's order
                best, top = np.where(more, c, best), np.where(more, v, top)
            cells = len(label) * len(codes)
            n = np.stack([np.bincount(at * len(codes) + best[:, s], minlength=cells) for s in range(best.shape[1])])
            setting, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(setting, pa.int32()), pa.array(label[cell // len(codes)]), pa.array(np.array(codes)[cell % len(codes)]), pa.array(n[setting, cell])],
                names=["setting", "y", "p", "n"],
            )

    return counted


def _scored(valid: DataFrame, joint: Joint, codes: list[float], settings: int) -> list[float]:
    """Weighted F1 of every setting; one scan, whose tasks hand on class-sized counts."""
    rows = valid.select(F.col(LABEL).cast("double"), vector_to_array(F.col(FEATURES)).alias("x"))
    counts = rows.mapInArrow(_tally(joint, codes), "setting int, y double, p double, n bigint").groupBy("setting", "y", "p").agg(F.sum("n").alias("n"))
    table = averaged(per_class(counts, ["setting"]), "weighted", ["setting"])
    found = {r["setting"]: r["f1"] for r in table.collect()}
    return [found.get(i, -math.inf) for i in range(settings)]


def class_sums(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature sums of each class, in label order."""
    per = df.groupBy(LABEL).agg(Summarizer.metrics("count", "sum").summary(F.col(FEATURES)).alias("s")).orderBy(LABEL).collect()
    return np.array([r["s"]["count"] for r in per], float), np.array([r["s"]["sum"].toArray() for r in per])


class GaussianNBModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "class statistics as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(stats="{}", featuresCol=FEATURES)

    @classmethod
    def of(cls, stats: dict, smoothing: float, n_classes: int):
        m = cls()
        plain = {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in stats.items()}
        m._set(stats=json.dumps({**plain, "smoothing": smoothing, "n_classes": n_classes}))
        return m

    def fitted(self) -> dict:
        st = json.loads(self.getOrDefault(self.stats))
        return {k: np.array(v) if k in ("counts", "means", "var") else v for k, v in st.items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.fitted()
        joint = F.array(*_joint(vector_to_array(F.col(self.getFeaturesCol())), st, st["smoothing"]))
        out = df.withColumn("_joint", joint)
        shifted = F.transform("_joint", lambda v: F.exp(v - F.array_max("_joint")))
        total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
        # codes absent from the training rows keep a zero probability
        place = {int(c): i for i, c in enumerate(st["codes"])}
        shares = F.array(*[F.get(shifted, F.lit(place[c])) / total if c in place else F.lit(0.0) for c in range(st["n_classes"])])
        return out.withColumns({
            "probability": array_to_vector(shares),
            "prediction": F.get(F.lit(st["codes"]), (F.array_position("_joint", F.array_max("_joint")) - 1).cast("int")),
        }).drop("_joint")


@register_model("classification")
class NaiveBayesCandidate(Candidate):
    """``model_type`` gaussian (default) or multinomial.

    One aggregate over a fold fits every setting and one scan scores them all, so no preprocessed frame is held.
    """

    name = "Naive Bayes"
    keyed = False
    # fixed values: the default grids
    defaults = {
        "model_type": "gaussian", "var_smoothing": [10.0**-i for i in range(10)], "alpha": [0.01, 0.1, 0.5, 1.0, 5.0, 10.0], "scaler": "standard",
        "feature_selection": "k_best", "k_best": 10, "k_best_score_func": "f_classif",
    }
    descriptions = {"var_smoothing": "share of the largest variance added to every variance", "alpha": "additive smoothing of the counts"}

    def __init__(self, problem, config=None):
        super().__init__(problem, config)
        if self.config["model_type"] not in ("gaussian", "multinomial"):
            raise ConfigurationError("unknown naive Bayes type", model_type=self.config["model_type"])
        self.gaussian = self.config["model_type"] == "gaussian"
        self.name = f"Naive Bayes ({self.config['model_type'].capitalize()})"

    @classmethod
    def label_for(cls, task):
        return "Naive Bayes (Gaussian)"

    def stages(self) -> list:
        c = self.config
        select = (c["k_best_score_func"], c["k_best"]) if c["feature_selection"] == "k_best" else None
        if self.gaussian:
            scaler = "minmax" if c["scaler"] == "minmax" else "standard"
            return branch_stages(self.problem, impute="mean", power="yeo-johnson", scaler=scaler, select=select)
        return branch_stages(self.problem, impute="median", scaler="minmax", select=select)

    def held(self, frame) -> bool:
        return False

    def run_search(self, evaluate) -> Search:
        key = "var_smoothing" if self.gaussian else "alpha"
        return grid_search({key: self.config[key]}, evaluate)

    def _multinomial(self, frame: DataFrame, s: dict):
        return NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="multinomial", smoothing=s["alpha"]).fit(frame)

    def score(self, train, valid, settings):
        if not self.gaussian:
            counts, sums = class_sums(train)
            return _scored(valid, _multinomial_joint(counts, sums, [s["alpha"] for s in settings]), [float(c) for c in range(len(counts))], len(settings))
        stats = class_moments(train)
        return _scored(valid, _gaussian_joint(stats, [s["var_smoothing"] for s in settings]), stats["codes"], len(settings))

    def build(self, frame, setting):
        if self.gaussian:
            self.stats = class_moments(frame)
            return GaussianNBModel.of(self.stats, setting["var_smoothing"], self.problem.n_classes)
        self.bayes = self._multinomial(frame, setting)
        from pyspark.ml import PipelineModel

        return PipelineModel(stages=[ClipModel.of(), self.bayes])

    def tailored(self, spark):
        self._fitted()
        classes = self.problem.classes
        if self.gaussian:
            st = self.stats
            prior = np.log(st["counts"] / st["counts"].sum())
            rows = [
                (str(classes[int(c)]), n, float(st["means"][i][j]), float(st["var"][i][j]))
                for i, c in enumerate(st["codes"]) for j, n in enumerate(self.feature_names)
            ]
            table = spark.createDataFrame(rows, "class string, feature string, mean double, variance double")
            codes = st["codes"]
        else:
            theta, prior = self.bayes.theta.toArray(), self.bayes.pi.toArray()
            rows = [(str(classes[i]), n, float(theta[i][j])) for i in range(len(prior)) for j, n in enumerate(self.feature_names)]
            table = spark.createDataFrame(rows, "class string, feature string, log_probability double")
            codes = range(len(prior))
        priors = spark.createDataFrame([(str(classes[int(c)]), float(p)) for c, p in zip(codes, prior)], "class string, log_prior double")
        return {"features": table, "class_log_prior": priors, "model_type": spark.createDataFrame([(self.config["model_type"],)], "model_type string")}


def _clipped(df: DataFrame) -> DataFrame:
    return df.withColumn(FEATURES, array_to_vector(F.transform(vector_to_array(F.col(FEATURES)), lambda v: F.greatest(v, F.lit(0.0)))))


class ClipModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Raises negative features to zero."""

    @classmethod
    def of(cls):
        return cls()

    def _transform(self, df: DataFrame) -> DataFrame:
        return _clipped(df)
