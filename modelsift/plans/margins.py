"""Support vector machines: exact kernels in the dual, or linear machines on explicit feature maps.

``solver="dual"`` (default) solves the kernel problems themselves, one per pair of classes; its passes and support rows grow with
the table, as for any kernel machine.  ``solver="features"`` is for tables beyond that: the rbf kernel becomes random Fourier features
(Rahimi and Recht 2007), the cubic kernel its expansion or random products, classes run one against the rest, and results are
approximate.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..operators.kernel_dual import Dual, Solved, solve
from ..operators.reduce import vector_size
from .base import FEATURES, FOLD, LABEL, Candidate, balanced, branch_stages, class_scores, error_scores, parallel
from .kernels import KernelMachine, fit_sigmoids
from .registry import register_model
from .tuning import Choice, FloatRange, Search, tpe_search

MAPPED, FOURIER = "mapped", 256
MAX_CUBIC, CUBIC = 5000, 2048  # monomials that are written out at most; random features that stand for more
EPSILON = 0.1  # fixed value: half width of the regression tube


class FourierFeatures(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2/D) cos(Wx + b), whose inner products estimate exp(-gamma |x - y|^2).  W and b follow from the seed."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(gamma=1.0, size=FOURIER, seed=42, inputCol=FEATURES, outputCol=MAPPED)

    @classmethod
    def of(cls, gamma: float, seed: int, size: int = FOURIER):
        m = cls()
        m._set(gamma=float(gamma), seed=seed, size=size)
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.stack(x.to_numpy())
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, math.sqrt(2 * gamma), (size, m.shape[1]))
            b = rng.uniform(0, 2 * math.pi, size)
            return pd.Series(list(math.sqrt(2 / size) * np.cos(m @ w.T + b)))

        return df.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(F.col(self.getInputCol())))))


class CubicFeatures(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Products of three random sign projections of (sqrt(gamma) x, 1) over sqrt(D).

    Their inner products estimate (gamma x.y + 1)^3 without bias, so a wide table needs no cubic expansion: approximate, with a
    size that does not depend on the number of columns.  The signs follow from the seed.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(gamma=1.0, size=CUBIC, seed=42, inputCol=FEATURES, outputCol=MAPPED)

    @classmethod
    def of(cls, gamma: float, seed: int, size: int = CUBIC):
        m = cls()
        m._set(gamma=float(gamma), seed=seed, size=size)
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = math.sqrt(gamma) * np.stack(x.to_numpy())
            m = np.concatenate((m, np.ones((len(m), 1))), axis=1)
            rng, out = np.random.default_rng(seed), np.full((len(m), size), 1 / math.sqrt(size))
            for _ in range(3):
                out *= m @ (2.0 * rng.integers(0, 2, (m.shape[1], size)) - 1)
            return pd.Series(list(out))

        return df.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(F.col(self.getInputCol())))))


class ScaleVector(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    factor = Param(Params._dummy(), "factor", "multiplier", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(factor=1.0)

    @classmethod
    def of(cls, factor: float, source: str, out: str):
        m = cls()
        m._set(factor=float(factor), inputCol=source, outputCol=out)
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.getOrDefault(self.factor)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.transform(vector_to_array(F.col(self.getInputCol())), lambda v: v * f)))


class Platt(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Class margins to probabilities: a fitted sigmoid per class, normalised."""

    stats = Param(Params._dummy(), "stats", "slope and offset per class as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(stats="[]")

    @classmethod
    def of(cls, pairs: list[tuple[float, float]]):
        m = cls()
        m._set(stats=json.dumps(pairs))
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = json.loads(self.getOrDefault(self.stats))
        m = vector_to_array(F.col("rawPrediction"))
        if len(pairs) == 1:  # two classes share one sigmoid
            p = 1 / (1 + F.exp(-(F.lit(pairs[0][0]) * F.get(m, F.lit(1)) + F.lit(pairs[0][1]))))
            shares = F.array(1 - p, p)
        else:
            raw = F.array(*[1 / (1 + F.exp(-(F.lit(a) * F.get(m, F.lit(c)) + F.lit(b)))) for c, (a, b) in enumerate(pairs)])
            total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
            shares = F.transform(raw, lambda v: v / total)
        return df.withColumn("probability", array_to_vector(shares))


def kernel_width(frame: DataFrame, gamma) -> float:
    """``auto``: one over the number of features, ``scale``: that over the variance of all entries, or a number."""
    p = max(vector_size(frame, FEATURES), 1)
    if gamma == "auto":
        return 1.0 / p
    if gamma != "scale":
        return float(gamma)
    s = frame.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(FEATURES)).alias("s")).first()["s"]
    mean = s["mean"].toArray()
    var = float((s["variance"].toArray() * (s["count"] - 1) / max(s["count"], 1) + (mean - mean.mean()) ** 2).mean())
    return 1.0 / (p * var) if var > 0 else 1.0


def feature_map(frame: DataFrame, kernel: str, gamma, seed: int):
    """Transformer from ``features`` to ``mapped``."""
    p, width = max(vector_size(frame, FEATURES), 1), kernel_width(frame, gamma)
    if kernel == "linear":
        return VectorAssembler(inputCols=[FEATURES], outputCol=MAPPED)
    if kernel == "rbf":
        return FourierFeatures.of(width, seed)
    if kernel == "poly":
        if math.comb(p + 3, 3) > MAX_CUBIC:
            return CubicFeatures.of(width, seed)
        return PipelineModel(stages=[
            ScaleVector.of(math.sqrt(width), FEATURES, "_narrow"), PolynomialExpansion(degree=3, inputCol="_narrow", outputCol=MAPPED),
        ])
    raise ConfigurationError("unknown kernel", kernel=kernel)


def fit_svr(frame: DataFrame, c: float, epsilon: float = EPSILON, rounds: int = 12, tol: float = 1e-4):
    """Linear epsilon-insensitive regression by iteratively reweighted least squares.

    A row outside the tube by d enters a weighted ridge regression with weight C/d and its target moved to the tube
    edge; rows inside the tube have no weight.  Each round is one pass over the rows.
    """
    step = lambda d, reg: LinearRegression(
        featuresCol=MAPPED, labelCol="_t", weightCol="_w", regParam=reg, elasticNetParam=0.0, standardization=False, solver="auto",
    ).fit(d)
    data = frame.select(MAPPED, LABEL)
    sd0 = data.agg(F.stddev_pop(LABEL)).first()[0] or 1.0
    floor = 1e-3 * sd0  # keeps weights finite on the tube edge
    n = data.count()
    model = step(data.withColumns({"_t": F.col(LABEL), "_w": F.lit(1.0)}), sd0 / (c * n))
    best, best_loss = model, math.inf
    for _ in range(rounds):
        r = F.col(LABEL) - F.col("_p")
        out = F.abs(r) - epsilon
        scored = model.setPredictionCol("_p").transform(data).withColumns({
            "_w": F.when(out > 0, F.lit(c) / F.greatest(out, F.lit(floor))).otherwise(F.lit(0.0)), "_t": F.col(LABEL) - F.signum(r) * epsilon,
        }).select(MAPPED, LABEL, "_t", "_w", out.alias("_o"))
        s = scored.agg(
            F.sum("_w").alias("w"), F.sum(F.greatest("_o", F.lit(0.0))).alias("loss"),
            F.sum(F.col("_w") * F.col("_t")).alias("m1"), F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("m2"),
        ).first()
        coef = model.coefficients.toArray()
        loss = c * s["loss"] + 0.5 * float(coef @ coef)
        if loss < best_loss:
            gain, best, best_loss = best_loss - loss, model, loss
            if gain < tol * max(abs(loss), 1e-12):
                break
        else:
            break
        if not s["w"]:
            break
        sd = math.sqrt(max(s["m2"] / s["w"] - (s["m1"] / s["w"]) ** 2, 0.0)) or 1.0
        model = step(scored.filter("_w > 0"), sd / s["w"])
    return best


@register_model("both")
class Svm(Candidate):
    name = "SVM"
    # fixed values: the default search ranges
    defaults = {"kernel": ("linear", "rbf", "poly"), "C": (0.1, 100.0), "gamma": ("scale", "auto"), "scaler": "standard", "pca_components": 0.95, "n_iter": 10, "solver": "dual", "rounds": 1000, "max_iter": 50}
    descriptions = {"C": "inverse strength of the penalty", "kernel": "inner product of rows", "gamma": "reach of one row"}

    def __init__(self, problem, config=None):
        super().__init__(problem, config)
        self.name = self.label_for(problem.task)

    @classmethod
    def label_for(cls, task):
        return f"SVM ({task.capitalize()})"

    def stages(self) -> list:
        c = self.config
        reduce = ("pca", c["pca_components"]) if c["pca_components"] is not None else None
        return branch_stages(self.problem, scaler="minmax" if c["scaler"] == "minmax" else "standard", reduce=reduce)

    def run_search(self, evaluate) -> Search:
        c = self.config
        kernels = [k for k in c["kernel"] if k in ("linear", "rbf", "poly")]
        gammas = [g for g in c["gamma"] if isinstance(g, str)] or ["scale"]
        space = {"kernel": Choice(kernels), "C": FloatRange(min(c["C"]), max(c["C"]), log=True), "gamma": Choice(gammas)}
        return tpe_search(space, evaluate, c["n_iter"], seed=self.problem.seed)

    def _fit(self, frame: DataFrame, s: dict) -> PipelineModel:
        lift = feature_map(frame, s["kernel"], s["gamma"], self.problem.seed)
        if not self.problem.is_classification:
            return PipelineModel(stages=[lift, fit_svr(lift.transform(frame), s["C"]).setPredictionCol("prediction")])
        weighted = lift.transform(balanced(frame))
        n = weighted.count()  # balanced weights add up to the row count
        svc = LinearSVC(
            featuresCol=MAPPED, labelCol=LABEL, weightCol="weight", regParam=1.0 / (s["C"] * n), standardization=False, maxIter=self.config["max_iter"]
        )
        if self.problem.n_classes > 2:
            svc = OneVsRest(
                classifier=svc, featuresCol=MAPPED, labelCol=LABEL, weightCol="weight", rawPredictionCol="rawPrediction",
                parallelism=self.config["parallelism"],
            )
        return PipelineModel(stages=[lift, svc.fit(weighted)])

    def _predicted(self, models: list, valid: DataFrame) -> DataFrame:
        out = valid.select(LABEL, FEATURES)
        for i, m in enumerate(models):
            done = m.transform(out).withColumnRenamed("prediction", f"p{i}")
            out = done.select(LABEL, FEATURES, *[f"p{j}" for j in range(i + 1)])
        return out.select(LABEL, F.inline(F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"p{i}").alias("p")) for i in range(len(models))])))

    # --- exact machines

    def _pairs(self) -> list[tuple[int, int] | None]:
        k = self.problem.n_classes
        return [(a, b) for a in range(k) for b in range(a + 1, k)] if self.problem.is_classification else [None]

    def _duals(self, frame: DataFrame, settings: list[dict]) -> list[Dual]:
        """A problem per setting and pair of classes, with balanced class weights."""
        widths = {g: kernel_width(frame, g) for g in {s["gamma"] for s in settings}}
        weights = {}
        if self.problem.is_classification:
            counts = {int(r[LABEL]): r["count"] for r in frame.groupBy(LABEL).count().collect()}  # one row per class
            weights = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}
        unknown = {s["kernel"] for s in settings} - {"linear", "rbf", "poly"}
        if unknown:
            raise ConfigurationError("unknown kernel", kernel=", ".join(map(str, unknown)))
        return [
            Dual(s["kernel"], widths[s["gamma"]], s["C"], p, (weights.get(p[0], 1.0), weights.get(p[1], 1.0)) if p else (1.0, 1.0), EPSILON)
            for s in settings for p in self._pairs()
        ]

    def _solve(self, frame: DataFrame, settings: list[dict]) -> tuple[Solved, list[Dual], list[list[int]]]:
        duals, each = self._duals(frame, settings), len(self._pairs())
        solved = solve(frame.select(LABEL, FEATURES), duals, LABEL, FEATURES, self.config["rounds"])
        return solved, duals, [list(range(i * each, (i + 1) * each)) for i in range(len(settings))]

    def _curves(self, frame: DataFrame, setting: dict) -> list[tuple[float, float]]:
        """Sigmoids per pair, fitted on scores of rows the scoring machine had not seen."""
        pairs = self._pairs()

        def one(f: int) -> DataFrame:
            solved, duals, (own,) = self._solve(frame.filter(F.col(FOLD) != f), [setting])
            scored = KernelMachine.of(solved, duals, own, self.problem.n_classes).scores(frame.filter(F.col(FOLD) == f).select(LABEL, FEATURES))
            return scored.select(LABEL, F.posexplode("scores").alias("pair", "f"))

        parts = parallel([lambda f=f: one(f) for f in range(self.problem.folds)], self.config["parallelism"])
        long = parts[0]
        for part in parts[1:]:
            long = long.unionAll(part)
        first, second = (F.get(F.lit([p[i] for p in pairs]), F.col("pair")) for i in (0, 1))
        return fit_sigmoids(long.where((F.col(LABEL) == first) | (F.col(LABEL) == second)).select("pair", (F.col(LABEL) == first).alias("positive"), "f"), len(pairs))

    def score(self, train, valid, settings):
        if self.config["solver"] == "dual":
            solved, duals, groups = self._solve(train, settings)
            long = self._predicted([KernelMachine.of(solved, duals, own, self.problem.n_classes) for own in groups], valid)
            found = class_scores(long) if self.problem.is_classification else error_scores(long)
            return [found.get(i, -math.inf) for i in range(len(settings))]

        def attempt(s: dict):
            try:
                return self._fit(train, s)
            except ConfigurationError:
                return None

        models = parallel([lambda s=s: attempt(s) for s in settings], self.config["parallelism"])
        good = [i for i, m in enumerate(models) if m is not None]
        scores = [-math.inf] * len(settings)
        if good:
            long = self._predicted([models[i] for i in good], valid)
            found = class_scores(long) if self.problem.is_classification else error_scores(long)
            for j, i in enumerate(good):
                scores[i] = found.get(j, -math.inf)
        return scores

    def _sigmoids(self, frame: DataFrame, s: dict) -> list[tuple[float, float]]:
        """Sigmoids fitted on margins of rows the margin model had not seen."""
        folds = parallel(
            [lambda f=f: self._fit(frame.filter(F.col(FOLD) != f), s) for f in range(self.problem.folds)], self.config["parallelism"]
        )
        margins = None
        for f, m in enumerate(folds):
            part = m.transform(frame.filter(F.col(FOLD) == f)).select(LABEL, vector_to_array(F.col("rawPrediction")).alias("m"))
            margins = part if margins is None else margins.unionAll(part)
        k = self.problem.n_classes

        def sigmoid(c: int) -> tuple[float, float]:
            one = margins.select((F.col(LABEL) == c).cast("double").alias("y"), F.get("m", F.lit(c)).alias("m"))
            lr = LogisticRegression(featuresCol="x", labelCol="y", standardization=False).fit(VectorAssembler(inputCols=["m"], outputCol="x").transform(one))
            return float(lr.coefficients[0]), float(lr.intercept)

        return parallel([lambda c=c: sigmoid(c) for c in ([1] if k == 2 else range(k))], self.config["parallelism"])

    def build(self, frame, setting):
        self.solved = None
        if self.config["solver"] == "dual":
            curves = self._curves(frame, setting) if self.problem.is_classification else None
            self.solved, duals, (own,) = self._solve(frame, [setting])
            return KernelMachine.of(self.solved, duals, own, self.problem.n_classes, curves)
        self.margin = self._fit(frame, setting)
        self.support = support_table(self.margin, frame, self.problem)
        if not self.problem.is_classification:
            return self.margin
        return PipelineModel(stages=[*self.margin.stages, Platt.of(self._sigmoids(frame, setting))])

    def _named_support(self) -> DataFrame:
        """Support rows with the names of their pair and class."""
        rows = self.solved.support
        if not self.problem.is_classification:
            return rows.select(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"), F.lit("all").alias("class"), "id", (F.col("plus") - F.col("minus")).alias("coefficient"), (F.col("plus") + F.col("minus")).alias("multiplier"), "x")
        names, pairs = F.lit([str(c) for c in self.problem.classes]), self._pairs()
        ends = [F.get(names, F.get(F.lit([p[i] for p in pairs]), F.col("problem"))) for i in (0, 1)]
        return rows.select(
            ends[0].alias("first"), ends[1].alias("second"), F.get(names, F.col("label").cast("int")).alias("class"), "id",
            (F.col("plus") - F.col("minus")).alias("coefficient"), (F.col("plus") + F.col("minus")).alias("multiplier"), "x",
        )

    def tailored(self, spark):
        """Support rows with their multipliers and counts per class, and the weights of linear machines, for each pair of classes."""
        self._fitted()
        if self.solved is not None:
            rows = self._named_support()
            out = {"support_rows": rows, "support_counts": rows.groupBy("class").agg(F.count_distinct("id").alias("n"))}
            if self.best["kernel"] == "linear":
                weights = rows.select("first", "second", "coefficient", F.posexplode("x").alias("i", "v")).groupBy("first", "second", "i").agg(F.sum(F.col("coefficient") * F.col("v")).alias("coefficient"))
                out["coefficients"] = weights.select("first", "second", F.get(F.lit(list(self.feature_names)), F.col("i")).alias("feature"), "coefficient")
            return out
        out = {"support_counts": self.support}
        last = self.margin.stages[-1]
        if self.best["kernel"] == "linear":
            models = last.models if hasattr(last, "models") else [last]
            rows = [(str(self.problem.classes[c]) if len(models) > 1 else None, n, float(v)) for c, m in enumerate(models) for n, v in zip(self.feature_names, m.coefficients.toArray())]
            out["coefficients"] = spark.createDataFrame(rows, "class string, feature string, coefficient double")
        return out


def support_rows(model: PipelineModel, frame: DataFrame, problem) -> DataFrame:
    """Rows on or inside the margin (outside or on the tube for regression)."""
    done = model.transform(frame)
    if not problem.is_classification:
        return done.filter(F.abs(F.col(LABEL) - F.col("prediction")) >= EPSILON).select(LABEL, FEATURES)
    own = F.get(vector_to_array(F.col("rawPrediction")), F.col(LABEL).cast("int"))
    return done.filter(own <= 1).select(LABEL, FEATURES)


def support_table(model: PipelineModel, frame: DataFrame, problem) -> DataFrame:
    """``(class, n)`` support rows per class, or one row for regression."""
    rows = support_rows(model, frame, problem)
    if problem.is_classification:
        found = rows.groupBy(LABEL).count().collect()
        table = [(str(problem.classes[int(r[LABEL])]), r["count"]) for r in found]
    else:
        table = [("all", rows.count())]
    return frame.sparkSession.createDataFrame(table, "class string, n bigint")
