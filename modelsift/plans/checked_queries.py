"""Queries that hold the models, the tuners and the projections against closed forms in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import split
from ..operators.projection import covariance, spectrum
from ..operators.scale import Scaler
from ..sources.tables import read_table
from . import tuning
from .base import FEATURES, FOLD, LABEL
from .bayes import NaiveBayesCandidate
from .linear import ElasticNet, moments, solve_elastic_net
from .registered import query, rounded

_GRID = {k: ElasticNet.defaults[k] for k in ("alpha", "l1_ratio")}
_SETTINGS = ", ".join(f"({a}::double, {r}::double)" for a in _GRID["alpha"] for r in _GRID["l1_ratio"])


@query(
    "grid_search_path",
    "with b as (select o_custkey::double as x, o_totalprice as y, (row_number() over (order by md5(cast(o_orderkey as varchar) || '|42')) - 1) * 3 // count(*) over () as f from orders), "
    "t as (select v.f, avg(b.x) as mx, avg(b.y) as my, stddev_pop(b.x) as sx, covar_pop(b.x, b.y) / stddev_pop(b.x) as c from (select distinct f from b) v join b on b.f <> v.f group by v.f), "
    f"g as (select * from (values {_SETTINGS}) q(alpha, l1_ratio)), "
    "w as (select alpha, l1_ratio, t.*, sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) as w from t, g), "
    "e as (select alpha, l1_ratio, w.f, avg(power(b.y - my - w * (b.x - mx) / sx, 2)) as mse from w join b on b.f = w.f group by 1, 2, 3) "
    "select alpha, l1_ratio, round(sqrt(avg(mse)), 4) as error from e group by 1, 2",
)
def grid_search_path(spark, sf):
    """Every setting of the default grid on one feature, whose elastic net has a closed form in each fold."""
    df = split.fold_column(read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")), 3, "o_orderkey", output=FOLD)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") ** 2), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") ** 2))]]
    folds = {r[FOLD]: np.array([r[k] for k in ("n", "x", "y", "xx", "xy", "yy")], float) for r in df.groupBy(FOLD).agg(*sums).collect()}
    whole = sum(folds.values())

    def evaluate(settings: list[dict]) -> list[float]:
        total = np.zeros(len(settings))
        for v in folds.values():
            n, x, y, xx, xy, yy = (whole - v) / (whole - v)[0]
            sd = np.sqrt(xx - x * x)
            m = v / v[0]
            for i, s in enumerate(settings):
                w = solve_elastic_net(np.ones((1, 1)), np.array([(xy - x * y) / sd]), s["alpha"] * s["l1_ratio"], s["alpha"] * (1 - s["l1_ratio"]))[0] / sd
                b = y - w * x
                total[i] -= (m[5] - 2 * w * m[4] - 2 * b * m[2] + w * w * m[3] + 2 * w * b * m[1] + b * b) / len(folds)
        return list(total)

    found = tuning.grid_search(_GRID, evaluate)
    rows = [(float(s["alpha"]), float(s["l1_ratio"]), float(np.sqrt(-v))) for s, v in found.trials]
    return rounded(spark.createDataFrame(rows, "alpha double, l1_ratio double, error double"), error=4)


@query(
    "ridge_two_features",
    "with m as (select var_pop(l_quantity) + 0.5 as a, covar_pop(l_quantity, l_tax * 100) as b, var_pop(l_tax * 100) + 0.5 as d, covar_pop(l_quantity, l_extendedprice) as p, covar_pop(l_tax * 100, l_extendedprice) as q from lineitem) "
    "select 'l_quantity' as feature, round((d * p - b * q) / (a * d - b * b), 4) as coefficient from m union all select 'tax', round((a * q - b * p) / (a * d - b * b), 4) from m",
)
def ridge_two_features(spark, sf):
    """The L2 penalty by normal equations."""
    li = read_table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("tax"), F.col("l_extendedprice").alias(LABEL))
    _, _, c = moments(VectorAssembler(inputCols=["l_quantity", "tax"], outputCol=FEATURES).transform(li))
    w = solve_elastic_net(c[:2, :2], c[:2, 2], 0.0, 0.5)
    return rounded(spark.createDataFrame([("l_quantity", float(w[0])), ("tax", float(w[1]))], "feature string, coefficient double"), coefficient=4)


@query(
    "pca_invariants",
    "with e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), "
    "r as (select a.i, b.i as j, corr(a.v, b.v) as r from e a join e b using (vec_id) group by 1, 2) "
    "select count(distinct i) as components, round(sum(r * r), 4) as squares from r",
)
def pca_invariants(spark, sf):
    """The squared eigenvalues sum to the squared norm of the correlation matrix."""
    cols = [f"e{i}" for i in range(64)]
    df = read_table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    scaled = VectorAssembler(inputCols=cols, outputCol=FEATURES).transform(Scaler(inputCols=cols).fit(df).transform(df))
    n, _, cov = covariance(scaled, FEATURES)
    values, _ = spectrum(cov * (n - 1) / n)
    return spark.createDataFrame([(len(values), round(float((values**2).sum()), 4))], "components bigint, squares double")


_COUNTS = {"quantity": "l_quantity", "line": "l_linenumber", "tax": "round(l_tax * 100)"}


@query(
    "multinomial_log_probabilities",
    "with s as (select l_linestatus as class, count(*) as n, " + ", ".join(f"sum({e})::double as {c}" for c, e in _COUNTS.items()) + " from lineitem group by 1), "
    "a as (select * from (values " + ", ".join(f"({float(x)}::double)" for x in NaiveBayesCandidate.defaults["alpha"]) + ") t(alpha)) "
    + " union all ".join(
        f"select alpha, class, '{c}' as feature, round(ln(({c} + alpha) / ({' + '.join(_COUNTS)} + {len(_COUNTS)} * alpha)), 6) as log_probability from s, a" for c in _COUNTS
    ),
)
def multinomial_log_probabilities(spark, sf):
    """The count model of every default smoothing."""
    li = read_table(spark, sf, "lineitem").select("l_linestatus", *[F.expr(e).cast("double").alias(c) for c, e in _COUNTS.items()])
    df = VectorAssembler(inputCols=list(_COUNTS), outputCol=FEATURES).transform(li).withColumn(LABEL, (F.col("l_linestatus") == "O").cast("double")).select(FEATURES, LABEL).persist()
    try:
        rows = []
        for a in NaiveBayesCandidate.defaults["alpha"]:
            theta = NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="multinomial", smoothing=float(a)).fit(df).theta.toArray()
            rows += [(float(a), "FO"[k], c, float(theta[k][j])) for k in range(2) for j, c in enumerate(_COUNTS)]
    finally:
        df.unpersist()
    return rounded(spark.createDataFrame(rows, "alpha double, class string, feature string, log_probability double"), log_probability=6)


@query("logistic_optimality", " union all ".join(f"select '{c}' as parameter, 0.0::double as gradient from (select count(*) from lineitem)" for c in ("l_quantity", "price", "intercept")))
def logistic_optimality(spark, sf):
    """The gradient of the penalised likelihood at the fitted coefficients, over all rows: zero at the optimum."""
    names = ["l_quantity", "price"]
    li = read_table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_linestatus") == "O").cast("double").alias(LABEL))
    df = VectorAssembler(inputCols=names, outputCol=FEATURES).transform(li).persist()
    try:
        n, penalty = df.count(), 0.01
        model = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=200, tol=1e-12, regParam=penalty, standardization=False).fit(df)
        gap = F.get(vector_to_array("probability"), F.lit(1)) - F.col(LABEL)
        x = vector_to_array(F.col(FEATURES))
        got = model.transform(df).agg(*[F.sum(gap * F.get(x, F.lit(i))).alias(c) for i, c in enumerate(names)], F.sum(gap).alias("intercept")).first()
    finally:
        df.unpersist()
    rows = [(c, round(got[c] / n + penalty * float(model.coefficients[i]), 4) + 0.0) for i, c in enumerate(names)] + [("intercept", round(got["intercept"] / n, 4) + 0.0)]
    return spark.createDataFrame(rows, "parameter string, gradient double")
