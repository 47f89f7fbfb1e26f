from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from modelsift import errors
from modelsift.operators import diagnostics, encode, impute, leakage, metrics, neighbours, order_stats, outliers, running, scale, schema, select, split
from modelsift.operators import profile as prof
from modelsift.sources.tables import read_csv


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def pairs(spark, y, p):
    return frame(spark, list(zip(map(float, y), map(float, p))), "y double, p double")


# --- order statistics and running totals


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.just(7.0), st.floats(-1e6, 1e6)), min_size=1, max_size=200), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantiles_match_numpy(spark, values, p):
    df = frame(spark, [(v,) for v in values], "v double")
    got = order_stats.quantiles(df, {"v": F.col("v")}, [p], accuracy=20, gather=5)["v"][0]
    assert got == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-9)


def test_quantiles_with_a_hot_value(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    want = df.agg(F.percentile("v", [0.1, 0.34, 0.5, 0.99]).alias("q")).first()["q"]
    assert order_stats.quantiles(df, {"v": F.col("v")}, [0.1, 0.34, 0.5, 0.99], accuracy=100, gather=200)["v"] == pytest.approx(want)
    assert running.sorted_quantiles(df, F.col("v"), [0.1, 0.34, 0.5, 0.99]) == pytest.approx(want)


def test_quantiles_of_nothing(spark):
    df = frame(spark, [(None,)], "v double")
    assert order_stats.quantiles(df, {"v": F.col("v")}, [0.5])["v"] == [None]


def test_running_totals_by_group(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 503).cast("double").alias("o"), (F.col("id") % 5).alias("n"))
    out = running.running_totals(df, ["g"], "o", ["n"], buckets=7).toPandas().sort_values(["g", "o"])
    assert (out.groupby("g")["n"].cumsum() == out["cum_n"]).all()


# --- schema


def test_task_inference(spark):
    df = frame(spark, [(0.5, "a", True, i % 3, i, str(i), None if i == 0 else i % 2) for i in range(30)],
               "f double, s string, b boolean, few int, many int, digits string, holes int")
    got = {r["column"]: r["task"] for r in schema.infer_task_types(df).collect()}
    assert got == {"f": "regression", "s": "classification", "b": "classification", "few": "classification", "many": "regression",
                   "digits": "regression", "holes": "regression"}
    assert schema.infer_task_type(df, "holes", nullable_int_is_float=False) == "classification"
    assert schema.infer_task_type(df, "f", "classification") == "classification"


@pytest.mark.parametrize("levels", [19, 20, 21])
def test_task_inference_at_the_limit(spark, levels):
    df = spark.range(5000).select((F.col("id") % levels).alias("y"))
    assert schema.infer_task_type(df, "y") == ("classification" if levels < 20 else "regression")


def test_target_checks(spark):
    df = frame(spark, [(1.0, "x")], "a double, b string")
    with pytest.raises(errors.DataValidationError, match="nope"):
        schema.require_column(df, "nope")
    with pytest.raises(errors.DataValidationError, match='"rows": 1'):
        schema.coerce_target(df, "b")


def test_coercion(spark):
    df = frame(spark, [("1", "x", None), (" 2.5", None, None)], "n string, s string, e string")
    out, done = schema.coerce_numeric_strings(df)
    assert done == ["n", "e"] and [tuple(r) for r in out.collect()] == [(1.0, "x", None), (2.5, "nan", None)]


def test_iqr(spark):
    rows = [(float(v),) for v in [*range(1, 11), 9999]] + [(None,)]
    assert outliers.iqr_filter(frame(spark, rows, "target double"), "target").count() == 10
    assert outliers.iqr_filter(frame(spark, [(1.0,), (2.0,), (3.0,)], "target double"), "target").count() == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(" a , b,day,flag,none\n1,x,2024-01-01,true,\n2,NA,2024-01-02,False,NaN\n")
    df = read_csv(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("day", "string"), ("flag", "boolean"), ("none", "double")]
    assert df.filter("b is null").count() == 1


# --- profile


def test_profile_constant_columns(spark):
    zeros = frame(spark, [(0.0, 0.0, float(i)) for i in range(50)], "a double, b double, y double")
    row = prof.profile(zeros, "y").first()
    assert row["sparsity"] == 1.0 and row["max_linear_score"] is None
    ones = frame(spark, [(1.0, float(i)) for i in range(50)], "a double, y double")
    assert prof.profile(ones, "y").first()["sparsity"] == 0.0


def test_profile_without_numbers(spark):
    row = prof.profile(frame(spark, [("a", 1), ("b", 0)], "c string, y int"), "y").first()
    assert row["sparsity"] == 0.0 and row["n_features"] == 1


def test_profile_ratio(spark):
    df = spark.range(100).select(*[F.rand(i).alias(f"f{i}") for i in range(5)], F.rand(9).alias("y"))
    assert prof.profile(df, "y").first()["ratio"] == 20.0


def test_rules(spark):
    fired = lambda d, y: {r["rule"] for r in prof.profile_rules(d, y).collect()}
    line = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    assert "strong_linear" in fired(line, "y")
    assert "large_table" in fired(spark.range(25_000).select(F.rand(1).alias("x"), F.rand(2).alias("y")), "y")
    wide = spark.range(10).select(*[F.rand(i).alias(f"f{i}") for i in range(50)], F.rand(99).alias("y"))
    assert "wide_table" in fired(wide, "y")
    rare = spark.range(200).select(F.rand(1).alias("x"), (F.col("id") < 5).cast("int").alias("y"))
    assert "rare_class" in fired(rare, "y")
    text = spark.range(100).select(F.rand(1).alias("x"), F.when(F.col("id") < 5, "a").otherwise("b").alias("y"))
    assert "rare_class" in fired(text, "y")


def test_normality_separates_shapes(spark):
    df = spark.range(5000).select(F.randn(3).alias("normal"), F.exp(F.randn(4)).alias("skewed"), F.lit(1.0).alias("flat"))
    p = {r["feature"]: r["p_value"] for r in prof.normality(df, df.columns).collect()}
    assert p["normal"] > 0.01 and p["skewed"] < 1e-6 and p["flat"] is None


# --- leaks


def test_leaks(spark):
    base = spark.range(100).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("target"), F.rand(5).alias("noise"))
    assert set(leakage.drop_leaks(base, "target")[0].columns) == {"target", "noise"}
    named = spark.range(100).select(F.rand(1).alias("x"), F.lit("yes").alias("result_proxy"), (F.col("id") % 2).alias("target"))
    assert leakage.find_leaks(named, "target") == {"result_proxy": "name"}
    prod = spark.range(100).select(F.rand(1).alias("u"), F.rand(2).alias("v")).withColumn("y", F.col("u") * F.col("v"))
    assert leakage.find_leaks(prod, "y") == {"u": "product", "v": "product"}
    almost = prod.withColumn("y", F.when(F.col("u") == F.lit(prod.agg(F.max("u")).first()[0]), 9.0).otherwise(F.col("y")))
    assert leakage.find_leaks(almost, "y") == {}
    text = spark.range(100).select(F.rand(1).alias("x"), F.lit("yes").alias("label_a"), F.lit("t").alias("target"))
    assert leakage.find_leaks(text, "target") == {}


def test_one_to_one_ignores_nulls(spark):
    df = frame(spark, [("a", 1), ("b", 2), (None, 1), ("a", None)], "c string, y int")
    assert leakage.find_leaks(df, "y") == {"c": "one-to-one"}


# --- imputers, encoders, scalers


def test_imputers(spark):
    df = frame(spark, [(1.0, "b"), (2.0, "a"), (3.0, None), (10.0, "a"), (None, "b"), (float("nan"), "b")], "x double, s string")
    fit = lambda **k: impute.Imputer(**k).fit(df).fitted()
    assert fit(inputCols=["x"])["x"][0] == 2.5
    assert fit(inputCols=["x"], strategy="mean")["x"][0] == 4.0
    assert fit(inputCols=["x", "s"], strategy="most_frequent") == {"x": [1.0, True], "s": ["b", False]}
    out = impute.Imputer(inputCols=["s"], strategy="constant", fillValue="z").fit(df).transform(df)
    assert out.filter("s = 'z'").count() == 1
    with pytest.raises(errors.ConfigurationError):
        fit(inputCols=["s"], strategy="median")


def test_one_hot_shapes(spark):
    df = frame(spark, [("red", "S"), ("blue", "M"), ("green", "L"), ("red", "S")], "color string, size string")
    assert encode.one_hot(df).columns == ["color_blue", "color_green", "color_red", "size_L", "size_M", "size_S"]
    assert len(encode.one_hot(df, drop_first=True).columns) == 4
    model = encode.OneHot(inputCols=["color"], handleUnknown="ignore").fit(df)
    new = frame(spark, [("violet", "S")], "color string, size string")
    assert sum(model.transform(new).first()[:3]) == 0.0
    with pytest.raises(Exception, match="unknown level"):
        encode.OneHot(inputCols=["color"], handleUnknown="error").fit(df).transform(new).collect()
    with pytest.raises(errors.ConfigurationError):
        encode.OneHot(inputCols=["color"], maxLevels=2).fit(df)


def test_ordinal(spark):
    df = frame(spark, [("M",), ("S",), ("L",)], "size string")
    assert [r[0] for r in encode.ordinal(df, categories=["S", "M", "L"]).collect()] == [1.0, 0.0, 2.0]
    two = frame(spark, [("Low", "High"), ("Medium", "Low")], "q1 string, q2 string")
    assert [tuple(r) for r in encode.ordinal(two, categories=["Low", "Medium", "High"]).collect()] == [(0.0, 2.0), (1.0, 0.0)]
    with pytest.raises(TypeError):
        encode.ordinal(df, categories=5)
    with pytest.raises(errors.DataValidationError):
        encode.ordinal(df, categories=["S", "M"])
    model = encode.Ordinal(inputCols=["size"]).fit(df)
    assert model.transform(frame(spark, [("XL",)], "size string")).first()[0] == -1.0


def test_label_codes_sort_numbers_as_numbers(spark):
    out, classes = encode.label_encode(frame(spark, [(v,) for v in (10, 9, 2, 10)], "y int"), "y")
    assert classes == [2, 9, 10] and [r[0] for r in out.collect()] == [2, 1, 0, 2]
    assert encode.label_encode(frame(spark, [("x",)], "y string"), "y")[0].first()[0] == 0


def test_scalers(spark):
    df = frame(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    for kind, want in (("standard", (np.array([1, 2, 3, 6]) - 3) / np.std([1, 2, 3, 6])), ("minmax", np.array([0, 0.2, 0.4, 1.0])),
                       ("robust", (np.array([1, 2, 3, 6]) - 2.5) / (3.75 - 1.75))):
        out = scale.Scaler(inputCols=["x", "c"], kind=kind).fit(df).transform(df).collect()
        assert [r["x"] for r in out] == pytest.approx(list(want)) and {r["c"] for r in out} == {0.0}


def test_power(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, [(float(np.exp(v)), float(v)) for v in rng.normal(1, 0.5, 3000)], "x double, z double")
    lam = scale.fit_lambdas(df, ["x"], "box-cox")["x"]
    assert abs(lam) < 0.1  # a lognormal column is made normal by the logarithm
    assert scale.fit_lambdas(df, ["z"], "yeo-johnson")["z"] == pytest.approx(1.0, abs=0.15)
    out = scale.PowerTransform(inputCols=["x"], method="box-cox").fit(df).transform(df).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1, abs=1e-9)
    with pytest.raises(errors.DataValidationError):
        scale.PowerTransform(inputCols=["z"], method="box-cox").fit(df)
    with pytest.raises(errors.DataValidationError):
        scale.LogTransform(inputCols=["x"]).fit(frame(spark, [(None,)], "x double"))


def test_stages_survive_saving(spark, tmp_path):
    df = frame(spark, [(1.0, "a"), (None, "b"), (4.0, None)], "x double, s string")
    stages = [impute.Imputer(inputCols=["x"]), scale.Scaler(inputCols=["x"]), impute.Imputer(inputCols=["s"], strategy="most_frequent"),
              encode.OneHot(inputCols=["s"])]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(df).collect() == model.transform(df).collect()


# --- selection


def test_f_regression_perfect_fit_and_k(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") * 2.0).alias("exact"), F.rand(1).alias("r1"), F.rand(2).alias("r2"))
    best = select.k_best(df, ["exact", "r1", "r2"], "y", 2).collect()
    assert best[0]["feature"] == "exact" and len(best) == 2
    with pytest.raises(errors.ConfigurationError):
        select.k_best(df, ["r1"], "y", 1, "magic")
    custom = lambda d, cols, y: d.sparkSession.createDataFrame([(c, float(len(c))) for c in cols], "feature string, score double")
    assert select.k_best(df, ["exact", "r1"], "y", 1, custom).first()["feature"] == "exact"


# --- splits


def test_split_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).alias("y"))
    a = split.train_test_flag(df, key="id", stratify="y")
    b = split.train_test_flag(df.repartition(13), key="id", stratify="y")
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r["y"]: r["n"] for r in a.filter("is_test").groupBy("y").agg(F.count("id").alias("n")).collect()} == {True: 29, False: 172}
    folds = {(r["y"], r["fold"]): r["n"] for r in split.fold_column(df, 3, "id", "y").groupBy("y", "fold").agg(F.count("id").alias("n")).collect()}
    assert sorted(v for (y, _), v in folds.items() if y) == [48, 48, 48] and len(folds) == 6


def test_split_general_search_agrees(spark, monkeypatch):
    df = spark.range(2000)
    want = {r["id"] for r in split.train_test_flag(df, key="id").filter("is_test").collect()}
    monkeypatch.setattr(split, "GATHER", 1)
    assert {r["id"] for r in split.train_test_flag(df, key="id").filter("is_test").collect()} == want


def test_split_errors(spark):
    with pytest.raises(errors.InsufficientDataError):
        split.train_test_flag(frame(spark, [(1, "a"), (2, "a"), (3, "b")], "id int, y string"), key="id", stratify="y")
    with pytest.raises(errors.InsufficientDataError):
        split.fold_column(spark.range(2), 3, "id")


def test_class_weights(spark):
    df = frame(spark, [("a",)] * 3 + [("b",)], "y string")
    assert {r["class"]: r["weight"] for r in split.class_weights(df, "y").collect()} == {"a": pytest.approx(4 / 6), "b": 2.0}


# --- metrics: exact values


def one(df):
    return df.first()[0]


def test_exact_regression_metrics(spark):
    m = metrics.regression_metrics(pairs(spark, [0, 0], [3, 4]), "y", "p").first()
    assert m["rmse"] == pytest.approx(math.sqrt(12.5)) and m["r2"] == 0.0
    assert metrics.regression_metrics(pairs(spark, [1, 3], [2, 5]), "y", "p").first()["mae"] == 1.5
    assert math.isnan(metrics.regression_metrics(pairs(spark, [1, 3], [2, 5]), "y", "p", 5).first()["adjusted_r2"])
    assert metrics.regression_metrics(pairs(spark, [2, 2], [2, 2]), "y", "p").first()["r2"] == 1.0


def test_exact_classification_metrics(spark):
    assert one(metrics.accuracy(pairs(spark, [0, 1, 0, 1], [0, 1, 1, 0]), "y", "p")) == 0.5
    assert metrics.classification_metrics(pairs(spark, [0, 0], [1, 1]), "y", "p").first()["f1"] == 0.0
    with pytest.raises(errors.ConfigurationError):
        metrics.classification_metrics(pairs(spark, [0], [1]), "y", "p", "odd")


def test_exact_auc_and_log_loss(spark):
    assert one(metrics.roc_auc(pairs(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "y", "p")) == 1.0
    assert one(metrics.roc_auc(pairs(spark, [1, 1], [0.1, 0.9]), "y", "p")) == 0.5
    assert one(metrics.roc_auc(pairs(spark, [0, 1, 0, 1], [0.5] * 4), "y", "p")) == 0.5
    assert one(metrics.log_loss(pairs(spark, [0, 1], [0.0, 1.0]), "y", "p")) == pytest.approx(0, abs=1e-5)
    missing = frame(spark, [(2.0, [0.5, 0.5])], "y double, p array<double>")
    assert one(metrics.log_loss(missing, "y", "p")) == 10.0


def test_auc_on_hot_scores(spark):
    df = spark.range(3000).select((F.xxhash64("id") % 2 == 0).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(7)).alias("p"))
    pdf = df.toPandas()
    pos, neg = pdf.p[pdf.y == 1].to_numpy(), pdf.p[pdf.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert one(metrics.roc_auc(df, "y", "p")) == pytest.approx(want, abs=1e-12)


# --- diagnostics


def test_correlation_matrix_with_text_target_and_nulls(spark):
    df = spark.range(100).select(F.rand(1).alias("a"), F.when(F.col("id") != 3, F.rand(2)).alias("b"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("t"))
    m = {(r["feature_a"], r["feature_b"]): r["r"] for r in diagnostics.correlation_matrix(df, "t").collect()}
    assert m[("t", "t")] == pytest.approx(1.0) and m[("a", "t")] == pytest.approx(m[("t", "a")]) and m[("a", "b")] is None


def test_histogram_counts_everything(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(4.0).alias("flat"))
    rows = diagnostics.histogram(df, ["v", "flat"]).toPandas()
    assert rows.groupby("feature")["n"].sum().to_dict() == {"v": 1000, "flat": 1000}


def test_confusion_matrix_has_zero_cells(spark):
    rows = diagnostics.confusion_matrix(pairs(spark, [0, 0, 1], [0, 0, 0]), "y", "p", ["no", "yes"]).collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {("no", "no"): 2, ("no", "yes"): 0, ("yes", "no"): 1, ("yes", "yes"): 0}


def test_coefficient_ranking_uses_the_ratio(spark):
    t = frame(spark, [("a", -5.0), ("b", 0.1), ("c", 1.0)], "feature string, coefficient double")
    assert [r["feature"] for r in diagnostics.top_coefficients(t, 2).collect()] == ["a", "c"]
    assert [r["feature"] for r in diagnostics.top_coefficients(t, 2, odds_ratio=True).collect()] == ["b", "c"]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_closest_rows_are_measured_exactly(monkeypatch, shift):
    """Same rows, order and digits as measuring all pairs, with copies, ties and far origins; few pairs are measured."""
    rng = np.random.default_rng(1)
    b = np.concatenate([rng.normal(size=(700, 16)), rng.integers(0, 2, (300, 16))]) + shift
    b[500:520] = b[3]
    a = np.concatenate([b[::40], rng.normal(size=(30, 16)) + shift])
    d = neighbours._distances(a, b, "euclidean")
    top = np.argsort(d, axis=1, kind="stable")[:, :7]
    monkeypatch.setattr(neighbours, "_distances", None)
    r, c, got = neighbours._closest(a, b, 7, "euclidean")
    assert r.tolist() == np.repeat(np.arange(len(a)), 7).tolist() and c.tolist() == top.ravel().tolist()
    assert got.tolist() == np.take_along_axis(d, top, 1).ravel().tolist()
