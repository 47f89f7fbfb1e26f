"""Limits, choices by size and bad input that must not change results silently."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from modelsift import errors
from modelsift.functions.scratch import drop_path, scratch_path, settled
from modelsift.operators import diagnostics, leakage, split
from modelsift.operators.projection import LinearMap, covariance, spectrum
from modelsift.operators.reduce import PcaReduce, pca_report
from modelsift.operators.scale import fit_lambdas
from modelsift.plans.margins import CubicFeatures, feature_map


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    rows = [(*map(float, r), float(r[7] * r[31])) for r in x]
    return spark.createDataFrame(rows, ", ".join([f"c{i} double" for i in range(40)] + ["y double"])).repartition(4)


def vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, a array<double>").select("id", array_to_vector("a").alias("features")).repartition(5)


def test_product_check_of_forty_columns(wide, caplog):
    assert [tuple(r) for r in leakage.identity_leaks(wide, "y").collect()] == [("c7", "c31")]
    left, found = leakage.drop_leaks(wide, "y")
    assert set(found) == {"c7", "c31"} and "c7" not in left.columns
    with caplog.at_level("WARNING"):
        assert leakage.identity_leaks(wide, "y", max_columns=30).count() == 0
    assert "skipped" in caplog.text


def test_product_check_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (None, 3.0, 3.0)], "a double, b double, y double")
    assert leakage.identity_leaks(df, "y").count() == 0 and leakage.identity_leaks(df.limit(0), "y").count() == 0
    assert leakage.identity_leaks(df.where("a is not null"), "y").count() == 1


def test_cubic_kernel_of_forty_features(spark):
    x = np.random.default_rng(1).normal(size=(60, 40)) / 4
    df = vectors(spark, x)
    mapped = feature_map(df, "poly", 1.0, 7)
    assert isinstance(mapped, CubicFeatures)
    rows = CubicFeatures.of(1.0, 7, 60_000).transform(df.where("id < 6")).select("id", vector_to_array("mapped").alias("z")).orderBy("id").collect()
    z = np.array([r["z"] for r in rows])
    assert np.abs(z @ z.T - (x[:6] @ x[:6].T + 1) ** 3).max() < 0.15 * ((x[:6] ** 2).sum(1) + 1).max() ** 3


def test_null_classes_are_refused(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)], "k int, c string")
    for call in (lambda: split.train_test_flag(df, key="k", stratify="c"), lambda: split.fold_column(df, key="k", stratify="c")):
        with pytest.raises(errors.DataValidationError):
            call()


def test_lambda_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(size=20_000)], "v double")
    a, b = (fit_lambdas(df.repartition(n), ["v"], "box-cox")["v"] for n in (2, 7))
    assert a == pytest.approx(b, abs=1e-9) and abs(a) < 0.05


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) + 100
    df = vectors(spark, x)
    n, mean, cov = covariance(df, "features")
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    values, rows = spectrum(cov)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(values, s**2 / 399) and np.allclose(np.abs(rows @ v.T), np.eye(9), atol=1e-6)
    model = PcaReduce(inputCol="features", outputCol="p", components=0.9).fit(df)
    path = scratch_path(spark, "map")
    model.write().overwrite().save(path)
    again = LinearMap.load(path)
    got = np.array([r[0] for r in again.transform(df).orderBy("id").select(vector_to_array("p")).collect()])
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9, side="right")) + 1
    assert got.shape[1] == k and np.allclose(got, (x - x.mean(0)) @ rows[:k].T)
    _, table, m = pca_report(df, "features", 3)
    lost = np.sqrt(((u[:, 3:] * s[3:]) ** 2).sum() / 400 / 9)
    assert m.first()["reconstruction_rmse"] == pytest.approx(lost) and np.allclose([r["singular_value"] for r in table.collect()], s[:3])
    drop_path(spark, path)


def test_constant_vectors_have_a_projection(spark):
    df = vectors(spark, np.ones((5, 3)))
    assert [len(r[0]) for r in PcaReduce(inputCol="features", outputCol="p", components=2.0).fit(df).transform(df).select(vector_to_array("p")).collect()] == [2] * 5


def test_scratch_folder_is_shared(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_path(spark, "x").startswith((named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/"))
    assert settled(spark.range(3)).count() == 3


def test_precision_recall_closes(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.3)], "y int, s double")
    got = {(r["threshold"], r["precision"], r["recall"]) for r in diagnostics.pr_points(df, "y", "s").collect()}
    assert (float("inf"), 1.0, 0.0) in got and len(got) == 4


def test_tuning_scales_inside_folds(spark):
    from modelsift.plans import model_queries as m

    df = m._ridge_folds(spark, "/root/testdata/sf0.001")
    settings = [{"alpha": a, "l1_ratio": r} for a in (0.01, 10.0) for r in (0.1, 1.0)]
    got, pdf = m._ridge_scores(df, settings), df.toPandas()
    for s, v in zip(settings, got):
        errs = []
        for f in range(3):
            tr, va = (p[["z0", "z1", "z2", "z3"]].to_numpy() for p in (pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]))
            mean, sd = tr.mean(0), tr.std(0)
            a = (tr[:, :3] - mean[:3]) / sd[:3]
            w = m.solve_elastic_net(a.T @ a / len(a), a.T @ (tr[:, 3] - mean[3]) / len(a), s["alpha"] * s["l1_ratio"], s["alpha"] * (1 - s["l1_ratio"]))
            errs.append(((va[:, 3] - mean[3] - (va[:, :3] - mean[:3]) / sd[:3] @ w) ** 2).mean())
        assert v == pytest.approx(-np.mean(errs), rel=1e-6)


def test_names_that_give_away(spark):
    df = spark.createDataFrame([("x", True, 1.0, "z")], "final_label string, is_result boolean, output double, level string")
    assert leakage.name_leaks(df, "level") == ["final_label", "is_result"]
    assert df.select(F.lit(1)).count() == 1
