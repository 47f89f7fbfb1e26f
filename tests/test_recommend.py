from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from modelsift import errors
from modelsift.plans.base import LABEL
from modelsift.plans.recommend import Outcome, Recommender, best_outcome, explanation_tables, leaderboard_table, select_candidates

SMALL = {
    "logistic": {"C": [1.0], "penalty": ["l2"], "max_iter": 20}, "tree": {"n_iter": 3, "max_depth": [3]}, "naive": {"var_smoothing": [1e-9, 1e-3]},
    "knn": {"n_trials": 2, "metric": ("euclidean",)}, "forest": {"n_trials": 1, "n_estimators": (5, 5), "max_depth": (3, 3)},
    "svm": {"n_iter": 1, "kernel": ("linear",), "max_iter": 10},
}


def mixed(spark, n=200):
    rng = np.random.default_rng(0)
    rows = [
        (i, float(a), float(rng.normal(50, 9)), str(rng.choice(["M", "F", "Other"])), str(rng.choice(["North", "South"])), int(a + rng.normal(0, 4) > 40))
        for i, a in enumerate(rng.uniform(18, 65, n))
    ]
    return spark.createDataFrame(rows, "id int, age double, salary double, gender string, region string, target int")


def regression(spark, n=200):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    rows = [(i, *map(float, r), float(2 * r[0] - r[1] + rng.normal(0, 0.8))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, f0 double, f1 double, f2 double, target double")


def test_classification_flow(spark, tmp_path):
    seen = []
    rec = Recommender(key="id", configs=SMALL)
    res = rec.run(mixed(spark), "target", progress=lambda p, m: seen.append(p))
    board = res.leaderboard.collect()
    assert res.task == "classification" and res.classes == [0, 1] and len(board) == 6
    assert all(r["status"] == "success" for r in board), [r["error"] for r in board]
    f1 = [r["metrics"]["f1"] for r in board]
    assert f1 == sorted(f1, reverse=True) and board[0]["name"] == res.best.name
    assert seen[-1] == 100 and seen == sorted(seen)
    assert {"confusion_matrix", "roc_points"} <= set(res.diagnostics)
    assert set(res.feature_names) >= {"age", "salary", "gender_F"} or res.best.name.startswith(("KNN", "SVM"))
    res.write(str(tmp_path / "run"))
    model = PipelineModel.load(str(tmp_path / "run" / "model"))
    assert model.transform(res.prepared.test).count() == res.prepared.test.count() == 40
    assert spark.read.parquet(str(tmp_path / "run" / "leaderboard")).count() == 6
    res.release()


def test_knn_model_survives_saving(spark, tmp_path):
    rec = Recommender(key="id", configs=SMALL)
    prepared = rec.prepare(regression(spark), "target")
    out = rec.train_one(select_candidates("regression", ["knn"])[0], prepared, lambda p, m: None)
    assert out.ok, out.error
    out.candidate.export(str(tmp_path / "knn"))
    again = PipelineModel.load(str(tmp_path / "knn")).transform(prepared.test).select("row_id", "prediction").orderBy("row_id").collect()
    assert again == out.predictions.select("row_id", "prediction").orderBy("row_id").collect()
    assert out.candidate.inspected(prepared.test).groupBy("row_id").count().count() == 5


def test_regression_flow_with_nulls(spark):
    df = regression(spark).withColumn("f0", F.when(F.col("id") < 10, None).otherwise(F.col("f0"))).withColumn(
        "target", F.when(F.col("id") == 77, 1e6).when(F.col("id") == 78, None).otherwise(F.col("target")))
    res = Recommender(key="id", configs=SMALL).run(df, "target", include=["linear, tree"])
    board = res.leaderboard.collect()
    rmse = [r["metrics"]["rmse"] for r in board]
    assert len(board) == 2 and rmse == sorted(rmse) and res.prepared.dropped_rows >= 2
    assert board[0]["name"].startswith("Linear") and res.best.metrics["r2"] > 0.7
    assert {"residuals", "qq", "predicted_vs_actual"} == set(res.diagnostics)


def test_leaks_are_dropped(spark):
    df = regression(spark).withColumn("leaky", F.col("target") * 2)
    prepared = Recommender(key="id").prepare(df, "target")
    assert prepared.leaks == {"leaky": "correlation"} and "leaky" not in prepared.train.columns


def test_validation(spark):
    df = regression(spark)
    with pytest.raises(errors.DataValidationError, match="nope"):
        Recommender().prepare(df, "nope")
    with pytest.raises(errors.DataValidationError):
        Recommender(key="id").prepare(df.withColumn("target", F.lit(None).cast("double")), "target")


def test_same_seed_same_split(spark):
    a, b = (Recommender(key="id").prepare(d, "target") for d in (mixed(spark), mixed(spark).repartition(5)))
    assert sorted(a.test.select("row_id", LABEL).collect()) == sorted(b.test.select("row_id", LABEL).collect())


def test_boolean_and_text_targets(spark):
    df = mixed(spark).withColumn("flag", F.col("target") == 1).drop("target")
    p = Recommender(key="id").prepare(df, "flag")
    assert p.problem.classes == [False, True] and p.problem.task == "classification"
    q = Recommender(key="id").prepare(df, "region")
    assert q.problem.classes == ["North", "South"] and q.problem.flags == ["flag"]


def test_candidate_filter():
    assert [c.__name__ for c in select_candidates("classification", ["LOGISTIC, tree"])] == ["Logistic", "DecisionTree"]
    assert len(select_candidates("regression", ["zzz"])) == len(select_candidates("regression")) == 5


def test_ranking(spark):
    out = [Outcome("a", metrics={"f1": 0.5}), Outcome("b", error="boom"), Outcome("c", metrics={"f1": float("nan")}), Outcome("d", metrics={"f1": 0.9})]
    rows = leaderboard_table(spark, out, "classification").orderBy("rank").collect()
    assert [r["name"] for r in rows] == ["d", "a", "c", "b"] and rows[-1]["error"] == "boom"
    assert best_outcome(out, "classification").name == "d"
    assert best_outcome([Outcome("a", metrics={}), Outcome("b", metrics={"rmse": 2.0})], "regression").name == "b"
    with pytest.raises(errors.PipelineError):
        best_outcome([Outcome("x", error="e")], "regression")


def test_a_failing_candidate_becomes_a_row(spark):
    rec = Recommender(key="id", configs={"naive": {"model_type": "odd"}})
    prepared = rec.prepare(mixed(spark), "target")
    out = rec.train_one(select_candidates("classification", ["naive"])[0], prepared, lambda p, m: None)
    assert not out.ok and "ConfigurationError" in out.error


def test_tree_candidates_explain_save_and_load(spark, tmp_path):
    prepared = Recommender(key="id").prepare(mixed(spark), "target")
    for name, config in (("tree", SMALL["tree"]), ("forest", SMALL["forest"])):
        rec = Recommender(key="id", configs={"*": config})
        out = rec.train_one(select_candidates("classification", [name])[0], prepared, lambda p, m: None)
        assert out.ok, out.error
        tables = explanation_tables(out, prepared)
        assert 0 < tables["shapley"].count() <= 10 and tables["shapley"].where("importance < 0").isEmpty()
        assert out.metrics["depth"] <= 3 and (name == "tree" or out.metrics["oob_score"] > 0.4)
        assert {"importances", "nodes" if name == "tree" else "first_tree"} <= set(out.candidate.tailored(spark))
        out.candidate.export(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name)).transform(prepared.test).select("row_id", "prediction").orderBy("row_id").collect()
        assert again == out.predictions.select("row_id", "prediction").orderBy("row_id").collect()


def test_explanations_of_a_run(spark):
    import numpy as np

    from modelsift.plans.recommend import Recommender, explanation_tables

    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), "xy"[i % 2], float(3 * a + 2 * c)) for i, (a, b, c) in enumerate(rng.normal(size=(240, 3)))]
    result = Recommender(key="id").run(spark.createDataFrame(rows, "id int, a double, b double, t string, y double"), "y", include=["elasticnet, knn"])
    tables = result.tables()
    assert {"explanation_trials", "explanation_correlation_matrix", "explanation_histograms", "explanation_attribution"} <= set(tables)
    assert tables["explanation_attribution"].orderBy("importance", ascending=False).first()["feature"] == "a"
    assert tables["explanation_trials"].count() == len(result.best.candidate.search.trials)
    ranks = [(r["rank"], r["status"]) for r in result.leaderboard.collect()]
    assert [k for k, _ in ranks] == list(range(1, len(ranks) + 1))
    assert not result.prepared.cached[0].storageLevel == result.prepared.cached[0].sparkSession.range(1).storageLevel
    result.release()
    assert not result.prepared.cached[0].is_cached and not result.prepared.cached[1].is_cached
