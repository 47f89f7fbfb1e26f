from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modelsift import errors
from modelsift.operators import attribution, neighbours, reduce
from modelsift.plans import base, bayes, linear, margins, registry, tuning
from modelsift.plans.base import FEATURES, FOLD, LABEL, ROW, Problem


def vectors(spark, x, y, fold=True):
    cols = [f"x{j}" for j in range(x.shape[1])]
    rows = [(str(i), float(t), i % 3, *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{ROW} string, {LABEL} double, {FOLD} int, " + ", ".join(f"{c} double" for c in cols))
    return VectorAssembler(inputCols=cols, outputCol=FEATURES).transform(df)


@pytest.fixture(scope="module")
def linear_data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    return x, 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=400)


def test_elastic_net_search_and_final_fit_agree(spark, linear_data):
    x, y = linear_data
    df = vectors(spark, x, y)
    _, m, c = linear.moments(df)
    assert m[:-1] == pytest.approx(x.mean(0)) and c[:-1, :-1] == pytest.approx(np.cov(x.T, bias=True))
    for alpha, ratio in ((0.1, 0.5), (0.5, 1.0), (1.0, 0.1)):
        w = linear.solve_elastic_net(c[:-1, :-1], c[:-1, -1], alpha * ratio, alpha * (1 - ratio))
        model = linear.ElasticNet(Problem("regression", []))._spark_fit(df, {"alpha": alpha, "l1_ratio": ratio}, float(y.std()))
        assert model.coefficients.toArray() == pytest.approx(w, abs=1e-4)


def test_ridge_closed_form(spark, linear_data):
    x, y = linear_data
    _, _, c = linear.moments(vectors(spark, x, y))
    w = linear.solve_elastic_net(c[:-1, :-1], c[:-1, -1], 0.0, 0.7)
    xc = x - x.mean(0)
    assert w == pytest.approx(np.linalg.solve(xc.T @ xc / len(x) + 0.7 * np.eye(4), xc.T @ (y - y.mean()) / len(x)), abs=1e-8)


def test_gaussian_nb_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 3)) + y[:, None]
    df = vectors(spark, x, y)
    model = bayes.GaussianNBModel.of(bayes.class_moments(df), 1e-3, 3)
    var = np.array([x[y == c].var(0) for c in range(3)]) + 1e-3 * x.var(0).max()
    mu = np.array([x[y == c].mean(0) for c in range(3)])
    joint = np.log(np.bincount(y) / 300) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mu) ** 2 / var).sum(2))
    prob = np.exp(joint - joint.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    model.write().overwrite().save(str(tmp_path / "nb"))
    got = bayes.GaussianNBModel.load(str(tmp_path / "nb")).transform(df).select(ROW, "prediction", vector_to_array("probability").alias("p")).toPandas()
    got = got.assign(i=got[ROW].astype(int)).sort_values("i")
    assert np.stack(got["p"].to_numpy()) == pytest.approx(prob, abs=1e-9)
    assert (got["prediction"].to_numpy() == joint.argmax(1)).all()


def test_neighbours_match_brute_force_with_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 2)), 2)
    x[:300] = 0.25  # a third of the rows are copies
    ids = [f"{i:04d}" for i in range(900)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, x array<double>")
    for metric in ("euclidean", "manhattan"):
        got = neighbours.nearest(df, df, 5, metric).toPandas()
        by = {q: g.sort_values("rank")["id"].tolist() for q, g in got.groupby("query")}
        keys = df.select("id", neighbours.vector_key(F.col("x")).alias("q")).toPandas().set_index("id")["q"]
        for j in range(0, 900, 37):
            d = np.abs(x - x[j]).sum(1) if metric == "manhattan" else np.sqrt(((x - x[j]) ** 2).sum(1))
            assert by[keys[ids[j]]] == [ids[t] for t in np.argsort(d, kind="stable")[:5]]


def test_votes(spark):
    hits = spark.createDataFrame([([(1, 0.0, 1.0), (2, 0.5, 0.0), (3, 1.0, 0.0)],), ([(1, 0.5, 1.0), (2, 1.0, 0.0), (3, 2.0, 0.0)],)],
                                 "hits array<struct<rank:int,distance:double,label:double>>")
    got = hits.select(neighbours.vote(F.col("hits"), 3, "uniform", 2).alias("u"), neighbours.vote(F.col("hits"), 3, "distance", 2).alias("d"),
                      neighbours.vote(F.col("hits"), 2, "distance", None).alias("r")).collect()
    assert got[0]["u"] == pytest.approx([2 / 3, 1 / 3]) and got[0]["d"] == [0.0, 1.0] and got[0]["r"] == 1.0
    assert got[1]["d"] == pytest.approx([1.5 / 3.5, 2 / 3.5]) and got[1]["r"] == pytest.approx(2 / 3)


def test_svr_follows_a_line(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    y[:10] += 50  # outliers hardly move an absolute loss
    df = vectors(spark, x, y).withColumn(margins.MAPPED, F.col(FEATURES))
    m = margins.fit_svr(df, 10.0)
    assert m.coefficients.toArray() == pytest.approx([2, -1], abs=0.1) and m.intercept == pytest.approx(0.5, abs=0.15)


def test_fourier_features_estimate_the_kernel(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 3))
    z = margins.FourierFeatures.of(0.3, 1, 4096).transform(vectors(spark, x, x[:, 0])).select(ROW, vector_to_array(margins.MAPPED).alias("z")).toPandas()
    z = np.stack(z.assign(i=z[ROW].astype(int)).sort_values("i")["z"].to_numpy())
    want = np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_selectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    df = vectors(spark, x, (2 * x[:, 1] - 2 * x[:, 4] > 0).astype(float))
    assert reduce.rfe_support(df, FEATURES, LABEL, keep=2) == [1, 4]
    assert set(reduce.ModelSelect(inputCol=FEATURES, outputCol="s", kind="forest", classes=2).fit(df).getIndices()) >= {1, 4}


def test_pca_report(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) @ np.diag([3, 1, 0.1]) + 5
    df = vectors(spark, x, x[:, 0])
    out, spectrum, m = reduce.pca_report(df, FEATURES, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    lost = (x - x.mean(0)) - (x - x.mean(0)) @ vt[:2].T @ vt[:2]
    row = m.first()
    assert row["reconstruction_rmse"] == pytest.approx(np.sqrt((lost**2).mean()), rel=1e-6) and row["n_components"] == 2
    assert [r["singular_value"] for r in spectrum.orderBy("component").collect()] == pytest.approx(list(s[:2]), rel=1e-6)
    assert out.select("pca").first()[0].size == 2


def test_attribution(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 2))
    df = vectors(spark, x, x[:, 0])
    got = {r["feature"]: r["importance"] for r in attribution.linear_attribution(df, FEATURES, [2.0, -1.0], ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(np.abs(2 * (x[:, 0] - x[:, 0].mean())).mean()), "b": pytest.approx(np.abs(x[:, 1] - x[:, 1].mean()).mean())}
    mixed = attribution.shuffled_columns(df.select(ROW, "x0"), ["x0"], ROW, 1, 200)
    assert sorted(r[0] for r in mixed.select("_shuffled_0").collect()) == sorted(x[:, 0].tolist())


def test_searches():
    score = lambda ss: [-((s["a"] - 3) ** 2) for s in ss]
    space = {"a": [0, 1, 2, 3, 4, 5, 6, 7, 8]}
    assert tuning.grid_search(space, score).best[0] == {"a": 3}
    r = tuning.random_search(space, score, 5, seed=1)
    assert len({s["a"] for s, _ in r.trials}) == 5
    used = []
    h = tuning.halving_search(space, lambda ss, share: used.append((len(ss), share)) or score(ss))
    assert h.best[0] == {"a": 3} and used == [(9, pytest.approx(1 / 9)), (3, pytest.approx(1 / 3)), (1, 1.0)]
    smooth = {"a": tuning.FloatRange(-10.0, 10.0), "b": tuning.Choice(["x", "y"]), "c": tuning.IntRange(1, 4), "d": tuning.FloatRange(0.01, 10, log=True)}
    t = tuning.tpe_search(smooth, score, n_trials=40, seed=3)
    again = tuning.tpe_search(smooth, score, n_trials=40, seed=3)
    assert t.trials == again.trials and abs(t.best[0]["a"] - 3) < 1.0
    assert np.mean([abs(s["a"] - 3) for s, _ in t.trials[20:]]) < np.mean([abs(s["a"] - 3) for s, _ in t.trials[:10]])
    with pytest.raises(errors.ModelTrainingError):
        _ = tuning.Search([({"a": 1}, float("-inf"))]).best


def test_registry():
    before = {t: registry.get_registered_models(t) for t in registry.TASKS}
    with pytest.raises(errors.RegistryError):
        registry.register_model("ranking")
    with pytest.raises(errors.RegistryError):
        registry.get_registered_models("both")
    try:
        registry.clear_registry()

        @registry.register_model("both")
        class Dummy(base.Candidate):
            pass

        registry.register_model("both")(Dummy)
        assert registry.get_registered_models("regression") == [Dummy] == registry.get_registered_models("classification")
    finally:
        registry.clear_registry()
        for t, v in before.items():
            registry._CANDIDATES[t].extend(v)


def test_error_hierarchy():
    for e in (errors.InsufficientDataError, errors.ModelExportError, errors.RegistryError, errors.PipelineError, errors.DiagnosticsError):
        assert issubclass(e, errors.SiftError)
    e = errors.DataValidationError("bad", column="y")
    assert str(e) == 'bad {"column": "y"}' and e.details == {"column": "y"} and str(errors.SiftError("plain")) == "plain"
