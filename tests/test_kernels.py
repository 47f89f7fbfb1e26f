"""Kernel machines against their optimality conditions and dense solutions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modelsift.operators import kernel_dual
from modelsift.operators.kernel_dual import Dual, solve
from modelsift.plans import kernels
from modelsift.plans.kernels import KernelMachine, couple, fit_sigmoids


def frame(spark, x, y, parts=4):
    rows = [(float(v), [float(c) for c in r]) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features")).repartition(parts).cache()


def data(n=180, classes=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    if classes:
        return x, np.digitize(x[:, 0] + x[:, 1] ** 2 / 2 + rng.normal(scale=0.3, size=n), np.linspace(-0.3, 1, classes - 1)).astype(float)
    return x, np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(scale=0.05, size=n)


def violation(d: Dual, x, y, rows):
    """Largest breach of the optimality conditions by the multipliers of one problem, and its dual objective."""
    ids = {tuple(np.round(v, 12)): i for i, v in enumerate(x)}
    alpha = np.zeros((len(x), 2))
    for r in rows:
        alpha[ids[tuple(np.round(r["x"], 12))]] = r["plus"], r["minus"]
    s, p, c = d.sides(y)
    assert (alpha >= 0).all() and (alpha <= c + 1e-12).all() and abs((s * alpha).sum()) < 1e-8
    beta = (s * alpha).sum(1)
    u = d.gram(x, x) @ beta
    value = -s * (s * u[:, None] + p)
    up, low = np.where(s > 0, alpha < c, alpha > 0) & (c > 0), np.where(s > 0, alpha > 0, alpha < c) & (c > 0)
    return value[up].max() - value[low].min(), 0.5 * beta @ u + (p * alpha).sum()


@pytest.mark.parametrize("working,held,merge", [(192, 2_000, 64), (10, 25, 2)])
def test_optimality_of_many_problems_at_once(spark, monkeypatch, working, held, merge):
    for name, v in (("WORKING", working), ("HELD", held), ("MERGE", merge)):
        monkeypatch.setattr(kernel_dual, name, v)
    x, y = data()
    duals = [Dual(k, 0.5, c, pair, (1.0, 1.7)) for k, c in (("rbf", 5.0), ("poly", 1.0), ("linear", 1.0)) for pair in ((0, 1), (0, 2), (1, 2))]
    got = solve(frame(spark, x, y), duals)
    rows = got.support.collect()
    for p, d in enumerate(duals):
        gap, _ = violation(d, x, y, [r for r in rows if r["problem"] == p])
        assert gap < 1.01e-3 and got.gaps[p] < 1e-3


def test_tube_has_no_duality_gap(spark):
    x, y = data(150, 0)
    for d in (Dual("rbf", 0.7, 10.0), Dual("linear", 1.0, 2.0), Dual("poly", 0.3, 0.5)):
        got = solve(frame(spark, x, y), [d])
        rows = got.support.collect()
        gap, dual = violation(d, x, y, rows)
        beta = np.array([r["plus"] - r["minus"] for r in rows])
        at = np.array([r["x"] for r in rows])
        f = d.gram(x, at) @ beta + got.offsets[0]
        primal = 0.5 * beta @ d.gram(at, at) @ beta + d.c * np.maximum(np.abs(y - f) - d.epsilon, 0).sum()
        assert gap < 1.01e-3 and abs(primal + dual) < 1e-3 * max(1, abs(primal)) * len(y) / 10
        assert not any(r["plus"] > 0 and r["minus"] > 0 for r in rows)
        machine = KernelMachine.of(got, [d], [0], 0)
        told = {tuple(r["features"].toArray()): r["prediction"] for r in machine.transform(frame(spark, x, y)).collect()}
        assert [told[tuple(v)] for v in x] == pytest.approx(f.tolist())


def test_votes_pieces_and_saving(spark, tmp_path, monkeypatch):
    x, y = data()
    pairs = [(0, 1), (0, 2), (1, 2)]
    duals = [Dual("rbf", 0.5, 5.0, p) for p in pairs]
    df = frame(spark, x, y)
    got = solve(df, duals)
    machine = KernelMachine.of(got, duals, [0, 1, 2], 3, [(-2.0, 0.1)] * 3)
    out = machine.transform(df).collect()
    rows = got.support.collect()
    for r in out[:30]:
        v, votes = r["features"].toArray(), np.zeros(3)
        f = []
        for p, (a, b) in enumerate(pairs):
            own = [s for s in rows if s["problem"] == p]
            score = sum((s["plus"] - s["minus"]) * np.exp(-0.5 * ((v - np.array(s["x"])) ** 2).sum()) for s in own) + got.offsets[p]
            votes[a if score > 0 else b] += 1
            f.append(score)
        assert r["prediction"] == np.argmax(votes)
        z = 1 / (1 + np.exp(-2.0 * np.array(f) + 0.1))
        m = np.zeros((1, 3, 3))
        for p, (a, b) in enumerate(pairs):
            m[0, a, b], m[0, b, a] = z[p], 1 - z[p]
        assert r["probability"].toArray() == pytest.approx(couple(m)[0], abs=1e-6)
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.85
    machine.write().overwrite().save(str(tmp_path / "m"))
    monkeypatch.setattr(kernels, "ROWS_AT_ONCE", 20)
    again = KernelMachine.load(str(tmp_path / "m")).transform(df).collect()
    assert [r["prediction"] for r in again] == [r["prediction"] for r in out]


def test_coupling_minimises_its_objective():
    rng = np.random.default_rng(0)
    r = rng.uniform(0.05, 0.95, (20, 4, 4))
    for i in range(4):
        for j in range(i):
            r[:, i, j] = 1 - r[:, j, i]
    r[:, np.arange(4), np.arange(4)] = 0
    p = couple(r)
    assert p.sum(1) == pytest.approx(1) and (p >= 0).all()

    def objective(n, q):
        return sum((r[n, j, i] * q[i] - r[n, i, j] * q[j]) ** 2 for i in range(4) for j in range(4) if i != j)

    for n in range(20):
        for _ in range(200):
            q = np.clip(p[n] + rng.normal(scale=0.02, size=4), 0, None)
            assert objective(n, p[n]) <= objective(n, q / q.sum()) + 1e-12


def test_sigmoids_equal_a_dense_newton(spark):
    rng = np.random.default_rng(4)
    rows = [(p, bool(rng.uniform() < 1 / (1 + np.exp(-(1 + p) * f - 0.3))), float(f)) for p in range(2) for f in rng.normal(size=150)]
    got = fit_sigmoids(spark.createDataFrame(rows, "pair int, positive boolean, f double"), 3)
    assert got[2] == (0.0, 0.0)
    for p in range(2):
        f = np.array([r[2] for r in rows if r[0] == p])
        up = np.array([r[1] for r in rows if r[0] == p])
        t = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
        a = np.zeros(2)
        for _ in range(200):
            q = 1 / (1 + np.exp(a[0] * f + a[1]))
            g = np.array([(f * (t - q)).sum(), (t - q).sum()])
            w = q * (1 - q)
            a = a - np.linalg.solve([[(f * f * w).sum(), (f * w).sum()], [(f * w).sum(), w.sum()]], g)
        assert got[p] == pytest.approx(a.tolist(), abs=1e-4)


def test_one_sided_and_empty_problems(spark):
    x, y = data(40, 2)
    got = solve(frame(spark, x, np.zeros(40)), [Dual("rbf", 1.0, 1.0, (0, 1))])
    assert got.offsets == [0.0] and got.support.count() == 0
    assert solve(frame(spark, x, y).where("false"), [Dual("linear", 1.0, 1.0)]).support.count() == 0
    twice = frame(spark, np.vstack([x, x]), np.concatenate([y, y])).withColumn("label", F.when(F.rand(1) < 2, F.col("label")))
    assert solve(twice, [Dual("rbf", 1.0, 1.0, (0, 1))]).gaps[0] < 1e-3


def test_candidate_tables(spark):
    from modelsift.plans.base import Problem
    from modelsift.plans.margins import Svm

    x, y = data()
    df = frame(spark, x, y).withColumn("fold", F.pmod(F.hash("features"), F.lit(3))).withColumn("row_id", F.lit("r"))
    svm = Svm(Problem("classification", [], classes=["a", "b", "c"]), {"pca_components": None})
    settings = [{"kernel": "linear", "C": 1.0, "gamma": "scale"}, {"kernel": "rbf", "C": 5.0, "gamma": "scale"}]
    scores = svm.score(df, df, settings)
    assert 0.5 < scores[0] < scores[1] <= 1
    svm.best, svm.model, svm.feature_names = settings[0], svm.build(df, settings[0]), ["u", "v", "w"]
    tables = svm.tailored(spark)
    assert tables["support_rows"].where("multiplier <= 0").isEmpty() and tables["coefficients"].count() == 9
    held = {(r["first"], r["second"]): 0 for r in tables["support_rows"].collect()}
    assert set(held) == {("a", "b"), ("a", "c"), ("b", "c")}
    told = svm.model.transform(df).collect()
    assert all(abs(r["probability"].toArray().sum() - 1) < 1e-9 for r in told)
    assert np.mean([np.argmax(r["probability"].toArray()) == r["label"] for r in told]) > 0.5


def test_passes_are_few_for_many_support_rows(spark):
    """Most rows lie outside the tube: the working set takes them together, not 192 variables a pass."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 4))
    y = 300 * x[:, 0] + 200 * rng.normal(size=800)
    df = spark.createDataFrame([(float(v), r.tolist()) for v, r in zip(y, x)], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    solved = kernel_dual.solve(df, [kernel_dual.Dual("linear", 1.0, 50.0), kernel_dual.Dual("rbf", 0.25, 10.0)], rounds=8)
    assert max(solved.gaps) < kernel_dual.TOLERANCE and solved.support.where("problem = 0").count() > 700
