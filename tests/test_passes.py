"""What is worked out once must equal what was worked out again and again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from modelsift.functions.hashing import hash60
from modelsift.operators import schema, split
from modelsift.operators.scale import PowerTransform
from modelsift.plans import base, bayes, linear
from modelsift.plans.base import FEATURES, FOLD, LABEL, ROW, Problem
from modelsift.plans.recommend import Recommender


def vectors(spark, x, y):
    cols = [f"x{j}" for j in range(x.shape[1])]
    rows = [(str(i), float(t), i % 3, *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{ROW} string, {LABEL} double, {FOLD} int, " + ", ".join(f"{c} double" for c in cols))
    return VectorAssembler(inputCols=cols, outputCol=FEATURES).transform(df)


@pytest.fixture(scope="module")
def three_classes(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 4)) + y[:, None] / 2
    return vectors(spark, x, y).persist()


def picked(df, joint, codes):
    rows = df.select(LABEL, bayes.vector_to_array(FEATURES).alias("x"))
    got = rows.mapInArrow(bayes._tally(joint, codes), "setting int, y double, p double, n bigint").groupBy("setting", "y", "p").agg(F.sum("n").alias("n")).collect()
    return {(r["setting"], r["y"], r["p"]): r["n"] for r in got}


def told(df, models):
    got = {}
    for i, m in enumerate(models):
        for r in m.transform(df).groupBy(LABEL, "prediction").count().collect():
            got[(i, r[LABEL], r["prediction"])] = r["count"]
    return got


def test_gaussian_settings_of_one_scan_equal_the_models(three_classes):
    stats, smoothings = bayes.class_moments(three_classes), [1.0, 1e-3, 1e-9]
    models = [bayes.GaussianNBModel.of(stats, s, 3) for s in smoothings]
    assert picked(three_classes, bayes._gaussian_joint(stats, smoothings), stats["codes"]) == told(three_classes, models)


def test_long_and_short_sums_of_the_gaussian_agree(three_classes, monkeypatch):
    model = bayes.GaussianNBModel.of(bayes.class_moments(three_classes), 1e-3, 3)
    read = lambda: [tuple(r) for r in model.transform(three_classes).select(ROW, "prediction", "probability").orderBy(ROW).collect()]
    short = read()
    monkeypatch.setattr(bayes, "WRITTEN_OUT", 0)
    assert read() == short


def test_multinomial_settings_of_one_aggregate_equal_the_fits(three_classes):
    plain, alphas = bayes._clipped(three_classes), [0.01, 1.0, 10.0]
    counts, sums = bayes.class_sums(plain)
    models = [NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, smoothing=a).fit(plain) for a in alphas]
    # the unclipped rows: the tally raises negative features to zero itself
    assert picked(three_classes, bayes._multinomial_joint(counts, sums, alphas), [0.0, 1.0, 2.0]) == told(plain, models)


def test_tally_takes_the_first_of_equals_and_not_a_number_last(spark):
    df = vectors(spark, np.zeros((3, 1)), [0, 0, 1])
    def joint(x):
        yield np.tile([1.0, 1.0], (len(x), 1))
        yield np.tile([1.0, np.nan], (len(x), 1))
    assert picked(df, joint, [5.0, 7.0]) == {(0, 0.0, 5.0): 2, (0, 1.0, 5.0): 1, (1, 0.0, 7.0): 2, (1, 1.0, 7.0): 1}


def test_given_hashes_cut_as_worked_out_ones(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("double").alias("y"))
    ready = df.withColumns({"a": hash60(["k"], 42), "b": hash60(["k"], 43)})
    read = lambda d, c: {r["k"]: r[c] for r in d.collect()}
    for by in (None, "y"):
        assert read(split.train_test_flag(df, "k", by), "is_test") == read(split.train_test_flag(ready, "k", by, hashed="a"), "is_test")
        assert read(split.fold_column(df, 3, "k", by, 43), "fold") == read(split.fold_column(ready, 3, "k", by, 43, hashed="b"), "fold")


def test_many_classes_split_through_the_map(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 4).alias("y"))
    few = split.fold_column(df, 3, "id", "y").collect()
    monkeypatch.setattr(split, "FEW", 0)
    assert split.fold_column(df, 3, "id", "y").collect() == few


def test_preparation_reads_its_rows_from_one_cache(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    got = Recommender(key="id").prepare(df, "y")
    assert {"_test_hash", "_fold_hash"} <= set(got.cached[0].columns) and not {"_test_hash", "_fold_hash"} & {*got.train.columns, *got.test.columns}
    assert got.train.count() == 240 and got.test.count() == 60 and not set(r[ROW] for r in got.train.collect()) & set(r[ROW] for r in got.test.collect())


def test_text_beyond_the_first_rows_stays_text(spark):
    n = 10 * schema.SCREEN_ROWS
    df = spark.createDataFrame([(str(i), "x" if i == n - 1 else str(i), "x") for i in range(n)], "a string, b string, c string").coalesce(1)
    assert schema._unparsed(df, ["a", "b", "c"]) == {"c"}
    assert schema.coerce_numeric_strings(df)[1] == ["a"]
    assert {r["column"]: r["task"] for r in schema.infer_task_types(df).collect()} == {"a": "regression", "b": "classification", "c": "classification"}


def test_frames_read_once_are_not_held(spark, three_classes):
    kept = []
    for make in (linear.ElasticNet(Problem("regression", ["x0", "x1"])), bayes.NaiveBayesCandidate(Problem("classification", ["x0", "x1"], classes=[0, 1, 2]))):
        frame = make._fold_frame(three_classes.drop(FEATURES), 0)
        kept.append((frame.is_cached, frame.columns))
    assert kept == [(False, [LABEL, FOLD, FEATURES])] * 2


def test_large_logistic_folds_run_alone_with_the_same_scores(spark, three_classes, monkeypatch):
    df, config = three_classes.drop(FEATURES), {"C": [0.1, 1.0], "penalty": ["l1", "l2"]}
    problem = Problem("classification", ["x0", "x1", "x2"], classes=[0, 1, 2])
    many = linear.Logistic(problem, config).fit(df)
    monkeypatch.setattr(base, "SIDE_BY_SIDE", 10)
    alone = linear.Logistic(problem, config).fit(df)
    assert (many.width, alone.width) == (4, 1)
    assert [v for _, v in alone.search.trials] == pytest.approx([v for _, v in many.search.trials])


def test_power_of_a_given_logarithm(spark):
    df = spark.createDataFrame([(float(v),) for v in (-3.0, -0.5, 0.0, 0.25, 2.0, 9.0, 40.0)], "v double")
    assert PowerTransform(inputCols=["v"]).fit(df).transform(df).agg(F.abs(F.avg("v")) < 1e-9).first()[0]
