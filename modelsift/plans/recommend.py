"""From a DataFrame and a target to a ranked leaderboard."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataValidationError, PipelineError
from ..functions.columns import boolean_columns, col, numeric_columns, text_columns
from ..functions.hashing import digest, hash60, row_keys
from ..operators import attribution, diagnostics, leakage, metrics, outliers, split
from ..operators import profile as prof
from ..operators import schema
from ..operators.encode import label_encode
from ..operators.reduce import feature_names, vector_size
from . import candidates as _registered  # noqa: F401
from .base import FEATURES, FOLD, LABEL, ROW, Candidate, Problem
from .ensemble import TreeEnsemble
from .registry import get_registered_models

Progress = Callable[[int, str], None]
ROWS_PER_TASK = 20_000


@dataclass
class Log:
    """Audit trail of a run."""

    entries: list[tuple[str, str, float]] = field(default_factory=list)

    def add(self, step: str, details: str) -> None:
        self.entries.append((step, details, time.time()))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.entries, "step string, details string, seconds double")
        return rows.select("step", "details", F.timestamp_seconds("seconds").alias("ts"))


@dataclass
class Outcome:
    name: str
    candidate: Candidate | None = None
    metrics: dict[str, float] = field(default_factory=dict)
    error: str | None = None
    predictions: DataFrame | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def leaderboard_table(spark: SparkSession, outcomes: Sequence[Outcome], task: str) -> DataFrame:
    """``(rank, name, status, error, metrics)``: successes first, F1 falling or RMSE rising, a missing metric last."""
    rows = [(o.name, "success" if o.ok else "failed", o.error, {k: float(v) for k, v in o.metrics.items() if _number(v) is not None}, i) for i, o in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "name string, status string, error string, metrics map<string,double>, position int")
    if task == schema.CLASSIFICATION:
        key = F.coalesce(F.try_element_at("metrics", F.lit("f1")), F.lit(-1.0))
    else:
        key = -F.coalesce(F.try_element_at("metrics", F.lit("rmse")), F.lit(float("inf")))
    order = Window.orderBy((F.col("status") == "success").desc(), key.desc(), "position")  # one row per candidate
    return df.withColumn("rank", F.row_number().over(order)).select("rank", "name", "status", "error", "metrics").orderBy("rank")


def select_candidates(task: str, include: Sequence[str] | None = None) -> list[type[Candidate]]:
    """Case-insensitive substring filter; entries may hold several names separated by commas; no match means all."""
    every = get_registered_models(task)
    if not include:
        return every
    wanted = [w.strip().lower() for part in include for w in part.split(",") if w.strip()]
    kept = [c for c in every if any(w in c.label_for(task).lower() for w in wanted)]
    return kept or every


@dataclass
class Prepared:
    """Cleaned, flagged and split data."""

    problem: Problem
    train: DataFrame
    test: DataFrame
    rules: list[str]
    leaks: dict[str, str]
    dropped_rows: int
    cached: list[DataFrame] = field(default_factory=list)


@dataclass
class Result:
    task: str
    classes: list | None
    seconds: float
    outcomes: list[Outcome]
    leaderboard: DataFrame
    best: Outcome
    feature_names: list[str]
    diagnostics: dict[str, DataFrame]
    tailored: dict[str, DataFrame]
    parameters: DataFrame
    log: DataFrame
    prepared: Prepared
    explanations: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        spark = self.leaderboard.sparkSession
        summary = spark.createDataFrame(
            [(self.task, float(self.seconds), [str(c) for c in self.classes] if self.classes else None, self.best.name, self.feature_names)],
            "task string, seconds double, classes array<string>, best_model string, feature_names array<string>",
        )
        groups = (("diagnostic", self.diagnostics), ("tailored", self.tailored), ("explanation", self.explanations))
        named = {f"{g}_{k}": v for g, tables in groups for k, v in tables.items()}
        return {"summary": summary, "leaderboard": self.leaderboard, "parameters": self.parameters, "log": self.log, **named}

    def write(self, path: str, format: str = "parquet") -> None:
        """Every table in its own folder, and the fitted pipeline of the best model under ``model``."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").format(format).save(f"{path}/{name}")
        self.best.candidate.export(f"{path}/model")

    def release(self) -> None:
        for df in [*self.prepared.cached, *[o.predictions for o in self.outcomes if o.predictions is not None]]:
            df.unpersist()


class Recommender:
    """``task`` forces the task; ``configs`` holds settings per candidate name substring; ``key`` names the row key."""

    def __init__(
        self, task: str = "auto", seed: int = 42, folds: int = 3, key: Sequence[str] | str | None = None, configs: dict[str, dict] | None = None,
        string_nulls: str = "text",
    ):
        self.task, self.seed, self.folds, self.key = task, seed, folds, key
        self.configs, self.string_nulls = configs or {}, string_nulls
        self.log = Log()

    # --- preparation

    def prepare(self, df: DataFrame, target: str) -> Prepared:
        if target not in df.columns:
            raise DataValidationError("target column not found", column=target, available=", ".join(df.columns))
        keys = row_keys(df, self.key)
        # the key of a row is its own digest from here on; named key columns are not features
        tagged = df.withColumn(ROW, digest(keys, self.seed))
        if self.key is not None:
            tagged = tagged.drop(*[k for k in keys if k != target])
        tagged = schema.dates_as_text(tagged)
        tagged, converted = schema.coerce_numeric_strings(tagged, [target, ROW], self.string_nulls)
        if converted:
            self.log.add("Numeric text", f"converted {', '.join(converted)}")
        task = schema.infer_task_type(tagged, target, self.task)
        self.log.add("Task", task)
        dropped = 0
        if task == schema.REGRESSION:
            bounds = outliers.iqr_bounds(tagged, target) if target in numeric_columns(tagged) else None
            if bounds:
                inside = col(target).between(*bounds)
                n = tagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("k")).first()
                dropped = n["n"] - n["k"]
                if n["k"] == 0:
                    raise DataValidationError("the target has no usable value", column=target, rows=n["n"])
                tagged = tagged.filter(inside)
            self.log.add("Outliers", f"removed {dropped} rows outside the quartile whiskers or without a target")
        features = tagged.drop(ROW)
        rules = [r["message"] for r in prof.profile_rules(features, target).collect()]
        for m in rules:
            self.log.add("Profile", m)
        leaks = leakage.find_leaks(features, target)
        tagged = tagged.drop(*leaks)
        self.log.add("Leakage", f"removed {', '.join(f'{k} ({v})' for k, v in sorted(leaks.items()))}" if leaks else "no leaking feature")
        schema.require_target_present(tagged, target) if task == schema.CLASSIFICATION else None
        classes = None
        if task == schema.CLASSIFICATION:
            coded, classes = label_encode(tagged, target, LABEL)
            coded = coded.withColumn(LABEL, F.col(LABEL).cast("double"))
            if target != LABEL:
                coded = coded.drop(target)
            self.log.add("Target", f"encoded {len(classes)} classes")
        else:
            coded = schema.coerce_target(tagged, target)
            if target != LABEL:
                coded = coded.withColumnRenamed(target, LABEL)
        flags = boolean_columns(coded)
        problem = Problem(
            task, numeric_columns(coded, [LABEL]), text_columns(coded, [ROW]), flags, classes, self.seed, self.folds,
        )
        coded = schema.remainder(coded, "passthrough")
        # a different seed, so that folds are not nested in the split order
        hashes = {"_test_hash": hash60([ROW], self.seed), "_fold_hash": hash60([ROW], self.seed + 1)}
        # the digests are worked out once; split, folds and all that follows read them and the rows from this one cache
        slim = coded.select(ROW, LABEL, *[col(c) for c in [*problem.numeric, *problem.text, *problem.flags]], *[h.alias(k) for k, h in hashes.items()])
        slim = slim.persist(StorageLevel.MEMORY_AND_DISK)
        by, levels = (LABEL, [float(i) for i in range(len(classes))]) if classes else (None, None)
        flagged = split.train_test_flag(slim, key=ROW, stratify=by, seed=self.seed, output="_test", levels=levels, hashed="_test_hash")
        # the test rows are a fifth of the cache and read again and again, so they get a place of their own
        test = flagged.filter("_test").drop("_test", *hashes).persist(StorageLevel.MEMORY_AND_DISK)
        rest = flagged.filter("not _test").drop("_test")
        train = split.fold_column(rest, self.folds, ROW, by, self.seed + 1, FOLD, levels, hashed="_fold_hash").drop(*hashes)
        cached = [slim, test]
        size = train.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts")).first()
        n_train, parts = size["n"], size["parts"]
        # many short jobs follow: a small table is better served by few tasks, an unsplit one by more
        wanted = max(1, math.ceil(n_train / ROWS_PER_TASK))
        if wanted < parts:
            train = train.coalesce(wanted)
        elif parts < min(wanted, slim.sparkSession.sparkContext.defaultParallelism):
            train = train.repartition(min(wanted, slim.sparkSession.sparkContext.defaultParallelism), ROW)
        self.log.add("Split", f"train {n_train} rows, test {test.count()} rows")
        return Prepared(problem, train, test, rules, leaks, dropped, cached)

    # --- candidates

    def _config(self, name: str) -> dict:
        out: dict = {}
        for part, cfg in self.configs.items():
            if part == "*" or part.lower() in name.lower():
                out.update(cfg)
        return out

    def train_one(self, cls: type[Candidate], prepared: Prepared, report: Progress) -> Outcome:
        """Any failure of one candidate becomes a failed row."""
        name = cls.label_for(prepared.problem.task)
        try:
            report(40, f"training {name}")
            model = cls(prepared.problem, self._config(name))
            name = model.name
            model.fit(prepared.train)
            report(80, f"evaluating {name}")
            done = model.predict(prepared.test)
            keep = [LABEL, ROW, "prediction"] + (["probability"] if "probability" in done.columns else [])
            model.feature_names = feature_names(done, FEATURES)
            predictions = done.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
            found = evaluate(predictions, prepared.problem, vector_size(done, FEATURES))
            found["cv_score"] = model.search.best[1]
            for k in ("depth", "leaf_count"):
                if hasattr(model, k):
                    found[k] = float(getattr(model, k))
            if getattr(model, "oob", None) is not None:
                found["oob_score"] = float(model.oob)
            report(100, f"finished {name}")
            return Outcome(name, model, found, None, predictions)
        except Exception as e:  # noqa: BLE001 - one candidate must not end the run
            return Outcome(name, error=f"{type(e).__name__}: {str(e)[:500]}")

    def run(self, df: DataFrame, target: str, include: Sequence[str] | None = None, progress: Progress | None = None, latency_runs: int = 0, explain: bool = True) -> Result:
        """``explain`` adds what shows the data and the best candidate: correlations, histograms, trials, attribution, neighbours."""
        start, spark = time.time(), df.sparkSession
        tell = progress or (lambda p, m: None)
        self.log.add("Start", f"{len(df.columns)} columns")
        prepared = self.prepare(df, target)
        chosen = select_candidates(prepared.problem.task, include)
        tell(10, f"training {len(chosen)} candidates")
        outcomes = []
        for i, cls in enumerate(chosen):
            def part(p: int, m: str, i: int = i) -> None:
                tell(int(10 + (i + p / 100) * 80 / len(chosen)), m)

            o = self.train_one(cls, prepared, part)
            if o.ok and latency_runs:
                o.metrics.update(prediction_latency(o.candidate.model, prepared.test, latency_runs))
            outcomes.append(o)
            self.log.add("Candidate" if o.ok else "Candidate failed", o.name if o.ok else f"{o.name}: {o.error}")
        best = best_outcome(outcomes, prepared.problem.task)
        tables = diagnostic_tables(best.predictions, prepared.problem)
        self.log.add("Diagnostics", f"best candidate {best.name}")
        explained = explanation_tables(best, prepared) if explain else {}
        if explain:
            self.log.add("Explanations", ", ".join(sorted(explained)))
        tailored = best.candidate.tailored(spark)
        tell(100, f"best candidate {best.name}")
        return Result(
            prepared.problem.task, prepared.problem.classes, time.time() - start, outcomes, leaderboard_table(spark, outcomes, prepared.problem.task), best,
            best.candidate.feature_names, tables, tailored, best.candidate.parameters(spark), self.log.table(spark), prepared, explained,
        )


def best_outcome(outcomes: Sequence[Outcome], task: str) -> Outcome:
    ok = [o for o in outcomes if o.ok]
    if not ok:
        raise PipelineError("every candidate failed", errors="; ".join(f"{o.name}: {o.error}" for o in outcomes))
    if task == schema.CLASSIFICATION:
        return max(ok, key=lambda o: v if (v := _number(o.metrics.get("f1"))) is not None else 0.0)
    return min(ok, key=lambda o: v if (v := _number(o.metrics.get("rmse"))) is not None else math.inf)


def evaluate(predictions: DataFrame, problem: Problem, n_features: int) -> dict[str, float]:
    """The full metric set of a task, the same for every candidate."""
    if not problem.is_classification:
        return metrics.regression_metrics(predictions, LABEL, "prediction", n_features).first().asDict()
    out = metrics.classification_metrics(predictions, LABEL, "prediction").first().asDict()
    out["mae"] = predictions.agg(F.avg(F.abs(F.col(LABEL) - F.col("prediction")))).first()[0]
    if "probability" in predictions.columns:
        out.update(metrics.roc_auc(predictions, LABEL, "probability", problem.n_classes).first().asDict())
        out.update(metrics.log_loss(predictions, LABEL, "probability").first().asDict())
    return out


def prediction_latency(model: PipelineModel, df: DataFrame, runs: int = 3) -> dict[str, float]:
    """Mean seconds to score the whole set into a sink that discards it, after one warm-up, and rows per second."""
    def once() -> float:
        t = time.perf_counter()
        model.transform(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    once()
    mean = sum(once() for _ in range(runs)) / runs
    return {"latency_seconds": mean, "rows_per_second": df.count() / mean}


def explanation_tables(best: Outcome, prepared: Prepared) -> dict[str, DataFrame]:
    """Data tables over the train rows, the trials of the best candidate, and how much each raw column adds on the test rows."""
    spark, problem = prepared.train.sparkSession, prepared.problem
    out = {"trials": best.candidate.search.table(spark)}
    if problem.numeric:
        out["correlation_matrix"] = diagnostics.correlation_matrix(prepared.train.select(LABEL, *[col(c) for c in problem.numeric]), LABEL)
        out["histograms"] = diagnostics.histogram(prepared.train, problem.numeric)
    columns = [*problem.numeric, *problem.text, *problem.flags]
    if problem.is_classification:
        loss = lambda d: d.agg(F.avg((F.col(LABEL) != F.col("prediction")).cast("double"))).first()[0] or 0.0
    else:
        loss = lambda d: d.agg(F.sqrt(F.avg((F.col(LABEL) - F.col("prediction")) ** 2))).first()[0] or 0.0
    if columns:
        out["attribution"] = attribution.permutation_importance(best.candidate.model, prepared.test, columns, ROW, loss, problem.seed)
    if isinstance(best.candidate.model.stages[-1], TreeEnsemble):
        ready = PipelineModel(best.candidate.model.stages[:-1]).transform(prepared.test)
        out["shapley"] = diagnostics.top_importances(best.candidate.model.stages[-1].shapley_importance(ready, best.candidate.feature_names), attribution.TOP)
    if hasattr(best.candidate, "inspected"):
        out["neighbours"] = best.candidate.inspected(prepared.test)
    return out


def diagnostic_tables(predictions: DataFrame, problem: Problem) -> dict[str, DataFrame]:
    if not problem.is_classification:
        return {
            "predicted_vs_actual": diagnostics.predicted_vs_actual(predictions, LABEL, "prediction"),
            "residuals": diagnostics.residuals(predictions, LABEL, "prediction"), "qq": diagnostics.qq_table(predictions, LABEL, "prediction"),
        }
    out = {"confusion_matrix": diagnostics.confusion_matrix(predictions, LABEL, "prediction", problem.classes)}
    if problem.n_classes == 2 and "probability" in predictions.columns:
        from pyspark.ml.functions import vector_to_array

        scored = predictions.select(LABEL, F.get(vector_to_array(F.col("probability")), F.lit(1)).alias("score"))
        out["roc_points"] = diagnostics.roc_points(scored, LABEL, "score")
        out["pr_points"] = diagnostics.pr_points(scored, LABEL, "score")
    return out
