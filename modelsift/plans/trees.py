"""Decision tree with cost-complexity pruning, and random forest with its own out-of-bag score."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import settled
from ..operators.contraction import Cut, ends, pruned
from ..operators.growth import DEEPEST, Grown, TreeSpec, grow, out_of_bag, outcome, prediction
from ..operators.reduce import ModelSelect, vector_size
from .base import FEATURES, LABEL, ROW, Candidate, branch_stages, class_scores, error_scores, score_models
from .ensemble import TreeEnsemble
from .registry import register_model
from .tuning import Choice, IntRange, Search, random_search, tpe_search

TREES_AT_ONCE = 500  # trees grown side by side; a row keeps eight bytes for each once its places are written


@register_model("both")
class DecisionTree(Candidate):
    """Trees are grown once per leaf minimum and criterion, side by side; every depth, split minimum and pruning cost is cut from them.

    One scan of the validation rows counts labels per grown leaf, and a join with the leaves' ends scores all settings.
    """

    name = "Decision Tree"
    keyed = False  # no bag reads the key
    # fixed values: the default search lists
    defaults = {
        "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "ccp_alpha": [0.0, 0.001, 0.01, 0.1],
        "criterion": ["gini"], "encoding": "onehot", "feature_selection": "k_best", "k_best": 10, "n_iter": 10,
    }
    descriptions = {
        "max_depth": "deepest level", "min_samples_split": "fewest rows a node needs to split", "min_samples_leaf": "fewest rows in a leaf",
        "ccp_alpha": "cost per leaf in pruning", "criterion": "impurity measure",
    }
    IMPURITY = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy", "squared_error": "variance"}

    def __init__(self, problem, config=None):
        super().__init__(problem, config)
        self.name = self.label_for(problem.task)
        c = self.config["criterion"]
        c = [c] if isinstance(c, str) else list(c)
        known, fallback = (("gini", "entropy", "log_loss"), "gini") if problem.is_classification else (("squared_error",), "squared_error")
        self.criteria = [x for x in c if x in known] or [fallback]

    @classmethod
    def label_for(cls, task):
        return f"Decision Tree ({task.capitalize()})"

    def stages(self) -> list:
        c = self.config
        score = "f_classif" if self.problem.is_classification else "f_regression"
        select = {"k_best": (score, c["k_best"]), "variance": ("variance", 0)}.get(c["feature_selection"])
        return branch_stages(self.problem, select=select, encoding=c["encoding"])

    def run_search(self, evaluate) -> Search:
        keys = ("max_depth", "min_samples_split", "min_samples_leaf", "ccp_alpha")
        space = {k: self.config[k] for k in keys} | {"criterion": self.criteria}
        return random_search(space, evaluate, self.config["n_iter"], self.problem.seed)

    def _spec(self, setting: dict, depth: int | None) -> TreeSpec:
        return TreeSpec(setting["min_samples_leaf"], 2, depth or DEEPEST, self.IMPURITY[setting["criterion"]], seed=self.problem.seed)

    def score(self, train, valid, settings):
        classes = self.problem.n_classes
        groups: dict[tuple, list[dict]] = {}
        for s in settings:
            groups.setdefault((s["min_samples_leaf"], s["criterion"]), []).append(s)
        place = {key: t for t, key in enumerate(groups)}
        specs = [self._spec(members[0], max(s["max_depth"] or DEEPEST for s in members)) for members in groups.values()]
        grown = grow(train, specs, classes, LABEL, FEATURES, ROW)
        grown.release()
        cuts = [Cut(place[s["min_samples_leaf"], s["criterion"]], s["max_depth"], s["min_samples_split"], s["ccp_alpha"]) for s in settings]
        says = grown.nodes.select("tree", F.col("id").alias("end"), prediction(classes, outcome(classes)).alias("p"))
        found = ends(grown.nodes, cuts).join(says, ["tree", "end"])
        # outer: no filter on the size of the list, which would walk the rows a second time
        reached = TreeEnsemble.of(grown.nodes, len(specs), classes).leaves(valid.select(LABEL, FEATURES)).select(F.col(LABEL).alias("y"), F.posexplode_outer("leaves").alias("tree", "leaf"))
        if classes:
            counts = reached.groupBy("tree", "leaf", "y").agg(F.count(F.lit(1)).alias("n"))
            score = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")
        else:
            counts = reached.groupBy("tree", "leaf").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread"))
            score = -F.sqrt(F.sum(F.col("n") * (F.col("spread") + (F.col("mean") - F.col("p")) ** 2)) / F.sum("n"))
        got = {r["setting"]: r["score"] for r in counts.join(found, ["tree", "leaf"]).groupBy("setting").agg(score.alias("score")).collect()}
        return [got.get(i, -math.inf) for i in range(len(settings))]

    def build(self, frame, setting):
        grown = grow(frame, [self._spec(setting, setting["max_depth"])], self.problem.n_classes, LABEL, FEATURES, ROW)
        grown.release()
        cut = ends(grown.nodes, [Cut(0, setting["max_depth"], setting["min_samples_split"], setting["ccp_alpha"])])
        self.ensemble = TreeEnsemble.of(settled(pruned(grown.nodes, cut), "pruned"), 1, self.problem.n_classes, FEATURES)
        shape = self.ensemble.shape().first()
        self.depth, self.leaf_count = shape["depth"], shape["leaves"]
        return self.ensemble

    def tailored(self, spark):
        self._fitted()
        return {
            "importances": self.ensemble.importances(self.feature_names),
            "shape": spark.createDataFrame([(self.depth, self.leaf_count)], "depth int, leaves int"),
            "nodes": self.ensemble.nodes,
        }


@register_model("both")
class RandomForest(Candidate):
    """Bagged trees on the features a small forest finds at least as important as the median."""

    name = "Random Forest"
    # fixed values: the default search ranges
    defaults = {
        "n_estimators": (50, 200), "max_depth": (10, 20), "max_features": ("sqrt", "log2"), "min_samples_split": (2, 10),
        "min_samples_leaf": (1, 4), "selection_threshold": "median", "n_trials": 10,
    }
    descriptions = {
        "n_estimators": "number of trees", "max_depth": "deepest level", "max_features": "features tried per split",
        "min_samples_split": "fewest rows a node needs to split", "min_samples_leaf": "fewest rows in a leaf",
    }

    def __init__(self, problem, config=None):
        super().__init__(problem, config)
        self.name = self.label_for(problem.task)

    @classmethod
    def label_for(cls, task):
        return f"Random Forest ({task.capitalize()})"

    def stages(self) -> list:
        stages = branch_stages(self.problem)
        if self.config["selection_threshold"]:
            stages[-1].setOutputCol("_all")
            stages.append(ModelSelect(
                inputCol="_all", outputCol=FEATURES, labelCol=LABEL, kind="forest", threshold=str(self.config["selection_threshold"]),
                classes=self.problem.n_classes, seed=self.problem.seed,
            ))
        return stages

    def run_search(self, evaluate) -> Search:
        c = self.config
        space = {
            "n_estimators": IntRange(*c["n_estimators"]), "max_depth": IntRange(*c["max_depth"]), "max_features": Choice(c["max_features"]),
            "min_samples_split": IntRange(*c["min_samples_split"]), "min_samples_leaf": IntRange(*c["min_samples_leaf"]),
        }
        return tpe_search(space, evaluate, c["n_trials"], seed=self.problem.seed)

    def _specs(self, s: dict, width: int) -> list[TreeSpec]:
        tries = {"sqrt": math.isqrt(width), "log2": int(math.log2(max(width, 1)))}.get(s["max_features"], width)
        one = TreeSpec(s["min_samples_leaf"], s["min_samples_split"], s["max_depth"], "gini" if self.problem.is_classification else "variance", max(1, min(tries, width)), True, self.problem.seed)
        return [one] * s["n_estimators"]

    def _grow(self, frame: DataFrame, specs: list[TreeSpec]) -> Grown:
        weights = None
        if self.problem.is_classification:
            counts = {int(r[LABEL]): r["count"] for r in frame.groupBy(LABEL).count().collect()}  # one row per class
            weights = [sum(counts.values()) / (len(counts) * counts[c]) if c in counts else 1.0 for c in range(self.problem.n_classes)]
        return grow(frame, specs, self.problem.n_classes, LABEL, FEATURES, ROW, class_weights=weights)

    def score(self, train, valid, settings):
        width, models, batch = vector_size(train, FEATURES), [], []

        def finish() -> None:
            grown = self._grow(train, reduce(lambda a, b: a + b, batch, []))
            grown.release()
            first = 0
            for specs in batch:
                own = grown.nodes.where(F.col("tree").between(first, first + len(specs) - 1)).withColumn("tree", F.col("tree") - first)
                models.append(TreeEnsemble.of(own, len(specs), self.problem.n_classes))
                first += len(specs)

        for s in settings:
            specs = self._specs(s, width)
            if batch and sum(map(len, batch)) + len(specs) > TREES_AT_ONCE:
                finish()
                batch = []
            batch.append(specs)
        finish()
        return score_models(models, valid, class_scores if self.problem.is_classification else error_scores)

    def build(self, frame, setting):
        specs = self._specs(setting, vector_size(frame, FEATURES))
        grown = self._grow(frame, specs)
        self.oob = out_of_bag(grown).first()["oob_score"]
        grown.release()
        self.ensemble = TreeEnsemble.of(grown.nodes, len(specs), self.problem.n_classes, FEATURES)
        shape = self.ensemble.shape().agg(F.round(F.avg("depth")).cast("int").alias("depth"), F.round(F.avg("leaves")).cast("int").alias("leaves")).first()
        self.depth, self.leaf_count = shape["depth"], shape["leaves"]
        return self.ensemble

    def tailored(self, spark):
        self._fitted()
        return {
            "importances": self.ensemble.importances(self.feature_names),
            "oob": spark.createDataFrame([(self.oob,)], "oob_score double"),
            "first_tree": self.ensemble.nodes.filter("tree = 0"),
        }
