"""Registered queries of the models, the tuners and the recommendation flow.

Every query reads its whole table and searches the default space of its model.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, neighbours, split
from ..operators.contraction import Cut, ends
from ..operators.growth import TreeSpec, grow, out_of_bag, outcome, prediction
from ..operators.nca import NcaReduce
from ..operators.reduce import PcaReduce, model_support, pca_report, rfe_support
from ..operators.scale import Scaler
from ..sources.tables import read_table
from . import tree_sql, tuning
from .base import FEATURES, FOLD, LABEL, ROW, Problem
from .bayes import GaussianNBModel, class_moments
from .ensemble import TreeEnsemble
from .linear import ElasticNet, moments, solve_elastic_net
from .margins import Svm
from .recommend import Outcome, Recommender, leaderboard_table, prediction_latency
from .registered import query, rounded
from .table_queries import LINE_KEY


def _customers(spark, sf) -> DataFrame:
    return read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _vectors(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias(ROW), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias(LABEL))


def _embedded(spark, sf) -> DataFrame:
    """Embeddings as numeric columns ``e0..e63`` with an 80/20 usable label."""
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])


def _lines(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")


def _scores(outcome: Outcome, spark) -> DataFrame:
    if not outcome.ok:
        raise RuntimeError(outcome.error)
    rows = [(outcome.name, k, float(v)) for k, v in sorted(outcome.metrics.items()) if v is not None]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def _fitted(df: DataFrame, target: str, name: str, config: dict, key, task: str = "auto") -> Outcome:
    rec = Recommender(task=task, key=key, configs={"*": config})
    prepared = rec.prepare(df, target)
    cls = next(c for c in _catalogue(prepared.problem.task) if name.lower() in c.label_for(prepared.problem.task).lower())
    return rec.train_one(cls, prepared, lambda p, m: None)


def _catalogue(task: str):
    from .registry import get_registered_models

    return get_registered_models(task)


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=FEATURES).transform(df)


# --- linear and Bayes -----------------------------------------------------------------------------------------------

_PATH = [(a, r) for a in (0.01, 1.0, 100.0) for r in (0.1, 0.5, 1.0)]


@query(
    "elastic_net_path",
    "with m as (select covar_pop(l_quantity, l_extendedprice) as c, var_pop(l_quantity) as v from lineitem), "
    "g as (select * from (values " + ", ".join(f"({a}::double, {r}::double)" for a, r in _PATH) + ") t(alpha, l1_ratio)) "
    "select alpha, l1_ratio, round(sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (v + alpha * (1 - l1_ratio)), 6) as coefficient from m, g",
)
def elastic_net_path(spark, sf):
    """One-feature path, where the solution has a closed form."""
    df = _assembled(_lines(spark, sf).withColumn(LABEL, F.col("l_extendedprice")), ["l_quantity"])
    _, _, c = moments(df)
    rows = [(a, r, float(solve_elastic_net(c[:1, :1], c[:1, 1], a * r, a * (1 - r))[0])) for a, r in _PATH]
    return rounded(spark.createDataFrame(rows, "alpha double, l1_ratio double, coefficient double"), coefficient=6)


@query("elastic_net")
def elastic_net(spark, sf):
    return _scores(_fitted(_lines(spark, sf), "l_extendedprice", "linear", {}, LINE_KEY), spark)


@query("logistic")
def logistic(spark, sf):
    return _scores(_fitted(_lines(spark, sf), "l_linestatus", "logistic", {}, LINE_KEY), spark)


_NB = ["l_quantity", "l_extendedprice", "l_tax"]


def _nb_sql() -> str:
    """Both class densities side by side on each row; the line key need not be unique."""
    stats = ", ".join(f"avg({c}) as m{i}, var_pop({c}) as v{i}" for i, c in enumerate(_NB))
    top = "(select greatest(" + ", ".join(f"var_pop({c})" for c in _NB) + ") from lineitem)"

    def joint(t: str) -> str:
        dens = " + ".join(f"ln(2 * pi() * ({t}.v{i} + 1e-6 * {top})) + power({c} - {t}.m{i}, 2) / ({t}.v{i} + 1e-6 * {top})" for i, c in enumerate(_NB))
        return f"ln({t}.n / (select count(*) from lineitem)::double) - 0.5 * ({dens})"

    keys = ", ".join(LINE_KEY)
    return (
        f"with s as (select l_linestatus as k, count(*) as n, {stats} from lineitem group by 1), "
        f"j as (select {keys}, {joint('a')} as f, {joint('b')} as o from lineitem, s a, s b where a.k = 'F' and b.k = 'O') "
        f"select {keys}, case when o > f then 1.0 else 0.0 end::double as prediction, round(1 / (1 + exp(f - o)), 6) as probability from j"
    )


@query("gaussian_nb", _nb_sql())
def gaussian_nb(spark, sf):
    df = _assembled(_lines(spark, sf).withColumn(LABEL, (F.col("l_linestatus") == "O").cast("double")), _NB)
    done = GaussianNBModel.of(class_moments(df), 1e-6, 2).transform(df)
    from pyspark.ml.functions import vector_to_array

    return done.select(*LINE_KEY, "prediction", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("probability"))


@query("naive_bayes")
def naive_bayes(spark, sf):
    return _scores(_fitted(_lines(spark, sf), "l_linestatus", "naive bayes", {}, LINE_KEY), spark)


@query("multinomial_nb")
def multinomial_nb(spark, sf):
    return _scores(_fitted(_lines(spark, sf), "l_linestatus", "naive bayes", {"model_type": "multinomial"}, LINE_KEY), spark)


# --- trees ----------------------------------------------------------------------------------------------------------


@query("tree")
def tree(spark, sf):
    return _scores(_fitted(_customers(spark, sf), "c_acctbal", "tree", {}, "c_custkey"), spark)


@query("tree_classifier")
def tree_classifier(spark, sf):
    return _scores(_fitted(_lines(spark, sf), "l_linestatus", "tree", {}, LINE_KEY), spark)


def _two_columns(spark, sf) -> DataFrame:
    df = _customers(spark, sf).withColumn(LABEL, (F.col("c_acctbal") > 4500).cast("double")).withColumn(ROW, F.col("c_custkey").cast("string"))
    return _assembled(df, ["c_nationkey", "c_custkey"])


_NODE_SQL = "with " + tree_sql.growth("customer", "c_custkey", "c_acctbal > 4500", ["c_nationkey", "c_custkey"], 8, classes=2, min_leaf=5)


def _grown(spark, sf) -> DataFrame:
    grown = grow(_two_columns(spark, sf), [TreeSpec(min_leaf=5, max_depth=8)], 2)
    grown.release()
    return grown.nodes


@query("tree_nodes", _NODE_SQL + " select tree, id, case when id > 1 then id // 2 end as parent, feature, threshold, case when s1 > s0 then 1.0 else 0.0 end as prediction, round(imp, 9) as impurity, n from nodes")
def tree_nodes(spark, sf):
    says = prediction(2, outcome(2))
    return _grown(spark, sf).select("tree", "id", "parent", "feature", "threshold", says.alias("prediction"), F.round("impurity", 9).alias("impurity"), "n")


_ALPHAS = (0.0, 0.0005, 0.001, 0.005, 0.01, 0.1)


@query("tree_pruning", f"{_NODE_SQL}, {tree_sql.pruning(8, _ALPHAS)} select alpha as ccp_alpha, count(*) as leaves, max(depth) as depth from ends group by alpha")
def tree_pruning(spark, sf):
    """Leaves and depth left at each complexity cost."""
    found = ends(_grown(spark, sf), [Cut(0, None, 2, a) for a in _ALPHAS]).select("setting", "end").distinct()
    costs = F.get(F.lit(list(_ALPHAS)), F.col("setting"))
    return found.groupBy("setting").agg(F.count(F.lit(1)).alias("leaves"), F.max(F.floor(F.log2("end"))).cast("int").alias("depth")).select(costs.alias("ccp_alpha"), "leaves", "depth")


@query(
    "tree_shapley",
    "with " + tree_sql.growth(f"(select *, concat_ws('|', {', '.join(LINE_KEY)}) as k from lineitem)", "k", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 4, classes=0, min_leaf=20) + ", "
    + tree_sql.shapley(3) + " select key as line, round(max(phi) filter (f = 0), 4) as quantity, round(max(phi) filter (f = 1), 4) as discount, round(max(phi) filter (f = 2), 4) as tax from phi group by key",
)
def tree_shapley(spark, sf):
    """What quantity, discount and tax add to the price that a tree of depth 4 tells, for every line."""
    lines = read_table(spark, sf, "lineitem").select(F.concat_ws("|", *LINE_KEY).alias(ROW), F.col("l_extendedprice").alias(LABEL), "l_quantity", "l_discount", "l_tax")
    df = _assembled(lines, ["l_quantity", "l_discount", "l_tax"])
    grown = grow(df, [TreeSpec(min_leaf=20, max_depth=4, criterion="variance")], 0)
    grown.release()
    told, _ = TreeEnsemble.of(grown.nodes, 1, 0).shapley(df.select(ROW, FEATURES), 3)
    return told.select(F.col(ROW).alias("line"), *[F.round(F.get(F.get("shapley", F.lit(0)), F.lit(i)), 4).alias(c) for i, c in enumerate(("quantity", "discount", "tax"))])


@query("forest_shapley")
def forest_shapley(spark, sf):
    """Mean size of what each feature adds to the class shares of a forest, over all lines."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = _lines(spark, sf).withColumn(ROW, F.concat_ws("|", *LINE_KEY)).withColumn(LABEL, (F.col("l_linestatus") == "O").cast("double"))
    df = _assembled(lines, columns)
    grown = grow(df, [TreeSpec(min_leaf=50, max_depth=5, tries=2, bag=True)] * 10, 2)
    grown.release()
    return TreeEnsemble.of(grown.nodes, 10, 2).shapley_importance(df, columns)


@query("forest")
def forest(spark, sf):
    return _scores(_fitted(_customers(spark, sf), "c_mktsegment", "forest", {}, "c_custkey"), spark)


@query(
    "out_of_bag",
    "with " + tree_sql.growth("customer", "c_custkey", "c_acctbal > 4500", ["c_nationkey", "c_acctbal"], 5, classes=2, trees=20, bag=True)
    + ", votes as (select key, sum(says[1]) / count(*) as a, sum(says[2]) / count(*) as b from at5 join nodes using (tree, id) where w = 0 group by key) "
    "select avg(((b > a)::int = y)::int) as oob_score, count(*) as rows from votes join base using (key)",
)
def out_of_bag_query(spark, sf):
    """Share of the rows that the trees whose bag lacks them vote right."""
    df = _customers(spark, sf).withColumn(LABEL, (F.col("c_acctbal") > 4500).cast("double")).withColumn(ROW, F.col("c_custkey").cast("string"))
    grown = grow(_assembled(df, ["c_nationkey", "c_acctbal"]), [TreeSpec(max_depth=5, bag=True)] * 20, 2)
    return out_of_bag(grown)


# --- margins --------------------------------------------------------------------------------------------------------


@query("svm")
def svm(spark, sf):
    df = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "n_chars", "lang", "source")
    return _scores(_fitted(df, "quality", "svm", {}, "doc_id"), spark)


@query("svr")
def svr(spark, sf):
    df = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    return _scores(_fitted(df, "p_retailprice", "svm", {}, "p_partkey"), spark)


@query("support_counts")
def support_counts(spark, sf):
    from .margins import support_table

    df = _vectors(spark, sf).withColumn(FEATURES, array_to_vector("x")).withColumn(LABEL, (F.col(LABEL) > 4).cast("double"))
    problem = Problem("classification", [], classes=[0, 1])
    model = Svm(problem, {})._fit(df, {"kernel": "linear", "C": 1.0, "gamma": "scale"})
    return support_table(model, df, problem)


# --- neighbours -----------------------------------------------------------------------------------------------------

_SPLIT_SQL = (
    "f as (select cast(vec_id as varchar) as id, embedding::double[] as x, label, "
    "row_number() over (order by md5(cast(vec_id as varchar) || '|42')) <= ceil(0.2 * count(*) over () - 1e-9) as t from embeddings), "
    "p as (select q.id as row_id, q.label as truth, b.id, b.label, list_distance(q.x, b.x) as d from f q join f b on q.t and not b.t), "
    "r as (select *, row_number() over (partition by row_id order by d, id) as rank from p)"
)


def _neighbour_split(spark, sf):
    return split.train_test_split(_vectors(spark, sf), key=ROW)


@query("knn_exact", f"with {_SPLIT_SQL} select row_id, cast(rank as int) as rank, id as neighbour, round(d, 6) as distance from r where rank <= 10")
def knn_exact(spark, sf):
    train, test = _neighbour_split(spark, sf)
    hits = neighbours.nearest(train.select(F.col(ROW).alias("id"), "x"), test.select("x"), 10)
    keyed = test.select(ROW, neighbours.vector_key(F.col("x")).alias("query"))
    return keyed.join(hits, "query").select(ROW, "rank", F.col("id").alias("neighbour"), F.round("distance", 6).alias("distance"))


@query(
    "knn_vote",
    f"with {_SPLIT_SQL}, v as (select row_id, label, sum(1 / d) as w from r where rank <= 7 group by 1, 2), "
    "b as (select *, row_number() over (partition by row_id order by w desc, label) as o, sum(w) over (partition by row_id) as s from v) "
    "select row_id, cast(label as double) as prediction, round(w / s, 6) as share from b where o = 1",
)
def knn_vote(spark, sf):
    train, test = _neighbour_split(spark, sf)
    rows = train.select(F.col(ROW).alias("id"), "x", LABEL)
    hits = neighbours.gathered(rows, neighbours.nearest(rows, test.select("x"), 7))
    shares = neighbours.vote(F.col("hits"), 7, "distance", 10)
    keyed = test.select(ROW, neighbours.vector_key(F.col("x")).alias("query"))
    voted = keyed.join(hits, "query").select(ROW, shares.alias("v"))
    return voted.select(ROW, neighbours.argmax(F.col("v")).alias("prediction"), F.round(F.array_max("v"), 6).alias("share"))


@query("knn")
def knn(spark, sf):
    return _scores(_fitted(_customers(spark, sf), "c_acctbal", "knn", {}, "c_custkey"), spark)


# --- selection and projection ---------------------------------------------------------------------------------------


def _standardised(spark, sf) -> DataFrame:
    cols = [f"e{i}" for i in range(64)]
    df = _embedded(spark, sf)
    return _assembled(Scaler(inputCols=cols).fit(df).transform(df), cols).withColumn(LABEL, F.col("label").cast("double"))


@query("select_rfe")
def select_rfe(spark, sf):
    df = _standardised(spark, sf).select(FEATURES, (F.col(LABEL) > 4).cast("double").alias(LABEL))
    kept = rfe_support(df, FEATURES, LABEL, keep=10)
    return spark.createDataFrame([(i,) for i in kept], "feature_index int")


@query("select_from_model")
def select_from_model(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier

    est = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=50, maxDepth=5, seed=42)
    kept = model_support(_standardised(spark, sf).select(FEATURES, LABEL), FEATURES, LABEL, est, "median")
    return spark.createDataFrame([(i,) for i in kept], "feature_index int")


@query("pca")
def pca(spark, sf):
    return pca_report(_standardised(spark, sf).select("vec_id", FEATURES), FEATURES, 0.95)[1]


@query(
    "pca_total",
    # the first two columns as correlated pair: shares are (1 + |r|) / 2 and (1 - |r|) / 2
    "with r as (select abs(corr(l_extendedprice, l_quantity * 1000 + l_extendedprice)) as r from lineitem) "
    "select 0 as component, round((1 + r) / 2, 6) as ratio, round((1 + r) / 2, 6) as cumulative from r union all select 1, round((1 - r) / 2, 6), 1.0 from r",
)
def pca_total(spark, sf):
    df = _lines(spark, sf).select("l_extendedprice", (F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("mix"))
    scaled = Scaler(inputCols=["l_extendedprice", "mix"]).fit(df).transform(df)
    out = pca_report(_assembled(scaled, ["l_extendedprice", "mix"]), FEATURES, 2)[1]
    return rounded(out.select("component", "ratio", "cumulative"), ratio=6, cumulative=6)


@query("pca_reconstruction")
def pca_reconstruction(spark, sf):
    return pca_report(_standardised(spark, sf).select("vec_id", FEATURES), FEATURES, 0.5, whiten=True)[2]


@query("nca")
def nca(spark, sf):
    df = _standardised(spark, sf).select("vec_id", FEATURES, LABEL)
    out = NcaReduce(inputCol=FEATURES, outputCol="nca", components=2).fit(df).transform(df)
    from pyspark.ml.functions import vector_to_array

    z = vector_to_array(F.col("nca"))
    return out.select("vec_id", F.get(z, F.lit(0)).alias("n0"), F.get(z, F.lit(1)).alias("n1"))


# --- tuning ---------------------------------------------------------------------------------------------------------


def _ridge_folds(spark, sf):
    """Line items with folds; features are scaled inside each fold, from the moments of its train rows."""
    base = _lines(spark, sf).withColumn(ROW, F.concat_ws("|", *LINE_KEY)).withColumn(LABEL, F.col("l_extendedprice"))
    df = split.fold_column(base, 3, ROW, output=FOLD)
    return df.select(*[F.col(c).alias(f"z{i}") for i, c in enumerate(("l_quantity", "l_discount", "l_tax", LABEL))], FOLD, ROW).persist(StorageLevel.MEMORY_AND_DISK)


def _fold_moments(df: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """``{fold: (rows, sums, sums of products)}`` about a common centre, in one aggregate."""
    centre = df.agg(*[F.avg(f"z{i}").alias(f"z{i}") for i in range(4)]).first()
    z = [F.col(f"z{i}") - F.lit(centre[f"z{i}"]) for i in range(4)]
    sums = [F.sum(z[i]).alias(f"s{i}") for i in range(4)] + [F.sum(z[i] * z[j]).alias(f"p{i}{j}") for i in range(4) for j in range(i + 1)]
    rows = df.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # one row a fold
    return {r[FOLD]: (r["n"], np.array([r[f"s{i}"] for i in range(4)]), np.array([[r[f"p{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])) for r in rows}


def _ridge_scores(df: DataFrame, settings: list[dict]) -> list[float]:
    """Minus the mean validation error of each setting: train moments are those of all rows less those of the fold."""
    by_fold, total = _fold_moments(df), [0.0] * len(settings)
    whole = tuple(sum(v[k] for v in by_fold.values()) for k in range(3))
    for n, s, p in by_fold.values():
        tn, ts, tp = (a - b for a, b in zip(whole, (n, s, p)))
        m, vm = ts / tn, s / n
        c, vc = tp / tn - np.outer(m, m), p / n - np.outer(vm, vm)
        unit = np.append(np.sqrt(np.diag(c)[:-1]), 1.0)
        unit[unit == 0] = 1.0
        c, vc, shift = c / np.outer(unit, unit), vc / np.outer(unit, unit), (vm - m) / unit
        for i, q in enumerate(settings):
            w = solve_elastic_net(c[:-1, :-1], c[:-1, -1], q["alpha"] * q["l1_ratio"], q["alpha"] * (1 - q["l1_ratio"]))
            bias = shift[-1] - shift[:-1] @ w
            total[i] -= float(vc[-1, -1] - 2 * w @ vc[:-1, -1] + w @ vc[:-1, :-1] @ w + bias * bias) / len(by_fold)
    return [v if np.isfinite(v) else -np.inf for v in total]


_GRID = {k: ElasticNet.defaults[k] for k in ("alpha", "l1_ratio")}


@query("grid_search")
def grid_search(spark, sf):
    df = _ridge_folds(spark, sf)
    return tuning.grid_search(_GRID, lambda s: _ridge_scores(df, s)).table(spark)


@query("random_search")
def random_search(spark, sf):
    df = _ridge_folds(spark, sf)
    return tuning.random_search(_GRID, lambda s: _ridge_scores(df, s), 10).table(spark)


@query("halving_search")
def halving_search(spark, sf):
    df = _ridge_folds(spark, sf)
    found = tuning.halving_search(_GRID, lambda s, share: _ridge_scores(tuning.hash_share(df, ROW, share), s))
    return tuning.Search(found.trials + found.dropped).table(spark)


@query("tpe_search")
def tpe_search(spark, sf):
    df = _ridge_folds(spark, sf)
    space = {"alpha": tuning.FloatRange(0.01, 100.0, log=True), "l1_ratio": tuning.FloatRange(0.0, 1.0)}
    return tuning.tpe_search(space, lambda s: _ridge_scores(df, s), n_trials=20, startup=10).table(spark)


# --- attribution and the whole flow ---------------------------------------------------------------------------------

_W = {"l_quantity": 2000.0, "l_discount": -500.0, "l_tax": 3000.0}


@query(
    "attribution_linear",
    " union all ".join(f"select '{c}' as feature, round(avg(abs({w} * ({c} - (select avg({c}) from lineitem)))), 6) as importance from lineitem" for c, w in _W.items()),
)
def attribution_linear(spark, sf):
    df = _assembled(_lines(spark, sf), list(_W))
    return rounded(attribution.linear_attribution(df, FEATURES, list(_W.values()), list(_W)), importance=6)


@query("attribution_permutation")
def attribution_permutation(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    df = _lines(spark, sf).withColumn("y", 2000 * F.col("l_quantity") + 3000 * F.col("l_tax")).withColumn(ROW, F.concat_ws("|", *LINE_KEY))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(_W), outputCol=FEATURES), LinearRegression(featuresCol=FEATURES, labelCol="y")]).fit(df)
    rmse = lambda d: d.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    return attribution.permutation_importance(model, df, list(_W), ROW, rmse)


@query(
    "leaderboard_order",
    "with m as (select o_orderpriority as name, avg(o_totalprice) as rmse from orders group by 1) "
    "select cast(row_number() over (order by rmse) as int) as rank, name, 'success' as status from m",
)
def leaderboard_order(spark, sf):
    """The ranking rule on a metric computed from the table."""
    rows = read_table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("rmse")).orderBy("o_orderpriority").collect()
    outcomes = [Outcome(r["o_orderpriority"], metrics={"rmse": r["rmse"]}) for r in rows]
    return leaderboard_table(spark, outcomes, "regression").select("rank", "name", "status")


def flagship(spark, sf) -> DataFrame:
    rec = Recommender(key=LINE_KEY)
    result = rec.run(_lines(spark, sf), "l_linestatus", include=["logistic, naive"])
    return result.leaderboard


@query("leaderboard")
def leaderboard(spark, sf):
    return flagship(spark, sf).select("rank", "name", "status", F.try_element_at("metrics", F.lit("f1")).alias("f1"), F.try_element_at("metrics", F.lit("cv_score")).alias("cv_score"))


@query("leaderboard_regression")
def leaderboard_regression(spark, sf):
    result = Recommender(key=LINE_KEY).run(_lines(spark, sf), "l_extendedprice", include=["linear, tree"])
    return result.leaderboard.select("rank", "name", "status", F.try_element_at("metrics", F.lit("rmse")).alias("rmse"), F.try_element_at("metrics", F.lit("r2")).alias("r2"))


@query("audit_log")
def audit_log(spark, sf):
    rec = Recommender(key="c_custkey")
    rec.run(_customers(spark, sf), "c_acctbal", include=["linear"])
    return rec.log.table(spark)


@query("scoring_latency")
def scoring_latency(spark, sf):
    df = _assembled(_lines(spark, sf).withColumn(LABEL, (F.col("l_linestatus") == "O").cast("double")), _NB)
    found = prediction_latency(GaussianNBModel.of(class_moments(df), 1e-6, 2), df)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")
