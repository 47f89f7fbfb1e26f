"""Registered queries of the table operators: schema, profile, leaks, encoders, selection, splits, metrics, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, encode, impute, leakage, metrics, outliers, scale, schema, select, split
from ..operators import profile as prof
from ..sources.tables import read_table
from .registered import query, rounded

PRICE = "l_extendedprice"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _line(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders")


# --- schema ---------------------------------------------------------------------------------------------------------


def _task_sql(table: str, floats: list[str], ints: list[str], texts: list[str], others: list[str]) -> str:
    parts = [f"select '{c}' as \"column\", 'regression' as task" for c in floats]
    parts += [f"select '{c}', 'classification'" for c in others]
    parts += [f"select '{c}', case when count(*) > count({c}) or count(distinct {c}) >= 20 then 'regression' else 'classification' end from {table}" for c in ints]
    parts += [
        f"select '{c}', case when count(*) filter (try_cast({c} as double) is null and {c} is not null) > 0 then 'classification' "
        f"when count(distinct {c}) < 20 then 'classification' else 'regression' end from {table}"
        for c in texts
    ]
    return " union all ".join(parts)


@query(
    "infer_task_types",
    _task_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_returnflag", "l_linestatus"], ["l_shipdate"])
    + " union all "
    + _task_sql("orders", ["o_totalprice"], ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
)
def infer_task_types(spark, sf):
    return schema.infer_task_types(_line(spark, sf)).unionAll(schema.infer_task_types(_orders(spark, sf)))


@query(
    "coerce_numeric_strings",
    """select o_orderkey, try_cast(cast(o_orderkey as varchar) as double) as key_text, try_cast(substr(o_orderpriority, 1, 1) as double) as rank_text,
       coalesce(case when o_custkey % 5 <> 0 then o_orderstatus end, 'nan') as status from orders""",
)
def coerce_numeric_strings(spark, sf):
    df = _orders(spark, sf).select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"), F.substring("o_orderpriority", 1, 1).alias("rank_text"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("status"),
    )
    return schema.coerce_numeric_strings(df)[0]


@query("coerce_target", "select o_orderkey, round(o_totalprice, 4) as price from orders")
def coerce_target(spark, sf):
    df = _orders(spark, sf).select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))
    return rounded(schema.coerce_target(df, "price"), price=4)


@query(
    "remainder_flags",
    "select o_orderkey, o_totalprice, cast(o_orderstatus = 'F' as double) as filled from orders",
)
def remainder_flags(spark, sf):
    df = _orders(spark, sf).select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("filled"))
    return schema.remainder(df, "passthrough")


@query("numeric_projection", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def numeric_projection(spark, sf):
    return schema.dtype_projection(_line(spark, sf), "numeric")


@query(
    "iqr_filter",
    """with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
       select event_id, event_type, value from events, q where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)""",
)
def iqr_filter(spark, sf):
    return outliers.iqr_filter(read_table(spark, sf, "events"), "value").select("event_id", "event_type", "value")


# --- profile --------------------------------------------------------------------------------------------------------


@query(
    "profile_size_sparsity",
    "select count(*) as n_samples, cast(10 as bigint) as n_features, count(*) / 10.0 as ratio, round(("
    + " + ".join(f"count(*) filter ({c} = 0)" for c in NUMS)
    + ") / (count(*) * 7.0), 8) as sparsity from lineitem",
)
def profile_size_sparsity(spark, sf):
    return rounded(prof.profile(_line(spark, sf), PRICE).select("n_samples", "n_features", "ratio", "sparsity"), sparsity=8)


@query(
    "profile_table",
    "with r as (" + " union all ".join(f"select abs(corr({c}, {PRICE})) as r from lineitem" for c in NUMS) + ") "
    "select (select count(*) from lineitem) as n_samples, false as is_gaussian, round(avg(r), 6) as linearity_score, round(max(r), 6) as max_linear_score from r",
)
def profile_table(spark, sf):
    df = prof.profile(_line(spark, sf), PRICE).select("n_samples", "is_gaussian", "linearity_score", "max_linear_score")
    return rounded(df, linearity_score=6, max_linear_score=6)


@query(
    "profile_linearity",
    " union all ".join(f"select '{c}' as feature, round(abs(corr({c}, {PRICE})), 6) as abs_r from lineitem" for c in NUMS),
)
def profile_linearity(spark, sf):
    return rounded(prof.linearity(_line(spark, sf), PRICE), abs_r=6)


@query(
    "profile_normality",
    """with m as (select 'value' as feature, avg(value) as a, var_pop(value) as v, count(value) as n from events),
       s as (select m.feature, m.n, avg(power(value - a, 3)) / power(any_value(v), 1.5) as sk, avg(power(value - a, 4)) / power(any_value(v), 2) - 3 as ku
             from events, m group by all)
       select feature, n, round(sk, 6) as skewness, round(ku, 6) as kurtosis, round(n / 6.0 * (sk * sk + ku * ku / 4), 3) as jarque_bera,
              round(exp(-n / 12.0 * (sk * sk + ku * ku / 4)), 6) as p_value from s""",
)
def profile_normality(spark, sf):
    return rounded(prof.normality(read_table(spark, sf, "events"), ["value"]), skewness=6, kurtosis=6, jarque_bera=3, p_value=6)


@query("profile_class_share", "select l_returnflag as class, count(*) as n, round(count(*) * 1.0 / (select count(*) from lineitem), 8) as share from lineitem group by 1")
def profile_class_share(spark, sf):
    return rounded(prof.class_share(_line(spark, sf), "l_returnflag"), share=8)


_RULE_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_rules",
    "with r as (" + " union all ".join(f"select abs(corr({c}, l_linenumber)) as r from lineitem" for c in _RULE_NUMS) + "), "
    "c as (select count(*) as n from lineitem group by l_linenumber), s as (select min(n) * 1.0 / sum(n) as share, count(*) as k from c), "
    "x as (select (select count(*) from lineitem) as n, (select max(r) from r) as m, share, k from s) "
    "select 'large_table' as rule, 'more than 20000 rows: margin and neighbour models will be slow' as message from x where n > 20000 "
    "union all select 'strong_linear', 'a feature is strongly linear in the target' from x where m > 0.7 "
    "union all select 'weak_linear', 'no feature is more than weakly linear in the target' from x where m < 0.2 and n > 100 "
    "union all select 'rare_class', 'rarest class holds ' || cast(round(share * 100, 1) as varchar) || ' percent of the rows' from x where k < 20 and share < 0.1",
)
def profile_rules(spark, sf):
    return prof.profile_rules(_line(spark, sf), "l_linenumber")


# --- leaks ----------------------------------------------------------------------------------------------------------


def _leaky(spark, sf):
    return _line(spark, sf).select(
        *NUMS, PRICE, (F.col(PRICE) * 2 + 1).alias("twice"), (F.col(PRICE) / F.col("l_quantity")).alias("unit_price"),
    )


@query(
    "leak_correlation",
    " union all ".join(
        f"select '{n}' as feature, round(abs(corr({e}, {PRICE})), 6) as abs_r, abs(corr({e}, {PRICE})) > 0.95 as leak from lineitem"
        for n, e in [*[(c, c) for c in NUMS], ("twice", f"{PRICE} * 2 + 1"), ("unit_price", f"{PRICE} / l_quantity")]
    ),
)
def leak_correlation(spark, sf):
    return rounded(leakage.correlation_leaks(_leaky(spark, sf), PRICE), abs_r=6)


def _identity_sql() -> str:
    cols = [*[(c, c) for c in NUMS], ("twice", f"({PRICE} * 2 + 1)"), ("unit_price", f"({PRICE} / l_quantity)")]
    parts = []
    for i, (n1, e1) in enumerate(cols):
        for n2, e2 in cols[i + 1 :]:
            parts.append(
                f"select '{n1}' as feature_a, '{n2}' as feature_b from lineitem "
                f"having bool_and(abs({e1} * {e2} - {PRICE}) <= 1e-8 + 1e-5 * abs({PRICE}))"
            )
    return " union all ".join(parts)


@query("leak_identity", _identity_sql())
def leak_identity(spark, sf):
    return leakage.identity_leaks(_leaky(spark, sf), PRICE)


def _priced(spark, sf):
    o = _orders(spark, sf)
    return o.select(
        "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), "o_orderpriority", "o_orderstatus",
        F.concat(F.lit("p"), F.col("o_orderpriority")).alias("mirror"), F.lit("x").alias("final_label"),
    )


@query(
    "leak_one_to_one",
    " union all ".join(
        f"select '{n}' as feature, count(distinct {e}) as n_feature, count(distinct substr(o_orderpriority, 1, 1)) as n_target, "
        f"count(distinct ({e}, substr(o_orderpriority, 1, 1))) as n_pairs, count(distinct {e}) = count(distinct substr(o_orderpriority, 1, 1)) and "
        f"count(distinct ({e}, substr(o_orderpriority, 1, 1))) = count(distinct {e}) as leak from orders"
        for n, e in [("o_orderpriority", "o_orderpriority"), ("o_orderstatus", "o_orderstatus"), ("mirror", "'p' || o_orderpriority"), ("final_label", "'x'")]
    ),
)
def leak_one_to_one(spark, sf):
    return leakage.one_to_one_leaks(_priced(spark, sf), "rank")


@query(
    "leak_name",
    "select 'final_label' as feature, count(distinct o_orderstatus) as n_values from orders "
    "union all select 'is_result_late', count(distinct o_totalprice > 100000) from orders",
)
def leak_name(spark, sf):
    """Columns that the name rule drops, with the values each of them would have given away."""
    df = _orders(spark, sf).select("o_custkey", F.col("o_totalprice").alias("output"), F.col("o_orderstatus").alias("final_label"), (F.col("o_totalprice") > 100000).alias("is_result_late"), F.col("o_orderpriority").alias("level"))
    named = leakage.name_leaks(df, "o_custkey")
    return df.agg(*[F.count_distinct(c).alias(c) for c in named]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values")) for c in named])))


@query(
    "leak_dropped",
    "select o_custkey, cast(substr(o_orderpriority, 1, 1) as int) as rank, o_orderstatus from orders",
)
def leak_dropped(spark, sf):
    return leakage.drop_leaks(_priced(spark, sf), "rank")[0]


@query("crosstab", "select o_orderstatus as feature_value, o_orderpriority as target_value, count(*) as n from orders group by 1, 2")
def crosstab(spark, sf):
    return leakage.crosstab(_orders(spark, sf), "o_orderstatus", "o_orderpriority")


# --- imputation, encoders, scaling ----------------------------------------------------------------------------------

_HOLES = "case when l_partkey % 7 = 0 then null else {c} end"
_KEYS = ", ".join(LINE_KEY)


def _holed(spark, sf, *cols):
    return _line(spark, sf).select(*LINE_KEY, *[F.when(F.col("l_partkey") % 7 != 0, F.col(c)).alias(c) for c in cols])


def _impute_sql(fills: dict[str, str]) -> str:
    holed = ", ".join(f"{_HOLES.format(c=c)} as {c}" for c in fills)
    return f"with h as (select {_KEYS}, {holed} from lineitem) select {_KEYS}, " + ", ".join(
        f"coalesce({c}, {e}) as {c}" for c, e in fills.items()
    ) + " from h"


@query("impute_median", _impute_sql({"l_tax": "(select median(l_tax) from h)", PRICE: f"(select median({PRICE}) from h)"}))
def impute_median(spark, sf):
    df = _holed(spark, sf, "l_tax", PRICE)
    return impute.Imputer(inputCols=["l_tax", PRICE], strategy="median").fit(df).transform(df)


@query("impute_mean", f"with x as ({_impute_sql({'l_tax': '(select avg(l_tax) from h)', PRICE: f'(select avg({PRICE}) from h)'})}) select {_KEYS}, round(l_tax, 6) as l_tax, round({PRICE}, 4) as {PRICE} from x")
def impute_mean(spark, sf):
    df = _holed(spark, sf, "l_tax", PRICE)
    out = impute.Imputer(inputCols=["l_tax", PRICE], strategy="mean").fit(df).transform(df)
    return rounded(out, l_tax=6, l_extendedprice=4)


_MODE = "(select {c} from h where {c} is not null group by 1 order by count(*) desc, {c} limit 1)"


@query("impute_mode", _impute_sql({c: _MODE.format(c=c) for c in ("l_tax", "l_returnflag")}))
def impute_mode(spark, sf):
    df = _holed(spark, sf, "l_tax", "l_returnflag")
    return impute.Imputer(inputCols=["l_tax", "l_returnflag"], strategy="most_frequent").fit(df).transform(df)


@query("impute_constant", _impute_sql({"l_returnflag": "'missing'"}))
def impute_constant(spark, sf):
    df = _holed(spark, sf, "l_returnflag")
    return impute.Imputer(inputCols=["l_returnflag"], strategy="constant", fillValue="missing").fit(df).transform(df)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _hot_sql(first: int) -> str:
    cols = [f"cast(o_orderstatus = '{v}' as double) as \"o_orderstatus_{v}\"" for v in STATUSES[first:]]
    cols += [f"cast(o_orderpriority = '{v}' as double) as \"o_orderpriority_{v}\"" for v in PRIORITIES[first:]]
    return "select o_orderkey, " + ", ".join(cols) + " from orders"


@query("one_hot", _hot_sql(0))
def one_hot(spark, sf):
    return encode.one_hot(_orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query("one_hot_drop_first", _hot_sql(1))
def one_hot_drop_first(spark, sf):
    df = _orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.one_hot(df, ["o_orderstatus", "o_orderpriority"], drop_first=True)


@query("ordinal", "select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as double) as p_brand, cast(dense_rank() over (order by p_type) - 1 as double) as p_type from part")
def ordinal(spark, sf):
    return encode.ordinal(read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query("ordinal_custom", "select o_orderkey, case o_orderstatus when 'O' then 0.0::double when 'P' then 1.0 when 'F' then 2.0 end as o_orderstatus from orders")
def ordinal_custom(spark, sf):
    return encode.ordinal(_orders(spark, sf).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["O", "P", "F"])


@query("label_encode", "select c_custkey, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as code from customer")
def label_encode(spark, sf):
    df = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.label_encode(df, "c_mktsegment", "code")[0].select("c_custkey", "code")


def _scaled(spark, sf, kind):
    df = _line(spark, sf).select(*LINE_KEY, "l_quantity", PRICE)
    out = scale.Scaler(inputCols=["l_quantity", PRICE], kind=kind).fit(df).transform(df)
    return rounded(out, l_quantity=6, l_extendedprice=6)


def _scale_sql(expr: str) -> str:
    cols = ", ".join(f"round({expr.format(c=c)}, 6) as {c}" for c in ("l_quantity", PRICE))
    return f"select {_KEYS}, {cols} from lineitem"


@query("scale_standard", _scale_sql("({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem)"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", _scale_sql("({c} - (select min({c}) from lineitem)) / (select max({c}) - min({c}) from lineitem)"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", _scale_sql("({c} - (select median({c}) from lineitem)) / (select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from lineitem)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("log1p", "select event_id, round(ln(1 + value), 8) as value, round(value, 6) as back from events")
def log1p(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", "value")
    model = scale.LogTransform(inputCols=["value"]).fit(df)
    logged = model.transform(df)
    return rounded(logged.withColumn("back", F.expm1("value")), value=8, back=6)


@query(
    "box_cox",
    """with t as (select event_id, (power(value + 1, 0.25) - 1) / 0.25 as t from events)
       select event_id, round((t - (select avg(t) from t)) / (select stddev_pop(t) from t), 6) as value from t""",
)
def box_cox(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", (F.col("value") + 1).alias("value"))
    return rounded(scale.PowerTransform(inputCols=["value"], method="box-cox", lambdas=[0.25]).fit(df).transform(df), value=6)


@query(
    "yeo_johnson",
    """with t as (select c_custkey, case when c_acctbal >= 0 then (power(1 + c_acctbal, 0.75) - 1) / 0.75 else -(power(1 - c_acctbal, 1.25) - 1) / 1.25 end as t from customer)
       select c_custkey, round((t - (select avg(t) from t)) / (select stddev_pop(t) from t), 6) as c_acctbal from t""",
)
def yeo_johnson(spark, sf):
    df = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.PowerTransform(inputCols=["c_acctbal"], method="yeo-johnson", lambdas=[0.75]).fit(df).transform(df), c_acctbal=6)


@query("power_lambdas")
def power_lambdas(spark, sf):
    """Fitted lambdas: Box-Cox for one plus the event values, Yeo-Johnson for the account balances."""
    ev, cu = read_table(spark, sf, "events").select((F.col("value") + 1).alias("value")), read_table(spark, sf, "customer")
    rows = [("value", "box-cox", scale.fit_lambdas(ev, ["value"], "box-cox")["value"]),
            ("c_acctbal", "yeo-johnson", scale.fit_lambdas(cu, ["c_acctbal"], "yeo-johnson")["c_acctbal"])]
    return spark.createDataFrame(rows, "feature string, method string, fitted double")


# --- selection ------------------------------------------------------------------------------------------------------

_FEATURES = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("select_variance", " union all ".join(f"select '{c}' as feature, round(var_pop({c}), 4) as variance from lineitem having var_pop({c}) > 0.01" for c in _FEATURES))
def select_variance(spark, sf):
    return rounded(select.above_variance(_line(spark, sf), _FEATURES, 0.01), variance=4)


@query(
    "select_f_regression",
    "with r as (" + " union all ".join(f"select '{c}' as feature, corr({c}, {PRICE}) as r, count(*) as n from lineitem" for c in _FEATURES)
    + ") select feature, round(r * r / (1 - r * r) * (n - 2), 6) as score from r order by score desc limit 3",
)
def select_f_regression(spark, sf):
    return rounded(select.k_best(_line(spark, sf), _FEATURES, PRICE, 3, "f_regression"), score=6)


@query(
    "select_f_classif",
    " union all ".join(
        f"(with g as (select l_returnflag, count(*) as n, avg({c}) as m, var_pop({c}) as v from lineitem group by 1), t as (select avg({c}) as m from lineitem) "
        f"select '{c}' as feature, round((sum(g.n * power(g.m - t.m, 2)) / (count(*) - 1)) / (sum(g.n * g.v) / (sum(g.n) - count(*))), 6) as score from g, t)"
        for c in _FEATURES
    ),
)
def select_f_classif(spark, sf):
    return rounded(select.k_best(_line(spark, sf), _FEATURES, "l_returnflag", 10, "f_classif"), score=6)


@query(
    "select_chi2",
    " union all ".join(
        f"(with g as (select l_returnflag, count(*) as n, sum({c}) as o from lineitem group by 1), e as (select o, n * 1.0 / sum(n) over () * sum(o) over () as e from g) "
        f"select '{c}' as feature, round(sum(power(o - e, 2) / e), 4) as score from e)"
        for c in _FEATURES
    ),
)
def select_chi2(spark, sf):
    return rounded(select.k_best(_line(spark, sf), _FEATURES, "l_returnflag", 10, "chi2"), score=4)


def _mi_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_tax"):
        probs = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
        parts.append(
            f"(with q as (select list_distinct(quantile_cont({c}, {probs})) as q from lineitem), "
            f"b as (select l_linestatus as y, len(list_filter(q, lambda x: {c} > x)) as b from lineitem, q), "
            "n as (select y, b, count(*) as n from b group by 1, 2), "
            "t as (select n, sum(n) over () as t, sum(n) over (partition by b) as nb, sum(n) over (partition by y) as ny from n) "
            f"select '{c}' as feature, round(sum(n / t * ln(n * t / (nb::double * ny))), 8) as score from t)"
        )
    return " union all ".join(parts)


@query("select_mutual_info", _mi_sql())
def select_mutual_info(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    return rounded(select.k_best(_line(spark, sf), cols, "l_linestatus", 10, "mutual_info_classif"), score=8)


# --- splits ---------------------------------------------------------------------------------------------------------

_MD5 = "md5(cast(o_orderkey as varchar) || '|42')"


@query(
    "split",
    f"select o_orderkey, row_number() over (order by {_MD5}) <= ceil(0.2 * count(*) over () - 1e-9) as is_test from orders",
)
def train_test(spark, sf):
    return split.train_test_flag(_orders(spark, sf).select("o_orderkey"), key="o_orderkey")


@query(
    "split_stratified",
    f"select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {_MD5}) <= floor(0.2 * count(*) over (partition by o_orderstatus) + 0.5) as is_test from orders",
)
def train_test_stratified(spark, sf):
    return split.train_test_flag(_orders(spark, sf).select("o_orderkey", "o_orderstatus"), key="o_orderkey", stratify="o_orderstatus")


@query("folds", f"select o_orderkey, cast((row_number() over (order by {_MD5}) - 1) * 3 // count(*) over () as int) as fold from orders")
def folds(spark, sf):
    return split.fold_column(_orders(spark, sf).select("o_orderkey"), key="o_orderkey")


@query(
    "folds_stratified",
    f"select o_orderkey, o_orderpriority, cast((row_number() over (partition by o_orderpriority order by {_MD5}) - 1) * 3 // count(*) over (partition by o_orderpriority) as int) as fold from orders",
)
def folds_stratified(spark, sf):
    return split.fold_column(_orders(spark, sf).select("o_orderkey", "o_orderpriority"), key="o_orderkey", stratify="o_orderpriority")


@query(
    "class_weights",
    "with c as (select event_type as class, count(*) as n from events group by 1) select class, n, round((select sum(n) from c)::double / ((select count(*) from c) * n), 8) as weight from c",
)
def class_weights(spark, sf):
    return rounded(split.class_weights(read_table(spark, sf, "events"), "event_type"), weight=8)


# --- metrics --------------------------------------------------------------------------------------------------------

_GUESS = "(2000 * l_quantity + 3000 * l_tax)"


def _regressed(spark, sf):
    return _line(spark, sf).select(F.col(PRICE).alias("y"), (2000 * F.col("l_quantity") + 3000 * F.col("l_tax")).alias("p"))


@query(
    "metrics_regression",
    f"""with b as (select {PRICE} as y, {_GUESS} as p from lineitem), s as (select avg(power(y - p, 2)) as mse, avg(abs(y - p)) as mae, 1 - avg(power(y - p, 2)) / var_pop(y) as r2, count(*) as n from b)
        select round(sqrt(mse), 4) as rmse, round(mae, 4) as mae, round(r2, 8) as r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 8) as adjusted_r2 from s""",
)
def metrics_regression(spark, sf):
    return rounded(metrics.regression_metrics(_regressed(spark, sf), "y", "p", 2), rmse=4, mae=4, r2=8, adjusted_r2=8)


def _classified(spark, sf):
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return _line(spark, sf).select(code.alias("y"), (F.floor(F.col("l_quantity")) % 4).cast("int").alias("p"))


_CLASSED = "b as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, cast(floor(l_quantity) % 4 as int) as p from lineitem)"
_PER_CLASS = (
    f"with {_CLASSED}, c as (select y as k from b union select p from b), "
    "t as (select k, (select count(*) from b where y = k) as s, (select count(*) from b where p = k) as q, (select count(*) from b where y = k and p = k) as tp from c), "
    "m as (select k, s, q, tp, case when q > 0 then tp / q::double else 0 end as pr, case when s > 0 then tp / s::double else 0 end as re, case when s + q > 0 then 2.0 * tp / (s + q) else 0 end as f1 from t) "
)


@query(
    "metrics_classification",
    _PER_CLASS
    + "select 'weighted' as average, round(sum(tp) / sum(s), 8) as accuracy, round(sum(pr * s) / sum(s), 8) as precision, round(sum(re * s) / sum(s), 8) as recall, round(sum(f1 * s) / sum(s), 8) as f1 from m "
    "union all select 'macro', round(sum(tp) / sum(s), 8), round(avg(pr), 8), round(avg(re), 8), round(avg(f1), 8) from m "
    "union all select 'micro', round(sum(tp) / sum(s), 8), round(sum(tp) / sum(s), 8), round(sum(tp) / sum(s), 8), round(sum(tp) / sum(s), 8) from m "
    "union all select 'binary', round(sum(tp) / sum(s), 8), round(max(pr) filter (k = 1), 8), round(max(re) filter (k = 1), 8), round(max(f1) filter (k = 1), 8) from m",
)
def metrics_classification(spark, sf):
    table = metrics.per_class(metrics.confusion_counts(_classified(spark, sf), "y", "p"))
    out = None
    for a in metrics.AVERAGES:
        part = metrics.averaged(table, a).select(F.lit(a).alias("average"), "accuracy", "precision", "recall", "f1")
        out = part if out is None else out.unionAll(part)
    return rounded(out, accuracy=8, precision=8, recall=8, f1=8)


@query(
    "metrics_per_class",
    _PER_CLASS + "select cast(k as double) as class, tp, s as support, q as predicted, round(pr, 8) as precision, round(re, 8) as recall, round(f1, 8) as f1 from m",
)
def metrics_per_class(spark, sf):
    table = metrics.per_class(metrics.confusion_counts(_classified(spark, sf), "y", "p"))
    return rounded(table, precision=8, recall=8, f1=8)


def _scored(spark, sf):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100 + 1
    total = q + t + 20
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return _line(spark, sf).select(
        code.alias("y3"), F.array(q / total, t / total, F.lit(20.0) / total).alias("p3"),
        (F.col("l_linestatus") == "O").cast("int").alias("y2"), (q / 50).alias("p2"),
    )


_SCORED = (
    "x as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y3, l_quantity as q, l_tax * 100 + 1 as t, l_quantity + (l_tax * 100 + 1) + 20 as s, "
    "cast(l_linestatus = 'O' as int) as y2, l_quantity / 50 as p2 from lineitem), "
    "w as (select y3, y2, p2, [q / s, t / s, 20.0::double / s] as p3 from x)"
)
_RANKED = "k as (select g, pos, rank() over (partition by g order by s) + (count(*) over (partition by g, s) - 1) / 2.0 as r from l), a as (select g, sum(case when pos then r end) as rs, count(*) filter (pos) as n1, count(*) filter (not pos) as n0 from k group by g), u as (select g, n1, n0, (rs - n1 * (n1 + 1) / 2.0) / (n1::double * n0) as auc from a)"


@query(
    "metrics_auc",
    f"(with {_SCORED}, l as (select 0 as g, y2 = 1 as pos, p2 as s from w), {_RANKED} select 'binary' as kind, round(auc, 8) as roc_auc from u) union all "
    f"(with {_SCORED}, l as (select i as g, y3 = i as pos, p3[i + 1] as s from w, range(3) t(i)), {_RANKED} select 'ovr', round(sum(auc * n1) / sum(n1), 8) from u) union all "
    f"(with {_SCORED}, z as (select a, b from range(3) t(a), range(3) s(b) where a <> b), l as (select a * 10 + b as g, y3 = a as pos, p3[a + 1] as s from w, z where y3 = a or y3 = b), {_RANKED} "
    "select 'ovo', round(avg(auc), 8) from u)",
)
def metrics_auc(spark, sf):
    df = _scored(spark, sf)
    parts = [
        ("binary", metrics.roc_auc(df, "y2", "p2")),
        ("ovr", metrics.roc_auc(df, "y3", "p3", 3, "ovr", "weighted")),
        ("ovo", metrics.roc_auc(df, "y3", "p3", 3, "ovo", "macro")),
    ]
    out = None
    for kind, d in parts:
        d = d.select(F.lit(kind).alias("kind"), "roc_auc")
        out = d if out is None else out.unionAll(d)
    return rounded(out, roc_auc=8)


@query("metrics_log_loss", f"with {_SCORED} select round(avg(-ln(greatest(least(p3[y3 + 1], 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 8) as log_loss from w")
def metrics_log_loss(spark, sf):
    return rounded(metrics.log_loss(_scored(spark, sf), "y3", "p3"), log_loss=8)


# --- diagnostics ----------------------------------------------------------------------------------------------------

_CORR = {c: c for c in [*NUMS, PRICE]}
_CORR["flag"] = "(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end)"


@query(
    "correlation_matrix",
    " union all ".join(
        f"select '{'l_returnflag' if a == 'flag' else a}' as feature_a, '{'l_returnflag' if b == 'flag' else b}' as feature_b, round(corr({ea}, {eb}), 6) as r from lineitem"
        for a, ea in _CORR.items() for b, eb in _CORR.items()
    ),
)
def correlation_matrix(spark, sf):
    return rounded(diagnostics.correlation_matrix(_line(spark, sf), "l_returnflag"), r=6)


def _hist_sql(table: str, c: str) -> str:
    return (
        f"(with s as (select count({c}) as n, min({c}) as lo, max({c}) as hi, stddev_samp({c}) as sd, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as iqr from {table}), "
        "p as (select *, cast(greatest(1, least(100, ceil((hi - lo) / least(2 * iqr / power(n, 1 / 3.0), (hi - lo) / (log2(n) + 1))))) as int) as k, sd * power(n, -0.2) as h from s), "
        f"c as (select cast(least(floor(({c} - lo) * k / (hi - lo)), k - 1) as int) as bin, count(*) as m from {table}, p group by 1), "
        "b as (select cast(i as int) as bin, coalesce(m, 0) as m, lo + (i + 0.5) * ((hi - lo) / k) as x, p.* from p, unnest(range(k)) t(i) left join c on c.bin = i) "
        f"select '{c}' as feature, a.bin, round(a.lo + a.bin * ((a.hi - a.lo) / a.k), 6) as lower, round(a.lo + (a.bin + 1) * ((a.hi - a.lo) / a.k), 6) as upper, any_value(a.m) as n, "
        "round(sum(z.m * exp(-power((a.x - z.x) / a.h, 2) / 2)) / any_value(a.n * a.h * sqrt(2 * pi())), 8) as density from b a, b z group by all)"
    )


@query("histogram", _hist_sql("lineitem", "l_quantity") + " union all " + _hist_sql("lineitem", "l_extendedprice"))
def histogram(spark, sf):
    return rounded(diagnostics.histogram(_line(spark, sf), ["l_quantity", PRICE]), lower=6, upper=6, density=8)


_CURVE = (
    "with b as (select cast(l_linestatus = 'O' as int) as y, l_extendedprice / 100000 as s from lineitem), g as (select s, sum(y) as pos, count(*) - sum(y) as neg from b group by 1), "
    "c as (select s, pos, sum(pos) over (order by s desc) as cp, sum(neg) over (order by s desc) as cn, sum(pos) over () as tp, sum(neg) over () as tn from g) "
)


def _curve(spark, sf):
    return _line(spark, sf).select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col(PRICE) / 100000).alias("s"))


@query(
    "roc_points",
    _CURVE + "select s as threshold, cn / tn::double as fpr, cp / tp::double as tpr from c union all select 'infinity'::double, 0.0, 0.0",
)
def roc_points(spark, sf):
    return diagnostics.roc_points(_curve(spark, sf), "y", "s")


@query("pr_points", _CURVE + "select s as threshold, cp / (cp + cn)::double as precision, cp / tp::double as recall from c union all select 'infinity'::double, 1.0, 0.0")
def pr_points(spark, sf):
    return diagnostics.pr_points(_curve(spark, sf), "y", "s")


@query("average_precision", _CURVE + "select round(sum(pos / tp::double * cp / (cp + cn)), 8) as average_precision from c")
def average_precision(spark, sf):
    return rounded(diagnostics.average_precision(_curve(spark, sf), "y", "s"), average_precision=8)


@query(
    "confusion_matrix",
    f"with {_CLASSED}, c as (select y as k from b union select p from b), n as (select y, p, count(*) as n from b group by 1, 2) "
    "select cast(a.k as double) as true_class, cast(z.k as double) as predicted_class, coalesce(n, 0) as n from c a cross join c z left join n on n.y = a.k and n.p = z.k",
)
def confusion_matrix(spark, sf):
    return diagnostics.confusion_matrix(_classified(spark, sf), "y", "p")


@query("residuals", f"select {_GUESS} as predicted, round({PRICE} - {_GUESS}, 6) as residual from lineitem")
def residuals(spark, sf):
    return rounded(diagnostics.residuals(_regressed(spark, sf), "y", "p"), residual=6)


@query("predicted_vs_actual", f"select {PRICE} as actual, {_GUESS} as predicted from lineitem")
def predicted_vs_actual(spark, sf):
    return diagnostics.predicted_vs_actual(_regressed(spark, sf), "y", "p")


@query("ideal_line", f"select least(min({PRICE}), min({_GUESS})) as low, greatest(max({PRICE}), max({_GUESS})) as high from lineitem")
def ideal_line(spark, sf):
    return diagnostics.value_range(_regressed(spark, sf), "y", "p")


def _qq_sql(points: int = 99) -> str:
    from statistics import NormalDist

    values = ", ".join(f"({p!r}::double, {NormalDist().inv_cdf(p)!r}::double)" for p in diagnostics.filliben(points))
    probs = "[" + ", ".join(repr(p) for p in diagnostics.filliben(points)) + "]"
    return (
        f"with v as (select * from (values {values}) t(p, x)), q as (select unnest({probs}) as p, unnest(quantile_cont({PRICE} - {_GUESS}, {probs})) as y from lineitem), "
        "j as (select x, y from v join q using (p)), f as (select regr_slope(y, x) as a, regr_intercept(y, x) as b, corr(x, y) as r from j) "
        "select round(x, 8) as theoretical, round(y, 4) as sample, round(a * x + b, 4) as fitted, round(a, 4) as slope, round(b, 4) as intercept, round(r, 8) as r from j, f"
    )


@query("qq_table", _qq_sql())
def qq_table(spark, sf):
    return rounded(diagnostics.qq_table(_regressed(spark, sf), "y", "p"), theoretical=8, sample=4, fitted=4, slope=4, intercept=4, r=8)


@query(
    "top_coefficients",
    "with c as (select p_brand as feature, avg(p_retailprice - 1000) / 100 as value from part group by 1) select feature, round(value, 6) as value from c order by abs(value) desc, feature limit 15",
)
def top_coefficients(spark, sf):
    table = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg(F.col("p_retailprice") - 1000) / 100).alias("coefficient"))
    return rounded(diagnostics.top_coefficients(table), value=6)


@query(
    "top_importances",
    "with c as (select p_brand as feature, sum(p_size) / 1000.0::double as importance from part group by 1) select feature, importance from c order by importance desc, feature limit 15",
)
def top_importances(spark, sf):
    table = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.sum("p_size") / 1000.0).alias("importance"))
    return diagnostics.top_importances(table)
