"""Target checks, task inference, numeric-string coercion, remainder policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, DataValidationError
from ..functions.columns import agg_row, boolean_columns, col, field_of, is_boolean, is_text, numeric_columns, parses, text_columns

CLASSIFICATION, REGRESSION = "classification", "regression"
FEW_LEVELS = 20  # fixed value: fewer distinct integers than this is a class label
NULL_TEXT = "nan"  # fixed value: what a null becomes when a text column is forced to strings
SCREEN_ROWS = 64


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise DataValidationError("target column not found", column=name, available=", ".join(df.columns))


def split_features(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Feature names and the target; both stay columns of one DataFrame."""
    require_column(df, target)
    return [c for c in df.columns if c != target], target


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def dtype_projection(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> DataFrame:
    pick = {"numeric": numeric_columns, "text": text_columns, "boolean": boolean_columns}
    if kind not in pick:
        raise ConfigurationError("unknown kind", kind=kind)
    return df.select(*[col(c) for c in pick[kind](df, exclude)])


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps have no treatment of their own; they are read as text."""
    when = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, when) else col(f.name) for f in df.schema.fields]
    )


def remainder(df: DataFrame, policy: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Booleans are neither numeric nor text: ``passthrough`` keeps them as 0/1, ``drop`` removes them."""
    flags = boolean_columns(df, exclude)
    if policy == "drop":
        return df.drop(*flags)
    if policy != "passthrough":
        raise ConfigurationError("unknown remainder policy", policy=policy)
    return df.withColumns({c: col(c).cast("double") for c in flags}) if flags else df


def _unparsed(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Text columns with a value that does not parse among a few rows, where a failed cast costs nothing; the rest needs a scan."""
    if not columns:
        return set()
    few = agg_row(df.select(*[col(c) for c in columns]).limit(SCREEN_ROWS), _unparsed_counts(columns))
    return {c for c in columns if few[c]}


def _unparsed_counts(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.count_if(parses(col(c)).isNull() & col(c).isNotNull()) for c in columns}


def infer_task_types(
    df: DataFrame, columns: Sequence[str] | None = None, nullable_int_is_float: bool = True, forced: str = "auto"
) -> DataFrame:
    """One row per column: ``(column, task)``.

    One scan takes null, unparsable and sketched distinct counts.  A column with fewer than 20 distinct values
    touches fewer than 20 registers of the sketch, so its estimate cannot exceed 20: a larger estimate proves
    "many levels" and only columns at or below it, whose level sets are small, are counted exactly.
    """
    spark = df.sparkSession
    columns = list(columns or df.columns)
    schema = "column string, task string"
    if forced != "auto":
        return spark.createDataFrame([(c, forced) for c in columns], schema)
    fixed: dict[str, str] = {}
    open_cols = []
    for c in columns:
        f = field_of(df, c)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            fixed[c] = REGRESSION
        elif is_boolean(f) or not (is_text(f) or isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))):
            fixed[c] = CLASSIFICATION
        else:
            open_cols.append(c)
    for c in _unparsed(df, [c for c in open_cols if is_text(field_of(df, c))]):
        fixed[c] = CLASSIFICATION
        open_cols.remove(c)
    exprs: dict[str, Column] = {}
    for c in open_cols:
        exprs[f"{c}|d"] = F.approx_count_distinct(col(c))
        exprs[f"{c}|null"] = F.count_if(col(c).isNull())
        if is_text(field_of(df, c)):
            exprs[f"{c}|bad"] = F.count_if(parses(col(c)).isNull() & col(c).isNotNull())
    seen = agg_row(df, exprs) if exprs else {}
    undecided = []
    for c in open_cols:
        if is_text(field_of(df, c)):
            if seen[f"{c}|bad"]:
                fixed[c] = CLASSIFICATION
                continue
        elif nullable_int_is_float and seen[f"{c}|null"]:
            fixed[c] = REGRESSION
            continue
        if seen[f"{c}|d"] > FEW_LEVELS:
            fixed[c] = REGRESSION
        else:
            undecided.append(c)
    if undecided:
        exact = agg_row(df, {c: F.count_distinct(col(c)) for c in undecided})
        for c in undecided:
            fixed[c] = CLASSIFICATION if exact[c] < FEW_LEVELS else REGRESSION
    return spark.createDataFrame([(c, fixed[c]) for c in columns], schema)


def infer_task_type(df: DataFrame, target: str, forced: str = "auto", nullable_int_is_float: bool = True) -> str:
    require_column(df, target)
    if forced != "auto":
        if forced not in (CLASSIFICATION, REGRESSION):
            raise ConfigurationError("unknown task type", task=forced)
        return forced
    return infer_task_types(df, [target], nullable_int_is_float).first()["task"]


def coerce_numeric_strings(
    df: DataFrame, exclude: Sequence[str] = (), string_nulls: str = "text"
) -> tuple[DataFrame, list[str]]:
    """Turn text columns whose every value parses into doubles; returns the names converted.

    Other text columns keep their values.  With ``string_nulls='text'`` a null becomes the level ``'nan'``;
    with ``'keep'`` it stays null for the mode imputer.
    """
    texts = text_columns(df, exclude)
    if not texts:
        return df, []
    plain = _unparsed(df, texts)
    open_texts = [c for c in texts if c not in plain]
    bad = agg_row(df, _unparsed_counts(open_texts)) if open_texts else {}
    numeric = [c for c in open_texts if bad[c] == 0]
    fill = {c: F.coalesce(col(c), F.lit(NULL_TEXT)) for c in texts if c not in numeric and string_nulls == "text"}
    cast = {c: F.nanvl(parses(col(c)), F.lit(None).cast("double")) for c in numeric}
    return df.withColumns({**fill, **cast}), numeric


def coerce_target(df: DataFrame, target: str) -> DataFrame:
    """Regression target as double; any value that is null or does not parse is an error with its count."""
    y = parses(col(target).cast("string")) if is_text(field_of(df, target)) else col(target).cast("double")
    out = df.withColumn(target, F.nanvl(y, F.lit(None).cast("double")))
    require_target_present(out, target)
    return out


def require_target_present(df: DataFrame, target: str) -> None:
    missing = df.agg(F.count_if(col(target).isNull()).alias("n")).first()["n"]
    if missing:
        raise DataValidationError("the target contains null or unparsable values", column=target, rows=missing)
