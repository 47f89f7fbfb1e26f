"""Categorical encoders and the target label encoder."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DataValidationError
from ..functions.columns import agg_row, col, field_of, is_boolean, is_numeric
from .stages import ColumnEstimator, ColumnModel

MAX_LEVELS = 1000  # widest level set an encoder accepts


def require_few_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> None:
    """Refuse a level explosion before any level set is brought to the driver; one scan, sketched."""
    if not columns:
        return
    seen = agg_row(df, {c: F.approx_count_distinct(col(c), 0.02) for c in columns})
    for c, n in seen.items():
        if n > 1.2 * limit:
            raise ConfigurationError("too many levels to encode", column=c, estimate=n, limit=limit)


def sorted_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted non-null levels of each column, at most ``limit`` of them."""
    require_few_levels(df, columns, limit)
    if not columns:
        return {}
    # set size is bounded by the check above
    row = df.agg(*[F.sort_array(F.collect_set(col(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = {c: list(row[i]) for i, c in enumerate(columns)}
    for c, levels in out.items():
        if len(levels) > limit:
            raise ConfigurationError("too many levels to encode", column=c, levels=len(levels), limit=limit)
    return out


class OneHotModel(ColumnModel):
    """Replaces each input column by 0/1 columns named ``column_level``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.fitted()
        strict = st.pop("", None)
        out = []
        for f in df.schema.fields:
            if f.name not in st:
                out.append(col(f.name))
                continue
            kept, known = st[f.name]
            c = col(f.name)
            if strict:
                ok = c.isin(known) | F.raise_error(F.concat(F.lit(f"unknown level in {f.name}: "), c.cast("string"))).cast("boolean")
                c = F.when(ok, c)
            for level in kept:
                out.append(F.coalesce((c == F.lit(level)).cast("double"), F.lit(0.0)).alias(f"{f.name}_{level}"))
        return df.select(*out)


class OneHot(ColumnEstimator):
    dropFirst = Param(Params._dummy(), "dropFirst", "leave out the first level", TypeConverters.toBoolean)
    handleUnknown = Param(Params._dummy(), "handleUnknown", "ignore or error", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "widest level set accepted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, dropFirst=False, handleUnknown="ignore", maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(dropFirst=False, handleUnknown="ignore", maxLevels=MAX_LEVELS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> OneHotModel:
        columns, unknown = self.getInputCols(), self.getOrDefault(self.handleUnknown)
        if unknown not in ("ignore", "error"):
            raise ConfigurationError("handleUnknown is ignore or error", value=unknown)
        levels = sorted_levels(df, columns, self.getOrDefault(self.maxLevels))
        first = 1 if self.getOrDefault(self.dropFirst) else 0
        st: dict = {c: [v[first:], v] for c, v in levels.items()}
        if unknown == "error":
            st[""] = True
        return OneHotModel.of(columns, st)


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, drop_first: bool = False, handle_unknown: str = "ignore") -> DataFrame:
    """Table in, table out."""
    columns = list(columns or df.columns)
    return OneHot(inputCols=columns, dropFirst=drop_first, handleUnknown=handle_unknown).fit(df).transform(df)


class OrdinalModel(ColumnModel):
    def expression(self, c: Column, st) -> Column:
        levels, unknown = st
        pos = F.array_position(F.lit(levels), c) if levels else F.lit(0)
        code = F.when(pos > 0, (pos - 1).cast("double"))
        if unknown is None:
            return F.when(code.isNotNull(), code).otherwise(
                F.raise_error(F.concat(F.lit("level not in the given order: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("double")
            )
        return F.coalesce(code, F.lit(float(unknown)))


class Ordinal(ColumnEstimator):
    """Codes 0..k-1 in sorted or given order; an unknown value becomes ``unknownValue``."""

    categories = Param(Params._dummy(), "categories", "given orders as JSON", TypeConverters.toString)
    unknownValue = Param(Params._dummy(), "unknownValue", "code of an unseen value", TypeConverters.toInt)
    handleUnknown = Param(Params._dummy(), "handleUnknown", "use_encoded_value or error", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "widest level set accepted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, categories=None, unknownValue=-1, handleUnknown="use_encoded_value", maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(categories="", unknownValue=-1, handleUnknown="use_encoded_value", maxLevels=MAX_LEVELS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> OrdinalModel:
        columns = self.getInputCols()
        given = self.getOrDefault(self.categories)
        levels = dict(zip(columns, json.loads(given))) if given else sorted_levels(df, columns, self.getOrDefault(self.maxLevels))
        mode = self.getOrDefault(self.handleUnknown)
        if mode not in ("use_encoded_value", "error"):
            raise ConfigurationError("handleUnknown is use_encoded_value or error", value=mode)
        unknown = self.getOrDefault(self.unknownValue) if mode == "use_encoded_value" else None
        return OrdinalModel.of(columns, {c: [list(v), unknown] for c, v in levels.items()})


def ordinal(df: DataFrame, columns: Sequence[str] | None = None, categories="auto") -> DataFrame:
    """Table in, table out; a flat list of strings is the order of every column, an unseen value is an error."""
    columns = list(columns or df.columns)
    if isinstance(categories, str):
        if categories != "auto":
            raise TypeError("categories must be 'auto' or an iterable of orders")
        return Ordinal(inputCols=columns).fit(df).transform(df)
    try:
        orders = list(categories)
    except TypeError:
        raise TypeError("categories must be 'auto' or an iterable of orders") from None
    if orders and all(isinstance(v, str) for v in orders):
        orders = [orders] * len(columns)
    if len(orders) != len(columns):
        raise ConfigurationError("one order per column is needed", columns=len(columns), orders=len(orders))
    orders = [list(v) for v in orders]
    unseen = agg_row(df, {c: F.count_if(~F.coalesce(col(c).isin(v), F.lit(False))) for c, v in zip(columns, orders)})
    for c, n in unseen.items():
        if n:
            raise DataValidationError("values outside the given order", column=c, rows=n)
    return Ordinal(inputCols=columns, categories=json.dumps(orders)).fit(df).transform(df)


def label_encode(df: DataFrame, target: str, output: str | None = None, limit: int = MAX_LEVELS) -> tuple[DataFrame, list]:
    """Target as integer codes, and the classes in code order.  Text sorts as text, numbers as numbers."""
    f = field_of(df, target)
    if not (is_numeric(f) or is_boolean(f)):
        df = df.withColumn(target, col(target).cast("string"))
    levels = sorted_levels(df, [target], limit)[target]
    code = (F.array_position(F.lit(levels), col(target)) - 1).cast("int")
    return df.withColumn(output or target, F.when(col(target).isNotNull(), code)), levels


class BoundedIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Alphabetical ``StringIndexer`` that first checks that the level sets are small."""

    maxLevels = Param(Params._dummy(), "maxLevels", "widest level set accepted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(maxLevels=MAX_LEVELS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame):
        require_few_levels(df, self.getInputCols(), self.getOrDefault(self.maxLevels))
        return StringIndexer(
            inputCols=self.getInputCols(), outputCols=self.getOutputCols(), stringOrderType="alphabetAsc", handleInvalid="keep"
        ).fit(df)
