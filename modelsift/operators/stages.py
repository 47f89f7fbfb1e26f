"""Base classes for fitted column transforms that save and load inside a ``pyspark.ml`` pipeline."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame

from ..functions.columns import col
from ..errors import DataValidationError


class ColumnModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Rewrites each input column with one expression built from its saved statistics."""

    stats = Param(Params._dummy(), "stats", "fitted statistics as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(stats="{}")

    @classmethod
    def of(cls, columns, stats: dict):
        m = cls()
        m._set(inputCols=list(columns), stats=json.dumps(stats))
        return m

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.stats))

    def expression(self, c: Column, st) -> Column:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.fitted()
        return df.withColumns({c: self.expression(col(c), st[c]) for c in self.getInputCols()}) if self.getInputCols() else df


class ColumnEstimator(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def require_values(self, stats: dict, empty) -> None:
        for c, v in stats.items():
            if v is empty:
                raise DataValidationError("no value to learn from", column=c)


__all__ = ["ColumnEstimator", "ColumnModel", "keyword_only"]
