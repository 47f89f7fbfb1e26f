"""Scaling, log and power transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DataValidationError
from ..functions.columns import agg_row, col, number
from ..functions.power import TRANSFORMS, log_jacobian, log_size
from .order_stats import quantiles
from .stages import ColumnEstimator, ColumnModel


class ScalerModel(ColumnModel):
    """(x - shift) / width; a zero width divides by one, so a constant column becomes zero."""

    def expression(self, c: Column, st) -> Column:
        shift, width = st
        return (c.cast("double") - F.lit(float(shift))) / F.lit(float(width))


class Scaler(ColumnEstimator):
    """``standard`` uses the population deviation, ``minmax`` maps to [0, 1], ``robust`` uses exact quartiles."""

    kind = Param(Params._dummy(), "kind", "standard, minmax or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, kind="standard"):
        super().__init__()
        self._setDefault(kind="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ScalerModel:
        columns, kind = self.getInputCols(), self.getOrDefault(self.kind)
        if kind not in ("standard", "minmax", "robust"):
            raise ConfigurationError("unknown scaler", kind=kind)
        if not columns:
            return ScalerModel.of([], {})
        if kind == "robust":
            q = quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.5, 0.75])
            pairs = {c: (v[1], v[2] - v[0]) if v[0] is not None else (0.0, 1.0) for c, v in q.items()}
        else:
            lo, hi = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
            exprs = {}
            for i, c in enumerate(columns):
                exprs[f"a{i}"], exprs[f"b{i}"] = lo(number(df, c)), hi(number(df, c))
            row = agg_row(df, exprs)
            pairs = {}
            for i, c in enumerate(columns):
                a, b = row[f"a{i}"], row[f"b{i}"]
                if a is None:
                    pairs[c] = (0.0, 1.0)
                    continue
                width = b if kind == "standard" else b - a
                # rounding noise of a constant column is not a spread
                pairs[c] = (a, 0.0 if kind == "standard" and width <= 1e-12 * abs(a) else width)
        return ScalerModel.of(columns, {c: [a, w if w else 1.0] for c, (a, w) in pairs.items()})


class LogModel(ColumnModel):
    """``log1p``; ``inverse`` gives ``expm1``."""

    def expression(self, c: Column, st) -> Column:
        return F.log1p(c.cast("double"))

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expm1(col(c)) for c in self.getInputCols()})


class LogTransform(ColumnEstimator):
    """Rejects null and infinite input when fitted."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> LogModel:
        columns = self.getInputCols()
        if columns:
            bad = agg_row(df, {c: F.count_if(number(df, c).isNull() | (F.abs(number(df, c)) == float("inf"))) for c in columns})
            for c, n in bad.items():
                if n:
                    raise DataValidationError("log transform needs finite values", column=c, rows=n)
        return LogModel.of(columns, {c: None for c in columns})


SAMPLE_ROWS, BOUND = 10_000, 32.0
STEPS = (0.03, 0.005)  # spacing of the lambdas tried on the whole column, coarse then fine
AROUND = range(-3, 4)


def _likelihood(n: float, var: float | None, jac: float, lam: float) -> float:
    if var is None or not math.isfinite(var) or var <= 0:
        return -math.inf
    return -n / 2 * math.log(var) + (lam - 1) * jac


def _sample_lambda(x: np.ndarray, method: str) -> float:
    """Start value: the best lambda of a small sample, by repeated refinement."""
    x = x[np.isfinite(x)]
    if len(x) < 3:
        return 1.0
    up, size = x >= 0, np.log1p(np.abs(x))
    logs = np.log(x) if method == "box-cox" else None
    jac = float(logs.sum() if logs is not None else (np.sign(x) * size).sum())

    def value(lam: float) -> float:
        if logs is not None:
            t = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
        else:
            mu = 2 - lam
            t = np.where(up, size if abs(lam) < 1e-12 else np.expm1(lam * size) / lam, -size if abs(mu) < 1e-12 else -np.expm1(mu * size) / mu)
        return _likelihood(len(x), float(t.var()), jac, lam)

    with np.errstate(all="ignore"):
        best, step = max(np.arange(-8.0, 8.5, 0.5), key=value), 0.5
        while step > 0.01:
            step /= 4
            best = max([best + step * i for i in range(-4, 5)], key=value)
    return float(best)


def fit_lambdas(df: DataFrame, columns: list[str], method: str) -> dict[str, float]:
    """Maximum-likelihood lambda of each column.

    A small sample says where to look.  Each further pass is one scan that evaluates the log likelihood of all columns
    on a few lambdas, moving on while the best lies on the edge of those tried; the last bracket is closed with the
    vertex of the parabola through its three best points.
    """
    change = TRANSFORMS[method]
    names = [f"c{i}" for i in range(len(columns))]
    base = df.select(*[number(df, c).alias(k) for c, k in zip(columns, names)])
    exprs = {"rows": F.count(F.lit(1))}
    for k in names:
        exprs[f"{k}|n"], exprs[f"{k}|j"], exprs[f"{k}|s"] = F.count(k), F.sum(log_jacobian(method, F.col(k))), F.stddev_pop(k)
    fixed = agg_row(base, exprs)
    live = [k for k in names if fixed[f"{k}|n"] and fixed[f"{k}|s"]]
    if not live:
        return {c: 1.0 for c in columns}
    # rows are picked by a hash of their values, so the start does not depend on partitioning
    share = min(1.0, SAMPLE_ROWS / fixed["rows"])
    few = base.where(F.pmod(F.xxhash64(*names), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).limit(4 * SAMPLE_ROWS).toPandas()
    centre = {k: _sample_lambda(few[k].to_numpy(dtype=float), method) for k in live}
    step = {k: STEPS[0] for k in live}
    seen: dict[str, dict[float, float]] = {k: {} for k in live}
    grid = {k: [centre[k] + step[k] * i for i in AROUND] for k in live}
    # the logarithm of a value is worked out once a pass and not once a lambda
    sized = base.select(*live, *[log_size(method, F.col(k)).alias(f"{k}_log") for k in live])
    while any(grid.values()):
        got = agg_row(sized, {f"{k}|{x!r}": F.var_pop(change(F.col(k), x, F.col(f"{k}_log"))) for k, g in grid.items() for x in g}, 120)
        for k, g in grid.items():
            if not g:
                continue
            seen[k].update({x: _likelihood(fixed[f"{k}|n"], got[f"{k}|{x!r}"], fixed[f"{k}|j"], x) for x in g})
            best = max(seen[k], key=lambda x: (seen[k][x], -abs(x)))
            if best in (min(seen[k]), max(seen[k])) and abs(best) < BOUND:
                side = 1 if best == max(seen[k]) else -1
                step[k] *= 2  # the sample pointed elsewhere: look further out
                grid[k] = [best + side * step[k] * i for i in (1, 2, 3)]
            elif step[k] > STEPS[-1]:
                step[k] = STEPS[-1] if step[k] <= STEPS[0] else max(STEPS[0], step[k] / 4)
                grid[k] = [best + step[k] * i for i in AROUND if i]
            else:
                grid[k] = []
    out = {c: 1.0 for c in columns}
    for c, k in zip(columns, names):
        if k not in live:
            continue
        s = seen[k]
        best = max(s, key=lambda x: (s[x], -abs(x)))
        left, right = max((x for x in s if x < best), default=None), min((x for x in s if x > best), default=None)
        if left is not None and right is not None and math.isfinite(s[left]) and math.isfinite(s[right]):
            h1, h2 = best - left, right - best
            d1, d2 = (s[best] - s[left]) / h1, (s[right] - s[best]) / h2
            curve = (d2 - d1) / (h1 + h2)
            if curve < 0:
                best = min(max((left + best) / 2 - d1 / (2 * curve), left), right)
        out[c] = best
    return out


class PowerModel(ColumnModel):
    def expression(self, c: Column, st) -> Column:
        method, lam, mean, sd = st
        return (TRANSFORMS[method](c.cast("double"), lam) - F.lit(mean)) / F.lit(sd)


class PowerTransform(ColumnEstimator):
    """Box-Cox or Yeo-Johnson with a fitted (or given) lambda, then standardised."""

    method = Param(Params._dummy(), "method", "box-cox or yeo-johnson", TypeConverters.toString)
    standardize = Param(Params._dummy(), "standardize", "scale the result", TypeConverters.toBoolean)
    lambdas = Param(Params._dummy(), "lambdas", "fixed lambdas, one per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, method="yeo-johnson", standardize=True, lambdas=None):
        super().__init__()
        self._setDefault(method="yeo-johnson", standardize=True)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PowerModel:
        columns, method = self.getInputCols(), self.getOrDefault(self.method)
        if method not in TRANSFORMS:
            raise ConfigurationError("unknown power transform", method=method)
        if not columns:
            return PowerModel.of([], {})
        if method == "box-cox":
            low = agg_row(df, {c: F.min(number(df, c)) for c in columns})
            for c, v in low.items():
                if v is not None and v <= 0:
                    raise DataValidationError("box-cox needs strictly positive values", column=c, minimum=v)
        if self.isSet(self.lambdas):
            lams = dict(zip(columns, self.getOrDefault(self.lambdas)))
        else:
            lams = fit_lambdas(df, columns, method)
        moments = {c: (0.0, 1.0) for c in columns}
        if self.getOrDefault(self.standardize):
            exprs = {}
            for i, c in enumerate(columns):
                t = TRANSFORMS[method](number(df, c), lams[c])
                exprs[f"m{i}"], exprs[f"s{i}"] = F.avg(t), F.stddev_pop(t)
            row = agg_row(df, exprs)
            moments = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
        return PowerModel.of(columns, {c: [method, lams[c], *moments[c]] for c in columns})
