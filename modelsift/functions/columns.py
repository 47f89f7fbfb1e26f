"""Column kinds, safe casts and small expression helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, INTEGRAL + FRACTIONAL)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_boolean(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.BooleanType)


def field_of(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def col(name: str) -> Column:
    """A column by its exact name; dots in names are not struct access."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_text(f) and f.name not in skip]


def boolean_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_boolean(f) and f.name not in skip]


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as null, as a data frame library reads it."""
    c = col(name)
    if isinstance(field_of(df, name).dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def parses(c: Column) -> Column:
    return c.try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """Division that yields null instead of an ANSI error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation as an aggregate; null when undefined.

    ``corr`` raises under ANSI mode for a constant column, hence the explicit quotient.
    """
    sx = F.stddev_pop(F.when(y.isNotNull(), x))
    sy = F.stddev_pop(F.when(x.isNotNull(), y))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.covar_pop(x, y), F.nullif(sx * sy, F.lit(0.0)))))


def abs_pearson(x: Column, y: Column) -> Column:
    """Absolute correlation from two aggregates; null when either side is constant."""
    spread = F.stddev_pop(F.when(y.isNotNull(), x))
    return F.when(spread > 0, F.sqrt(F.regr_r2(x, y)))


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def agg_row(df: DataFrame, exprs: dict[str, Column], width: int = 200) -> dict:
    """Evaluate many aggregates and return one dict.

    One scan serves ``width`` expressions; wider requests are cut so that generated code stays compilable.
    """
    out: dict = {}
    for part in chunks(list(exprs.items()), width):
        out.update(df.agg(*[e.alias(k) for k, e in part]).first().asDict())
    return out
