"""Sources: delimited files with trimmed headers, parquet, or any DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

# fixed values: texts read as null in a delimited file
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Header row, inferred types, the usual null tokens.

    Columns are read as text, null tokens removed, and each column takes the narrowest of bigint, double and boolean
    that fits all its values; dates stay text.  Give ``schema`` to save the inference scan on a large input.
    """
    reader = spark.read.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        return trim_headers(reader.schema(schema).csv(path))
    raw = trim_headers(reader.option("inferSchema", False).csv(path))
    clean = raw.select(*[F.when(~F.trim(col(c)).isin(*NULL_TOKENS), col(c)).alias(c) for c in raw.columns])
    if not raw.columns:
        return clean
    probes = []
    for i, c in enumerate(raw.columns):
        v, t = col(c), F.trim(col(c))
        probes += [
            F.count(v).alias(f"n{i}"), F.count(t.try_cast("bigint")).alias(f"l{i}"), F.count(t.try_cast("double")).alias(f"d{i}"),
            F.count_if(F.lower(t).isin("true", "false")).alias(f"b{i}"),
        ]
    row = clean.agg(*probes).first()
    out = []
    for i, c in enumerate(raw.columns):
        n, t = row[f"n{i}"], F.trim(col(c))
        if n and row[f"l{i}"] == n:
            out.append(t.try_cast("bigint").alias(c))
        elif row[f"d{i}"] == n:
            out.append(t.try_cast("double").alias(c))  # also the type of a column without values
        elif row[f"b{i}"] == n:
            out.append(t.try_cast("boolean").alias(c))
        else:
            out.append(col(c))
    return clean.select(*out)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
