"""Row hashes that any engine can reproduce; splits and folds are cut on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def digest(keys: Sequence[str], seed: int) -> Column:
    """md5 over ``key|key|...|seed``."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def hash60(keys: Sequence[str], seed: int) -> Column:
    """The first 60 bits of the digest as a non-negative bigint (same order as the hex text)."""
    return F.conv(F.substring(digest(keys, seed), 1, 15), 16, 10).cast("bigint")


def row_keys(df: DataFrame, key: Sequence[str] | str | None) -> list[str]:
    """The key columns, or every atomic column when the caller names none."""
    if key is None:
        return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "udt", "vectorudt")]
    return [key] if isinstance(key, str) else list(key)
