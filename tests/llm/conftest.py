from __future__ import annotations

import pytest
from pyspark.sql import Row

AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, key string, __text string, sig bigint, shard int, blob binary"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names operators use inside."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of honey and salt. "
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [
        (1, base * 3), (2, base * 3), (3, "prefix " + base * 3), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one"), (9, long), (10, long + " tail"),
        (11, "ÄÖÜ ünïcödé 字字字 😀 " + base + base.upper()), (None, base * 2), (12, "a" * 5000), (13, "ab" * 3000 + "c"), (14, "\x00\x01 odd <|endoftext|> ▁ text"),
    ]
    out = [(k, t, None, "s", None, "x", "y", None, "z", 1, 2, bytearray(b"q")) for k, t in rows]
    return spark.createDataFrame([*out, out[6]], AWKWARD).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def rows_by_id(df, key: str = "doc_id") -> dict[object, Row]:
    return {r[key]: r for r in df.collect()}
