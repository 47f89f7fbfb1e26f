"""Every registered query with an SQL twin must match it; the others must return rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUICK_ROWS_ONLY = ["power_lambdas", "forest_shapley", "grid_search", "random_search", "pca", "pca_reconstruction", "nca"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", QUICK_ROWS_ONLY)
def test_returns_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2] and all(r["status"] == "success" for r in rows)
