"""Every registered query with oracle SQL equals DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as se
from conftest import SF0001
from hydrolens.plans.oracle import SQL
from oracle_harness import compare, duck

# the two that fit boosted trees or five forests for minutes; tests/test_ml.py has small fits
SLOW = {"train_gbt", "cross_validate"}
NAMES = sorted(set(SQL) - SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, SF0001, verbose=True)


def test_every_query_registered_has_callable():
    assert set(se.oracle_sql()) <= set(se.queries())


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and df.columns == ["household_id", "risk_level", "avg_leak_prob", "avg_spike",
                                              "leak_events", "avg_usage"]
