"""Every registered query against its SQL oracle."""

import __spark_entry__ as entry_point
import pytest
from compare import differences, oracle

ORACLES = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, sf, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
