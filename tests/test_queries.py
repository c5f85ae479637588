"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_point
from catalog import compare

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare.differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["msg_id", "action", "reason", "confidence", "method"]
    assert frame.count() > 0
