"""Every registered query against its SQL twin on the test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import DATA
from compare import connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
QUERIES, ORACLE = queries(), oracle_sql()
# at the smallest scale these find nothing, which both sides must agree on
MAY_BE_EMPTY = {"e3_risk_class_imbalance", "g8_range_join", "h31_year_over_year"}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLE:
        assert df.count() > 0
        return
    found = differences(df, duck, ORACLE[name])
    if name in MAY_BE_EMPTY:
        found = [f for f in found if f != "no rows at all"]
    assert found == []


def test_entry(spark):
    rows = entry(spark).collect()
    assert {"missing_values", "duplicate_rows", "constant_column"} <= {r["check"] for r in rows}
