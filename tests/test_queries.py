"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from stubble.queries import ORACLES, QUERIES
from tests.compare import compare, connect, plan_of

SF_DIR = "/root/testdata/sf0.001"
# One partition is only right for the few partial sums of a whole-table total.
WHOLE_TABLE_TOTALS = {"row_conservation", "column_pairs", "two_files_agree"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = plan_of(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapPartitions"):
        assert node not in plan
    if "SinglePartition" in plan:
        assert name in WHOLE_TABLE_TOTALS
    assert compare(df, ORACLES[name], con) is None


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
