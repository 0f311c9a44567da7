"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
# One person per letter code: at this scale no two names are a keystroke apart.
MAY_BE_EMPTY = {"near_name"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    diff = oracle.compare(spark, con, name, entry.queries()[name], ORACLE.get(name), SF)
    if name in MAY_BE_EMPTY and diff == "no rows":
        return
    assert diff is None, diff


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
