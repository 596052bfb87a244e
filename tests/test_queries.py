"""Every registered query of the library runs, and gives the rows of its SQL where it has one."""

import pytest

from compare import connection, differences
from docloom.plans import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_the_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert all(len(r) == len(found.columns) for r in found.collect())
