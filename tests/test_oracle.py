"""Every registered query against its SQL, on the smallest tables."""

from contextlib import redirect_stdout
from io import StringIO

import pytest

import __spark_entry__ as entry
from compare import connect, difference

DIRECTORY = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIRECTORY)
    with redirect_stdout(StringIO()) as plan:
        df.explain()
    assert "CartesianProduct" not in plan.getvalue() and "NestedLoopJoin" not in plan.getvalue()
    if name in SQL:
        assert difference(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 500
