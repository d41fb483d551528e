"""Every query with SQL, against DuckDB on the smallest tables; the others must give rows."""

import pytest
from compare import connect, differs

from zephyrine import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert differs(Q.queries()[name](spark, sf), connect(sf), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert Q.queries()[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
