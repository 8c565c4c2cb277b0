"""Every registered query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry_module
import oracle
import pytest
from conftest import SMALL

from threadloom.plans import QUERIES as LIBRARY

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(SQL) & set(LIBRARY)))
def test_query_matches_sql(name, spark, oracle_con):
    assert oracle.differences(QUERIES[name](spark, SMALL), oracle_con, SQL[name]) is None


def test_every_query_of_the_library_has_sql():
    assert set(LIBRARY) <= set(SQL)


def test_entry_is_the_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["community", "toxic", "non_toxic", "toxic_pct"] and df.count() > 0
