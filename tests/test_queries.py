"""Every registered query with SQL gives that SQL's rows."""

import __spark_entry__ as contract
import pytest
from oracle import difference

SQL = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, name):
    assert difference(contract.queries()[name](spark, folder), SQL[name], folder) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 6
