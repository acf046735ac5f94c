import pytest

from bindery import catalog
from tests.conftest import DATA
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(catalog.queries()[name](spark, DATA), con, catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
