"""The queries that SQL can express, on the smallest tables."""

import pytest

from bindery.llm import queries
from tests.conftest import DATA
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name])
