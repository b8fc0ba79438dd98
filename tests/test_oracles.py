"""Every query of the library that has oracle SQL gives the rows that DuckDB gives for it."""

import pytest

from strataspark import catalog
from tests.conftest import DATA

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, same):
    same(catalog.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, DATA).limit(5).count() >= 1
