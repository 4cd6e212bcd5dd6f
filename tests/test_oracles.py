"""Every registered query of the core engine against its SQL, and rows where there is none."""

import pytest

from strataquery.plans import registry
from tests.compare import same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
