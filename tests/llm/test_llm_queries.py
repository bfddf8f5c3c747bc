"""Queries of the corpus operators against their SQL in DuckDB."""

import pytest

from causeway.llm import registry
from tests.test_queries import same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    sql = registry.oracle_sql()
    if name in sql:
        same(spark, sf_dir, registry.queries()[name], sql[name])
    else:
        assert registry.queries()[name](spark, sf_dir).count() > 0
