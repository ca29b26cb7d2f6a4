"""Text queries that SQL can express give the same rows as DuckDB."""

import pytest
from oracle import connect, same

from gridgauge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, sf_dir):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connect(sf_dir))
