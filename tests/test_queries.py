"""Every query runs; those with SQL give the same rows as DuckDB."""

import pytest
from oracle import connect, same

from gridgauge import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(name, spark, sf_dir, con):
    same(plans.QUERIES[name](spark, sf_dir), plans.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(name, spark, sf_dir):
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 7
