"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridgauge.operators import rollup
from gridgauge.shared import folder  # noqa: F401, for the plans
from gridgauge.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: str | None = "slots") -> Callable[[Query], Query]:
    """Register a query.  ``prelude``: ``slots``, ``tables`` or none of the shared expressions before ``sql``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if prelude is None else bridge.with_sql(sql, prelude == "slots")
        return f

    return add


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    er = bridge.extractions(spark, sf_dir)
    return rollup.scored_rows(er, bridge.scores(er))


def slots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.slots(bridge.documents(spark, sf_dir), rows_of(spark, sf_dir), bridge.ground_truth(spark, sf_dir))
