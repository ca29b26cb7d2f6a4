"""Queries by name; importing the modules registers them."""

from gridgauge.plans import choices, figures, results, rows, runs, tables, values, workbooks  # noqa: F401
from gridgauge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
