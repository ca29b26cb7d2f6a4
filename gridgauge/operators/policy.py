"""Policies as columns: tiers, reliability, metric values, failure classes, run states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgauge.dims import TIERS

def finite(c: Column) -> Column:
    """AGG-03's input rule: NaN is missing, zero is a value."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """PRJ-01: a double; null stays null and zero stays zero."""
    return c.cast("double")


def nonzero(c: Column) -> Column:
    """PRJ-02: zero counts as missing."""
    return F.when(c != 0, c.cast("double"))


def tier(raw: Column) -> Column:
    """POL-02."""
    said = F.lower(F.trim(raw))
    return F.when(said.isin(*TIERS), said).otherwise("unconfirmed")


def reliability(has_extraction: Column, transient: Column, scored: Column, tables: Column, truths: Column) -> Column:
    """POL-03: the first state that holds; total over all inputs."""
    return (
        F.when(~has_extraction, "unevaluated").when(transient, "complete_failure").when(scored == 0, "missing_f1")
        .when(scored < tables, "partial").when((truths > 0) & (tables < truths), "partial").otherwise("success")
    )


def metric_value(metric: str, policy: str = "strict") -> Column:
    """POL-01: what a slot gives to a mean; null: nothing.  ``zero_impute_failed`` counts failed runs as 0."""
    if policy not in ("strict", "zero_impute_failed"):
        raise ValueError(f"unknown policy: {policy}")
    failed = F.col("reliability").isin("complete_failure", "missing_f1", "partial") & F.col("has_extraction")
    missing = F.when(failed, F.lit(0.0)) if policy == "zero_impute_failed" else F.lit(None).cast("double")
    return F.when(~F.col("is_transient_failure"), F.coalesce(finite(F.col(metric)), missing))


def failure_of_text(error: Column) -> Column:
    """POL-05: failure class of a tool's error message."""
    said = F.lower(F.coalesce(error, F.lit("")))
    return F.when(said.rlike("rate limit|429|529|overloaded"), "rate_limit").when(said.contains("timeout"), "timeout").when(said.contains("connect"), "server_down").otherwise("api_error")


def transient(failure: Column) -> Column:
    return F.coalesce(failure.isin("rate_limit", "timeout", "server_down"), F.lit(False))


def failure_of_exception(kind: Column, message: Column, code: Column) -> Column:
    """POL-06: failure class of a connector's exception, given as its class name, message and service code."""
    said = F.coalesce(message, F.lit(""))
    limited = kind.isin("RateLimitError") | code.isin("429", "529", "503", "ThrottlingException", "ProvisionedThroughputExceededException") | F.coalesce(code, F.lit("")).contains("Throttling") | said.rlike("ThrottlingException|Rate exceeded|RateExceeded|Too Many Requests")
    return F.when(F.coalesce(limited, F.lit(False)), "rate_limit").when(kind.isin("APIConnectionError", "ConnectionError", "EndpointConnectionError", "BotoCoreError"), "server_down").when(kind.isin("TimeoutError"), "timeout").otherwise("api_error")


def empty_tables(tables: Column) -> Column:
    """No table, or none with a row."""
    return ~F.coalesce(F.exists(tables, lambda t: F.size(t["rows"]) > 0), F.lit(False))


def failure_of_empty(tool: Column, is_digital: Column) -> Column:
    """POL-07: why a run gave nothing: text tools can't read scans."""
    return F.when(tool.isin("pymupdf", "docling") & (is_digital == False), "tool_limitation").otherwise("empty_output")  # noqa: E712


def rerun(transient: Column, failure: Column) -> Column:
    """POL-08, over the rows of a run."""
    return F.bool_or(transient | F.coalesce(~failure.isin("tool_limitation", "empty_output"), F.lit(False)))


def scoring_guard(has_rows: Column, transient: Column, draft: Column, confirmed_truths: Column) -> Column:
    """POL-09: null if a run can be scored, else why not."""
    return F.when(~has_rows, "no_extraction").when(transient, "transient_failure").when(draft, "draft").when(confirmed_truths == 0, "no_ground_truth")


def zero_scored(failure: Column) -> Column:
    """POL-10: runs without output score zero on all metrics."""
    return F.coalesce(failure.isin("tool_limitation", "empty_output"), F.lit(False))


ZERO_NOTE = "Scored as 0 — tool produced no output"


def zero_note(error: Column) -> Column:
    """POL-10: the note, appended once."""
    held = F.coalesce(error, F.lit(""))
    return F.when(held.contains(ZERO_NOTE), held).when(held == "", F.lit(ZERO_NOTE)).otherwise(F.concat(held, F.lit("; "), F.lit(ZERO_NOTE)))


def extraction_state(n_rows: Column, first_failure: Column, any_transient: Column, any_content: Column, is_digital: Column, first_error: Column) -> Column:
    """POL-04: what the run shows as."""
    return (
        F.when(n_rows == 0, "pending").when(any_transient & (first_failure == "rate_limit"), "rate_limited").when(any_transient | (first_failure == "api_error"), "api_error")
        .when(any_content, "done").when((first_failure == "tool_limitation") | (is_digital == False), "no_tables_scanned")  # noqa: E712
        .when(first_error.isNull() | (first_failure == "empty_output"), "no_tables").otherwise("failed")
    )


def retriable(error: Column) -> Column:
    """POL-11."""
    return F.lower(F.coalesce(error, F.lit(""))).rlike("rate limit|timeout|connection|temporar|overloaded|429|500|502|503|504|529")
