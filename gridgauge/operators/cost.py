"""MTH-07, MTH-08: what a run costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge import dims


def tokens_of(raw: Column, name: str) -> Column:
    """MTH-08: a token count from the payload's usage; what is no number, and zero, is null."""
    n = F.get_json_object(raw, f"$.usage.{name}").try_cast("int")
    return F.when(n != 0, n)


def with_cost(runs: DataFrame) -> DataFrame:
    """Adds ``cost_usd``; missing or zero token counts are taken from the pages.  Prices are a broadcast of seven rows."""
    runs = runs.join(F.broadcast(dims.price_dim(runs.sparkSession)), "tool_name", "left")
    pages = F.coalesce("page_count", F.lit(0))
    tokens = lambda c, per: F.coalesce(F.when(F.col(c) != 0, F.col(c)), per * pages)
    by_token = tokens("input_tokens", dims.TOKENS_PER_PAGE[0]) * F.col("in_price") + tokens("output_tokens", dims.TOKENS_PER_PAGE[1]) * F.col("out_price")
    total = F.coalesce("page_price", F.lit(0.0)) * pages + F.coalesce(by_token, F.lit(0.0))
    return runs.withColumn("cost_usd", F.round(total, 6)).drop("page_price", "in_price", "out_price")


def recompute(extraction: DataFrame, documents: DataFrame, tool: str) -> DataFrame:
    """SNK-16: all rows, with the cost of one tool's runs worked out anew on their first table and 0 on the others.

    The payload is taken from the first row of a run that has one.
    """
    run = Window.partitionBy("document_id", "tool_name")
    own = extraction.where(F.col("tool_name") == tool).withColumn("payload", F.first("raw_output", True).over(run.orderBy("table_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = own.join(documents.select("document_id", "page_count"), "document_id", "left")
    own = with_cost(own.drop("cost_usd").withColumns({"input_tokens": tokens_of(F.col("payload"), "input_tokens"), "output_tokens": tokens_of(F.col("payload"), "output_tokens")}))
    own = own.withColumn("cost_usd", F.when(F.col("table_index") == 0, F.col("cost_usd")).otherwise(F.lit(0.0)))
    return own.select(*extraction.columns).unionByName(extraction.where(F.col("tool_name") != tool))
