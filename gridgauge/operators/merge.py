"""WIN-01 to WIN-04: fragments of a table become one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.functions import text


def extends(before: dict[str, Column], now: dict[str, Column]) -> Column:
    """WIN-02: whether a table goes on with the one before it: same headers, not all blank, rows in both, adjacent place.

    Places on different pages are adjacent only if both pages are given.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    page, last_page, index, last_index = zero(now["page"]), zero(before["page"]), zero(now["index"]), zero(before["index"])
    same_page = (page == last_page) & (index == last_index + 1)
    next_page = now["page"].isNotNull() & before["page"].isNotNull() & (page == last_page + 1) & index.isin(0, 1)
    heads = (now["heads"] == before["heads"]) & F.exists(now["heads"], lambda h: h != "")
    return F.coalesce(heads & (now["n"] > 0) & (before["n"] > 0) & (same_page | next_page), F.lit(False))


def merge_fragments(tables: DataFrame, by: list[str], check_place: bool = True) -> DataFrame:
    """Tables (by, page_number, table_index, headers, rows) in reading order; runs that extend one another are merged.

    Equal headers are transitive, so comparing with the table before is comparing with the run's first.
    ``check_place``: without it (WIN-04) equal headers of neighbours are enough.
    Adds row_count, col_count, merged_from, page_from and page_to; ``table_index`` counts anew (WIN-19).
    """
    order = Window.partitionBy(*by).orderBy(F.coalesce("page_number", F.lit(0)), F.coalesce("table_index", F.lit(0)))
    t = tables.withColumns({"heads": text.headers(F.coalesce("headers", F.array().cast("array<string>"))) if check_place else F.col("headers"), "n": F.size(F.coalesce("rows", F.array().cast("array<array<string>>")))})
    now = {"page": F.col("page_number"), "index": F.col("table_index"), "heads": F.col("heads"), "n": F.col("n")}
    before = {k: F.lag(c).over(order) for k, c in now.items()}
    goes_on = extends(before, now) if check_place else F.coalesce(now["heads"] == before["heads"], F.lit(False))
    t = t.withColumns({"at": F.row_number().over(order), "goes_on": goes_on})
    t = t.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("at", "rows")))
    page = F.coalesce("page_number", F.lit(0))
    got = t.groupBy(*by, "run").agg(
        F.min_by("page_number", "at").alias("page_number"), F.min_by("headers", "at").alias("headers"), F.flatten(F.transform(parts, lambda p: F.coalesce(p["rows"], F.array().cast("array<array<string>>")))).alias("rows"),
        F.count("*").alias("merged_from"), F.min(page).alias("page_from"), F.max(page).alias("page_to"),
    )
    return got.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("run")) - 1).alias("table_index"), "page_number", "headers", "rows", F.size("rows").alias("row_count"), F.size("headers").alias("col_count"), "merged_from", "page_from", "page_to")


def reindex(tables: DataFrame, by: str = "document_id") -> DataFrame:
    """WIN-19: ``table_index`` from 0 without gaps, in the order it had."""
    return tables.withColumn("table_index", F.row_number().over(Window.partitionBy(by).orderBy("table_index")) - 1)


def stitch(tables: DataFrame, by: list[str]) -> DataFrame:
    """TBL-18, TBL-20: all tables of equal headers, whatever lies between, become one; the longest header wins."""
    key = F.array_join(text.headers(F.col("headers")), "|")
    parts = F.array_sort(F.collect_list(F.struct("table_index", "rows")))
    return tables.groupBy(*by, key.alias("header_key")).agg(F.max_by("headers", F.struct(F.length(F.array_join("headers", "")), -F.col("table_index"))).alias("headers"), F.flatten(F.transform(parts, lambda p: p["rows"])).alias("rows"), F.min("table_index").alias("table_index"), F.count("*").alias("merged_from"))
