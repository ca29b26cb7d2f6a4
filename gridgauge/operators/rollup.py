"""From extraction rows to one row for each document and tool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.functions.text import carrier
from gridgauge.operators import policy


def scored_rows(extraction: DataFrame, score: DataFrame) -> DataFrame:
    """JN-02: every extraction row, with its score if it has one; of repeated scores the join keeps each."""
    return extraction.join(score, "extraction_result_id", "left")


def merge_rows(rows: DataFrame) -> DataFrame:
    """AGG-01: rollup by document and tool, in one shuffle.

    A run has few rows, which the join has spread over tasks: a rollup before the shuffle would sort them all (a text
    has no place in a hash aggregate) and merge next to none, so rows are dealt by run first.
    """
    means = [F.avg(policy.finite(F.col(m))).alias(m) for m in dims.METRICS]
    return rows.repartition("document_id", "tool_name").groupBy("document_id", "tool_name").agg(
        F.count("*").alias("n_tables"), F.count(policy.finite(F.col("f1_score"))).alias("scored_tables"), *means,
        F.greatest(F.max(F.coalesce("processing_time_ms", F.lit(0))), F.lit(0)).alias("processing_time_ms"),
        F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost_usd"),
        F.bool_or("is_transient_failure").alias("is_transient_failure"), F.min_by("failure_reason", "table_index").alias("failure_reason"),
    )


def truth_counts(truth: DataFrame) -> DataFrame:
    """AGG-02: annotated tables of each document."""
    return truth.groupBy("document_id").agg(F.count("*").alias("gt_tables"))


def slots(documents: DataFrame, rows: DataFrame, truth: DataFrame) -> DataFrame:
    """JN-05, POL-03: every document with every tool, with the rollup where there is one.

    The seven tools are an array that is exploded, so there is no cross join; rollup and truth counts are
    aggregated before they meet the documents, by the documents' key.  What a document says by itself (tier, carrier)
    is found before the tools are exploded, once for all seven.
    """
    tools = F.explode(F.array(*[F.struct(F.lit(k).alias("tool_rank"), F.lit(t).alias("tool_name")) for k, t in enumerate(dims.TOOLS)]))
    documents = documents.withColumns({"tier": policy.tier(F.col("complexity_tier")), "carrier": carrier(F.col("filename"))})
    docs = documents.join(truth_counts(truth), "document_id", "left").select("*", tools.alias("t")).select("*", "t.*").drop("t")
    found = docs.join(merge_rows(rows).withColumn("has_extraction", F.lit(True)), ["document_id", "tool_name"], "left")
    zero = {"n_tables": 0, "scored_tables": 0, "gt_tables": 0, "processing_time_ms": 0, "cost_usd": 0.0, "has_extraction": False, "is_transient_failure": False}
    found = found.fillna(zero)
    return found.select(
        "*", dims.generation(F.col("tool_name")).alias("generation"), dims.label(F.col("tool_name")).alias("label"),
        F.col("tool_name").isin(*dims.OPEN_SOURCE).alias("open_source"),
        F.when((F.col("page_count") > 0) & F.col("has_extraction"), F.col("cost_usd") / F.col("page_count")).alias("cost_per_page"),
        policy.reliability(F.col("has_extraction"), F.col("is_transient_failure"), F.col("scored_tables"), F.col("n_tables"), F.col("gt_tables")).alias("reliability"),
    )


def quantile(values: Column, p: float) -> Column:
    """AGG-05: nearest rank of a sorted array, the index rounded half up; of an empty array 0."""
    at = F.floor(F.lit(p) * (F.size(values) - 1) + F.lit(0.5)).cast("int") + 1
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(values, at - 1))


#: Pieces into which a group's values are cut; a piece is sorted in one task.
PIECES = 128


def order_statistics(by: list[str], df: DataFrame, value: Column, ranks: dict[str, Callable[[Column], Column]], few: bool) -> DataFrame:
    """``by``, the value at each of ``ranks`` (functions of the group's number of values, from 1), ``min``, ``max`` and ``n``; groups without a value dropped.

    Distinct values are counted first.  Approximate quantiles cut each group into ``PIECES``; counts of the pieces say which
    one holds a rank, and only those pieces are sorted, each by itself, so no group is in one task and the result is exact.
    ``few``: groups are those of a fixed dimension, so that a row for each of them can be broadcast.
    """
    near = F.broadcast if few else (lambda d: d)
    counts = df.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("k"))
    edges = counts.groupBy(*by).agg(F.percentile_approx("v", [x / PIECES for x in range(1, PIECES)], 20 * PIECES).alias("edges"))
    placed = counts.join(near(edges), by).withColumn("piece", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    upto = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*by, "piece").agg(F.sum("k").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = Window.partitionBy(*by)
    sums = sums.select("*", F.sum("k").over(upto).alias("upto"), F.sum("k").over(whole).alias("n"), F.min("low").over(whole).alias("min"), F.max("high").over(whole).alias("max"))
    wanted = sums.select(*by, "piece", "n", "min", "max", (F.col("upto") - F.col("k")).alias("before"), "upto", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])).alias("s"))
    wanted = wanted.where("s.rank > before and s.rank <= upto").groupBy(*by, "piece", "n", "min", "max").agg(F.collect_list(F.struct("s.name", (F.col("s.rank") - F.col("before")).alias("rank"))).alias("ranks"))
    inside = placed.join(near(wanted), [*by, "piece"])
    inside = inside.withColumn("upto", F.sum("k").over(Window.partitionBy(*by, "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.select(*by, "n", "min", "max", "v", F.explode(F.filter("ranks", lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("k")))).alias("r"))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("r.name") == name, F.col("v"))).alias(name) for name in ranks], F.first("min").alias("min"), F.first("max").alias("max"), F.first("n").alias("n"))


def five_numbers(by: list[str], df: DataFrame, value: Column, few: bool = True) -> DataFrame:
    """AGG-05 and AGG-10, by group, groups without a value dropped: nearest ranks, rounded half up."""
    nearest = lambda p: lambda n: F.floor(F.lit(p) * (n - 1) + F.lit(0.5)) + 1
    return order_statistics(by, df, value, {"q1": nearest(0.25), "median": nearest(0.5), "q3": nearest(0.75)}, few).select(*by, "min", "q1", "median", "q3", "max", "n")


def medians(by: list[str], df: DataFrame, value: Column, few: bool) -> DataFrame:
    """AGG-04, AGG-07: ``by`` and the exact ``median``: of an even number of values the mean of the middle two."""
    got = order_statistics(by, df, value, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor((n + 2) / 2)}, few)
    return got.select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"))


def run_summary(rows: DataFrame) -> DataFrame:
    """AGG-31: of each document and tool the first id, tables (0 if the first has no rows), longest time, total cost."""
    return rows.groupBy("document_id", "tool_name").agg(
        F.min_by("extraction_result_id", "table_index").alias("first_id"),
        F.when(F.min_by(F.coalesce(F.col("failure_reason") == "empty_output", F.lit(False)), F.col("table_index")), 0).otherwise(F.count("*")).alias("table_count"),
        F.max(F.coalesce("processing_time_ms", F.lit(0))).alias("processing_time_ms"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"),
        policy.rerun(F.col("is_transient_failure"), F.col("failure_reason")).alias("rerun"),
    )
