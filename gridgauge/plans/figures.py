"""AGG-06 to AGG-25: figures and dashboard charts over slots (one row for each document and tool).

Each figure aggregates to at most tools x tiers rows in one shuffle; completing missing tools and tiers
happens after that, on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.operators import filters, policy, rollup
from gridgauge.plans.registry import query, slots_of

#: Mean of a metric under a policy, with its plain SQL.
STRICT = "avg(strict_f1)"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def every_tool(df: DataFrame) -> DataFrame:
    return F.broadcast(dims.tool_dim(df.sparkSession).select("tool_rank", "tool_name", "label"))


def by_tool(df: DataFrame, **values: Column) -> DataFrame:
    """All seven tools with the aggregates, null where a tool has no row."""
    got = df.groupBy("tool_name").agg(*[c.alias(k) for k, c in values.items()])
    return dims.tool_dim(df.sparkSession).select("tool_rank", "tool_name", "label").join(got, "tool_name", "left").select("tool_rank", "tool_name", "label", *values)


def tool_by_tier(df: DataFrame, value: Column, tiers=dims.TIERS, missing: float | None = 0.0, digits: int = 6) -> DataFrame:
    """AGG-08: tools down, tiers across."""
    got = df.groupBy("tool_name").pivot("tier", list(tiers)).agg(F.round(value, digits))
    out = dims.tool_dim(df.sparkSession).select("tool_name").join(got, "tool_name", "left")
    return out.fillna(missing, list(tiers)) if missing is not None else out


def tier_by_tool(df: DataFrame, value: Column, tiers=dims.TIERS) -> DataFrame:
    """AGG-09: tiers down, tools across; gaps stay null."""
    got = df.groupBy("tier").pivot("tool_name", list(dims.TOOLS)).agg(r6(value))
    return df.sparkSession.createDataFrame([(t,) for t in tiers], "tier string").join(got, "tier", "left")


def points(df: DataFrame, x: Column, y: Column, drop_zero_x: bool = False) -> DataFrame:
    """AGG-14: a mean point for each tool that has both coordinates."""
    got = df.groupBy("tool_name").agg(F.avg(x).alias("x"), F.avg(y).alias("y")).where("x is not null and y is not null")
    return (got.where("x > 0") if drop_zero_x else got).select("tool_name", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))




def f1() -> Column:
    return policy.metric_value("f1_score")


tool_sql = lambda cols, where="", having="": f"select tool_name, label, {cols} from pol {where} group by all {having}"
tiers_sql = lambda v, tiers=dims.TIERS, missing="0.0", where="true", digits=6: f"select tool_name, {', '.join(f'coalesce(round(avg({v}) filter (tier = {t!r} and {where}), {digits}), {missing}) as {t}' for t in tiers)} from pol group by tool_name"
lines_sql = lambda v, tiers=dims.TIERS: f"select t.tier, {', '.join(f'round(avg({v}) filter (tool_name = {n!r}), 6) as {n}' for n in dims.TOOLS)} from fx_tier t left join pol on pol.tier = t.tier where t.tier in {tuple(tiers)} group by t.tier"
THREE = dims.TIERS[:3]


@query("select document_id, tool_name, reliability, n_tables, scored_tables, gt_tables, processing_time_ms, round(cost_usd, 6) as cost_usd, round(cost_per_page, 6) as cost_per_page, round(f1_score, 6) as f1_score, round(grits_con, 6) as grits_con, is_transient_failure, failure_reason, carrier, tier, generation from slot")
def agg_01_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [r6(F.col(c)).alias(c) for c in ("cost_usd", "cost_per_page", "f1_score", "grits_con")]
    return slots_of(spark, sf_dir).select("document_id", "tool_name", "reliability", "n_tables", "scored_tables", "gt_tables", "processing_time_ms", *rounded, "is_transient_failure", "failure_reason", "carrier", "tier", "generation")


@query("select document_id, count(*) as gt_tables from fx_gt group by all", "tables")
def agg_02_truth_counts(spark, sf_dir):
    from gridgauge.sources import bridge

    return rollup.truth_counts(bridge.ground_truth(spark, sf_dir))


@query("""with v as (select carrier, tool_name, unnest([f1_score, 'nan'::double, null]) as v from slot)
  select carrier, round(avg(v) filter (not isnan(v)), 6) as mean, round(median(v) filter (not isnan(v)), 6) as median from v group by all""".replace("with v as", ", v as", 1))
def agg_03_04_safe_mean_median(spark, sf_dir):
    slots = slots_of(spark, sf_dir).select("carrier", F.explode(F.array(F.col("f1_score"), F.lit(float("nan")), F.lit(None).cast("double"))).alias("v"))
    v = policy.finite(F.col("v"))
    means = slots.groupBy("carrier").agg(r6(F.avg(v)).alias("mean"))
    return means.join(rollup.medians(["carrier"], slots, v, few=False), "carrier", "left").select("carrier", "mean", r6(F.col("median")).alias("median"))


@query("select tool_name, tool_rank, label, round(avg(zero_f1), 6) as mean_f1 from pol group by all")
def agg_06_mean_by_tool(spark, sf_dir):
    return by_tool(slots_of(spark, sf_dir), mean_f1=r6(F.avg(policy.metric_value("f1_score", "zero_impute_failed"))))


@query("select tool_name, tool_rank, label, round(median(strict_f1), 6) as median_f1 from pol group by all")
def agg_07_median_by_tool(spark, sf_dir):
    found = rollup.medians(["tool_name"], slots_of(spark, sf_dir), f1(), few=True)
    return dims.tool_dim(spark).select("tool_name", "tool_rank", "label").join(found, "tool_name", "left").select("tool_name", "tool_rank", "label", r6(F.col("median")).alias("median_f1"))


@query(tiers_sql("strict_f1"))
def agg_08_tool_by_tier(spark, sf_dir):
    return tool_by_tier(slots_of(spark, sf_dir), F.avg(f1()))


@query(lines_sql("strict_f1"))
def agg_09_tier_by_tool(spark, sf_dir):
    return tier_by_tool(slots_of(spark, sf_dir), F.avg(f1()))


@query("""select tool_name, round(min(v), 6) as "min", round(list_sort(list(v))[cast(floor(0.25 * (count(*) - 1) + 0.5) as int) + 1], 6) as q1, round(list_sort(list(v))[cast(floor(0.5 * (count(*) - 1) + 0.5) as int) + 1], 6) as "median",
  round(list_sort(list(v))[cast(floor(0.75 * (count(*) - 1) + 0.5) as int) + 1], 6) as q3, round(max(v), 6) as "max", count(*) as n from (select tool_name, strict_f1 as v from pol where strict_f1 is not null) group by all""")
def agg_05_10_box_by_tool(spark, sf_dir):
    got = rollup.five_numbers(["tool_name"], slots_of(spark, sf_dir), f1())
    return got.select("tool_name", *[r6(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")], "n")


@query("select tool_name, " + ", ".join(f"count(*) filter (reliability = '{s}') as {s}" for s in dims.RELIABILITY) + " from slot group by all")
def agg_11_reliability_by_tool(spark, sf_dir):
    got = slots_of(spark, sf_dir).groupBy("tool_name").pivot("reliability", list(dims.RELIABILITY)).count()
    return dims.tool_dim(spark).select("tool_name").join(got, "tool_name", "left").fillna(0, list(dims.RELIABILITY))


@query("select tool_name, t.tier, count(*) filter (reliability = 'complete_failure') as failures, count(*) filter (reliability = 'missing_f1') as missing_f1, round(avg(strict_f1), 6) as mean_f1 from fx_tier t left join pol on pol.tier = t.tier group by all")
def agg_12_heatmap(spark, sf_dir):
    slots = slots_of(spark, sf_dir)
    cells = dims.tool_dim(spark).select("tool_name", F.explode(F.array(*map(F.lit, dims.TIERS))).alias("tier"))
    got = slots.groupBy("tool_name", "tier").agg(F.count_if(F.col("reliability") == "complete_failure").alias("failures"), F.count_if(F.col("reliability") == "missing_f1").alias("missing_f1"), r6(F.avg(f1())).alias("mean_f1"))
    return cells.join(got, ["tool_name", "tier"], "left").fillna(0, ["failures", "missing_f1"])


@query(tiers_sql("cost_usd", digits=9))
def agg_13_cost_by_tier(spark, sf_dir):
    return tool_by_tier(slots_of(spark, sf_dir), F.avg("cost_usd"), digits=9)


@query(tiers_sql("processing_time_ms"))
def agg_13_time_by_tier(spark, sf_dir):
    return tool_by_tier(slots_of(spark, sf_dir), F.avg("processing_time_ms"))


@query("select tool_name, round(avg(cost_per_page), 6) as x, round(avg(strict_f1), 6) as y from pol group by all having avg(cost_per_page) > 0 and avg(strict_f1) is not null")
def agg_14_scatter(spark, sf_dir):
    return points(slots_of(spark, sf_dir), F.col("cost_per_page"), f1(), drop_zero_x=True)


@query("select tool_name, tier, round(avg(grits_top), 6) as x, coalesce(round(avg(case when not is_transient_failure then grits_con end), 6), 0.0) as y from slot where not is_transient_failure and grits_top is not null group by all")
def agg_15_structure_scatter(spark, sf_dir):
    x, y = policy.metric_value("grits_top"), policy.metric_value("grits_con")
    return slots_of(spark, sf_dir).where(x.isNotNull()).groupBy("tool_name", "tier").agg(r6(F.avg(x)).alias("x"), F.coalesce(r6(F.avg(y)), F.lit(0.0)).alias("y"))


@query("select tool_name, " + ", ".join(f"round(100.0 * count(*) filter (reliability = '{s}') / count(*), 6) as {s}" for s in dims.RELIABILITY) + " from slot group by all")
def agg_16_reliability_share(spark, sf_dir):
    got = agg_11_reliability_by_tool(spark, sf_dir)
    total = sum((F.col(s) for s in dims.RELIABILITY[1:]), F.col(dims.RELIABILITY[0]))
    return got.select("tool_name", *[r6(F.when(total > 0, 100 * F.col(s) / total).otherwise(F.col(s))).alias(s) for s in dims.RELIABILITY])


@query("""select tool_name, label, round(avg(strict_f1), 6) as f1_score, round(avg("precision"), 6) as "precision", round(avg(recall), 6) as recall, round(avg(processing_time_ms), 4) as processing_time_ms, round(avg(cost_per_page), 6) as cost_per_page, round(sum(cost_usd), 4) as cost_usd
  from pol where not is_transient_failure and has_extraction group by all""")
def agg_17_explorer_by_tool(spark, sf_dir):
    rows = slots_of(spark, sf_dir).where("not is_transient_failure and has_extraction")
    means = [r6(F.avg(policy.metric_value(m))).alias(m) for m in ("f1_score", "precision", "recall")]
    return rows.groupBy("tool_name", "label").agg(*means, F.round(F.avg("processing_time_ms"), 4).alias("processing_time_ms"), r6(F.avg("cost_per_page")).alias("cost_per_page"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query("select tool_name, label, coalesce(round(avg(strict_f1), 6), 0.0) as f1, row_number() over (order by coalesce(round(avg(strict_f1), 6), 0.0) desc, tool_rank) as place from pol group by tool_name, label, tool_rank")
def agg_18_f1_by_tool(spark, sf_dir):
    """Mean F1 by tool, the best first."""
    from pyspark.sql import Window

    got = by_tool(slots_of(spark, sf_dir), f1=r6(F.avg(f1()))).fillna(0.0, ["f1"])
    return got.select("tool_name", "label", "f1", F.row_number().over(Window.orderBy(F.desc("f1"), "tool_rank")).cast("long").alias("place"))  # seven rows


@query(tiers_sql("strict_f1", THREE))
def agg_19_f1_three_tiers(spark, sf_dir):
    return tool_by_tier(slots_of(spark, sf_dir), F.avg(f1()), THREE)


@query(lines_sql("strict_f1", THREE))
def agg_20_f1_lines_three_tiers(spark, sf_dir):
    return tier_by_tool(slots_of(spark, sf_dir).where(F.col("tier") != "unconfirmed"), F.avg(f1()), THREE)


@query("select tool_name, coalesce(round(avg(case when not is_transient_failure then grits_top end), 6), 0.0) as grits_top, coalesce(round(avg(case when not is_transient_failure then grits_con end), 6), 0.0) as grits_con from slot group by all")
def agg_21_grits_by_tool(spark, sf_dir):
    got = by_tool(slots_of(spark, sf_dir), grits_top=r6(F.avg(policy.metric_value("grits_top"))), grits_con=r6(F.avg(policy.metric_value("grits_con"))))
    return got.select("tool_name", "grits_top", "grits_con").fillna(0.0)


@query("select tool_name, case when open_source then 0.0 else round(avg(cost_per_page), 6) end as x, round(avg(strict_f1), 6) as y from pol group by tool_name, open_source having (open_source or avg(cost_per_page) is not null) and avg(strict_f1) is not null")
def agg_22_cost_f1(spark, sf_dir):
    x = F.when(F.col("open_source"), F.lit(0.0)).otherwise(F.col("cost_per_page"))
    return points(slots_of(spark, sf_dir), x, f1())


@query("select tool_name, round(avg(processing_time_ms), 6) as x, round(avg(strict_f1), 6) as y, round(log10(greatest(avg(processing_time_ms), 1)), 6) as log_x, round(avg(processing_time_ms) filter (has_extraction), 6) as x_of_runs from pol group by all having avg(strict_f1) is not null")
def agg_23_mth_09_runtime_f1(spark, sf_dir):
    """Slots without a run count as 0 ms in ``x``; ``x_of_runs`` leaves them out; ``log_x`` is for a log axis."""
    got = slots_of(spark, sf_dir).groupBy("tool_name").agg(F.avg("processing_time_ms").alias("x"), F.avg(f1()).alias("y"), F.avg(F.when(F.col("has_extraction"), F.col("processing_time_ms"))).alias("r")).where("y is not null")
    return got.select("tool_name", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.log10(F.greatest(F.col("x"), F.lit(1.0)))).alias("log_x"), r6(F.col("r")).alias("x_of_runs"))


@query("select tool_name, count(*) filter (reliability = 'success') as success, count(*) filter (reliability in ('partial', 'missing_f1')) as structural, count(*) filter (reliability not in ('success', 'partial', 'missing_f1')) as other from slot group by all")
def agg_24_failure_stack(spark, sf_dir):
    r = F.col("reliability")
    got = by_tool(slots_of(spark, sf_dir), success=F.count_if(r == "success"), structural=F.count_if(r.isin("partial", "missing_f1")), other=F.count_if(~r.isin("success", "partial", "missing_f1")))
    return got.select("tool_name", "success", "structural", "other").fillna(0)


@query("select * from (" + tiers_sql("cost_per_page", THREE) + ") where tool_name not in ('pymupdf', 'docling')")
def agg_25_cost_by_tier_commercial(spark, sf_dir):
    return tool_by_tier(slots_of(spark, sf_dir).where("not open_source"), F.avg("cost_per_page"), THREE).where(~F.col("tool_name").isin(*dims.OPEN_SOURCE))


@query("select distinct carrier from slot")
def agg_55_carriers(spark, sf_dir):
    return slots_of(spark, sf_dir).select("carrier").distinct().orderBy("carrier")


@query("""select document_id, tool_name, reliability, tier from slot where tool_name in ('gpt5', 'mistral', 'pymupdf') and generation in ('llm') and tier in ('high', 'low') and contains(lower(filename), 'carrier3')
  and carrier = 'Carrier3' and not open_source and cost_per_page >= 0.0001 and processing_time_ms <= 4500 and page_count >= 5 and is_digital and (reliability = 'complete_failure' or is_transient_failure)""")
def flt_01_filter(spark, sf_dir):
    f = filters.SlotFilter(("gpt5", "mistral", "pymupdf"), ("llm",), ("HIGH", "low"), " CARRIER3", "Carrier3", "commercial", (0.0001, None), (None, 4500), (5, None), "digital", "failures")
    return f.apply(slots_of(spark, sf_dir)).select("document_id", "tool_name", "reliability", "tier")


@query("select tool_name, count(*) filter (scored_tables > 0) as with_scores, count(strict_f1) as strict, count(zero_f1) as zero_imputed from pol group by all")
def flt_10_11_pol_01_contributing(spark, sf_dir):
    slots = slots_of(spark, sf_dir)
    return slots.groupBy("tool_name").agg(F.count_if(F.col("scored_tables") > 0).alias("with_scores"), F.count(f1()).alias("strict"), F.count(policy.metric_value("f1_score", "zero_impute_failed")).alias("zero_imputed"))
