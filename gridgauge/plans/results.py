"""Results pages and exports: AGG-26 to AGG-32, SNK-01 to SNK-04, scans, joins and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.functions import text
from gridgauge.operators import cost, filters, policy, rollup
from gridgauge.plans.figures import r6
from gridgauge.plans.registry import query, rows_of, slots_of
from gridgauge.sources import bridge


def scored(spark, sf_dir) -> DataFrame:
    """JN-03: score, extraction and document; unscored rows vanish."""
    er, n = bridge.extractions(spark, sf_dir), bridge.tasks(bridge.load(spark, sf_dir, "lineitem"))
    rows = bridge.scores(er).join(er.drop("l_discount", "l_tax", "l_partkey").repartition(n, "extraction_result_id"), "extraction_result_id")
    return rows.repartition(n, "document_id").join(bridge.documents(spark, sf_dir), "document_id")


SCORED = "(select e.*, d.filename, d.complexity_tier, d.is_digital, d.page_count, s.f1_score, s.\"precision\", s.recall, s.teds_score, s.grits_top, s.grits_con, s.grits_loc from fx_score s join fx_extraction e using (extraction_result_id) join fx_document d using (document_id))"


def tool_summary(rows: DataFrame) -> DataFrame:
    """AGG-26: means over table rows; costs of zero are missing, so ``avg_table_cost_nonzero`` isn't a cost per page."""
    money = policy.nonzero(F.col("cost_usd"))
    means = [r6(F.avg(m)).alias(m) for m in dims.METRICS]
    return rows.groupBy("tool_name").agg(*means, r6(F.avg("processing_time_ms")).alias("avg_ms"), F.round(F.sum(money), 4).alias("total_cost"), r6(F.avg(money)).alias("avg_table_cost_nonzero"), F.count("*").alias("n"))


@query(f"""select tool_name, {', '.join(f'round(avg("{m}"), 6) as "{m}"' for m in dims.METRICS)}, round(avg(processing_time_ms), 6) as avg_ms, round(sum(nullif(cost_usd, 0)), 4) as total_cost, round(avg(nullif(cost_usd, 0)), 6) as avg_table_cost_nonzero, count(*) as n
  from {SCORED} where not is_transient_failure group by all""", "tables")
def agg_26_flt_12_tool_summary(spark, sf_dir):
    return tool_summary(filters.lasting(scored(spark, sf_dir)))


@query(f"""select tier, {', '.join(f"round(avg(f1_score) filter (tool_name = '{t}'), 4) as {t}" for t in dims.TOOLS)} from (select *, case when lower(trim(complexity_tier)) in ('low', 'medium', 'high') then lower(trim(complexity_tier)) else 'unconfirmed' end as tier from {SCORED}) group by tier""", "tables")
def agg_27_chart(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("tier", policy.tier(F.col("complexity_tier")))
    return rows.groupBy("tier").pivot("tool_name", list(dims.TOOLS)).agg(F.round(F.avg("f1_score"), 4))


@query(f"""select document_id, arg_min(tool_name, (-coalesce(f1, -1), tool_rank)) as best_tool, round(avg(f1), 6) as mean_f1, max(gt) as gt_tables, count(*) as n_tools from (
  select document_id, tool_name, round(avg(f1_score), 9) as f1 from {SCORED} group by all) join fx_tool using (tool_name) left join (select document_id, count(*) as gt from fx_gt group by all) using (document_id) group by document_id""", "tables")
def agg_28_srt_06_per_document(spark, sf_dir):
    """The best tool of each document by mean F1; ties go to the tool that comes first."""
    tools = scored(spark, sf_dir).groupBy("document_id", "tool_name").agg(F.round(F.avg("f1_score"), 9).alias("f1"))
    order = F.struct(-F.coalesce("f1", F.lit(-1.0)), dims.tool_rank(F.col("tool_name")))
    got = tools.groupBy("document_id").agg(F.min_by("tool_name", order).alias("best_tool"), r6(F.avg("f1")).alias("mean_f1"), F.count("*").alias("n_tools"))
    return got.join(rollup.truth_counts(bridge.ground_truth(spark, sf_dir)), "document_id", "left")


@query(f"select document_id, count(*) as n, string_agg(tool_name || ':' || table_index, ',' order by tool_name, table_index, extraction_result_id) as runs from {SCORED} group by all", "tables")
def agg_29_by_document(spark, sf_dir):
    runs = F.array_sort(F.collect_list(F.struct("tool_name", "table_index", "extraction_result_id")))
    return scored(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"), F.array_join(F.transform(runs, lambda x: F.concat_ws(":", x["tool_name"], x["table_index"])), ",").alias("runs"))


@query(f"""select document_id, tool_name, round(avg(f1_score), 6) as f1, round(avg(teds_score), 6) as teds, nullif(max(processing_time_ms), 0) as ms, round(nullif(sum(cost_usd), 0), 6) as cost, bool_or(coalesce(f1_score = 0, false)) as scored_zero from {SCORED} group by all""", "tables")
def agg_30_document_page(spark, sf_dir):
    zero = lambda c: F.when(c != 0, c)
    got = scored(spark, sf_dir).groupBy("document_id", "tool_name").agg(r6(F.avg("f1_score")).alias("f1"), r6(F.avg("teds_score")).alias("teds"), zero(F.max("processing_time_ms")).alias("ms"), r6(zero(F.sum("cost_usd"))).alias("cost"), F.bool_or(F.coalesce(F.col("f1_score") == 0, F.lit(False))).alias("scored_zero"))
    return got.orderBy("document_id", F.desc_nulls_last("f1"), dims.tool_rank(F.col("tool_name")))


@query("""select document_id, tool_name, arg_min(extraction_result_id, table_index) as first_id, case when coalesce(arg_min_null(failure_reason, table_index) = 'empty_output', false) then 0 else count(*) end as table_count, max(processing_time_ms) as processing_time_ms, round(sum(cost_usd), 6) as cost_usd,
  bool_or(is_transient_failure or coalesce(failure_reason not in ('tool_limitation', 'empty_output'), false)) as rerun from fx_extraction group by all""", "tables")
def agg_31_pol_08_run_summary(spark, sf_dir):
    got = rollup.run_summary(bridge.extractions(spark, sf_dir))
    return got.withColumn("cost_usd", r6(F.col("cost_usd")))


@query(f"""select document_id, filename, complexity_tier, tool_name, table_index, processing_time_ms, case when cost_usd <> 0 then cast(round(cost_usd, 6) as varchar) else '' end as cost_usd, {', '.join(f"coalesce(cast(round(\"{m}\", 6) as varchar), '') as \"{m}\"" for m in dims.METRICS)} from {SCORED}""", "tables")
def snk_01_scored_export(spark, sf_dir):
    """14 columns as written to CSV: null and zero cost are empty."""
    return scored_export(scored(spark, sf_dir))


def scored_export(rows: DataFrame, document_id=None) -> DataFrame:
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    said = lambda c: F.coalesce(r6(c).cast("string"), F.lit(""))
    return rows.select("document_id", "filename", "complexity_tier", "tool_name", "table_index", "processing_time_ms", said(policy.nonzero(F.col("cost_usd"))).alias("cost_usd"), *[said(F.col(m)).alias(m) for m in dims.METRICS])


def slot_export(slots: DataFrame) -> DataFrame:
    """SNK-02, JN-06, AGG-32: one line for each document and tool; transient runs keep time and cost but no metric."""
    known = F.col("has_extraction")
    metric = lambda m: F.when(known & ~F.col("is_transient_failure"), F.round(F.col(m), 6)).alias(m)
    of_run = lambda c: F.when(known, c)
    return slots.select("filename", "complexity_tier", "is_digital", "page_count", "tool_name", *map(metric, dims.METRICS), of_run(F.col("processing_time_ms")).alias("processing_time_ms"), of_run(r6(F.col("cost_usd"))).alias("cost_usd"), of_run(F.coalesce("failure_reason", F.lit(""))).alias("failure_reason"), of_run(F.col("is_transient_failure").cast("string")).alias("is_transient_failure"))


@query(f"""select filename, complexity_tier, is_digital, page_count, tool_name, {', '.join(f'case when has_extraction and not is_transient_failure then round("{m}", 6) end as "{m}"' for m in dims.METRICS)}, case when has_extraction then processing_time_ms end as processing_time_ms,
  case when has_extraction then round(cost_usd, 6) end as cost_usd, case when has_extraction then coalesce(failure_reason, '') end as failure_reason, case when has_extraction then cast(is_transient_failure as varchar) end as is_transient_failure from slot""")
def snk_02_jn_05_slot_export(spark, sf_dir):
    return slot_export(slots_of(spark, sf_dir))


@query("select document_id, tool_name, table_index, filename from fx_extraction join fx_document using (document_id)", "tables")
def jn_01_srt_01_extraction_document(spark, sf_dir):
    return bridge.extractions(spark, sf_dir).join(bridge.documents(spark, sf_dir), "document_id").select("document_id", "tool_name", "table_index", "filename").orderBy("filename", "tool_name", "table_index")


@query("select document_id, filename, uploaded_at from fx_document order by uploaded_at, document_id", "tables")
def src_01_documents(spark, sf_dir):
    return bridge.documents(spark, sf_dir).select("document_id", "filename", "uploaded_at").orderBy("uploaded_at", "document_id")


@query("select document_id, filename, uploaded_at from fx_document order by uploaded_at desc, document_id", "tables")
def src_02_documents_newest(spark, sf_dir):
    return bridge.documents(spark, sf_dir).select("document_id", "filename", "uploaded_at").orderBy(F.desc("uploaded_at"), "document_id")


def document(documents: DataFrame, document_id) -> DataFrame:
    """SRC-03: one document; an error if there is none."""
    got = documents.where(F.col("document_id") == document_id).limit(1)
    if got.isEmpty():
        raise KeyError(f"no document {document_id}")
    return got


@query("select document_id, filename from fx_document where document_id = 7", "tables")
def src_03_document(spark, sf_dir):
    return document(bridge.documents(spark, sf_dir), 7).select("document_id", "filename")


@query("select document_id, extraction_result_id, table_index from fx_extraction where tool_name = 'mistral' and document_id = (select document_id from fx_extraction where tool_name = 'mistral' group by 1 order by count(*) desc, 1 limit 1) order by table_index", "tables")
def src_04_run(spark, sf_dir):
    """The tables of one run: the mistral run with the most."""
    own = bridge.extractions(spark, sf_dir).where("tool_name = 'mistral'")
    first = own.groupBy("document_id").count().orderBy(F.desc("count"), "document_id").first()[0]
    return own.where(F.col("document_id") == first).select("document_id", "extraction_result_id", "table_index").orderBy("table_index")


@query("select document_id, table_index, confirmed from fx_gt where document_id = 7 order by table_index", "tables")
def src_05_truth(spark, sf_dir):
    return bridge.ground_truth(spark, sf_dir).where("document_id = 7").orderBy("table_index")


@query("select d.document_id, d.filename, e.tool_name, e.table_index, e.failure_reason, s.f1_score from fx_extraction e left join fx_score s using (extraction_result_id) join fx_document d using (document_id)", "tables")
def src_18_prj_01_jn_02_dataset(spark, sf_dir):
    """The dataset's rows: every extraction with its document, and its score if it has one."""
    return rows_of(spark, sf_dir).join(bridge.documents(spark, sf_dir).select("document_id", "filename"), "document_id").select("document_id", "filename", "tool_name", "table_index", "failure_reason", policy.number(F.col("f1_score")).alias("f1_score"))


@query("""select g.document_id, g.table_index, e.tool_name, max(e.extraction_result_id) as extraction_result_id from fx_gt g join fx_extraction e on e.document_id = g.document_id and e.table_index = g.table_index where g.confirmed group by all""", "tables")
def jn_04_flt_17_positional(spark, sf_dir):
    """Confirmed truth with the run's table of the same place; of repeated places the last row counts."""
    last = bridge.extractions(spark, sf_dir).groupBy("document_id", "tool_name", "table_index").agg(F.max("extraction_result_id").alias("extraction_result_id"))
    return bridge.ground_truth(spark, sf_dir).where("confirmed").join(last, ["document_id", "table_index"]).select("document_id", "table_index", "tool_name", "extraction_result_id")


@query("select e.extraction_result_id, g.confirmed from fx_extraction e join fx_gt g on g.document_id = e.document_id and g.table_index = e.table_index where e.failure_reason is null", "tables")
def jn_07_all_truth(spark, sf_dir):
    return bridge.extractions(spark, sf_dir).where("failure_reason is null").join(bridge.ground_truth(spark, sf_dir), ["document_id", "table_index"]).select("extraction_result_id", "confirmed")


@query("select count(*) as n, count(distinct document_id) as docs from fx_extraction left join fx_document d using (document_id) where d.filename is null or (lower(trim(complexity_tier)) = 'high' and is_digital)", "tables")
def flt_13_jn_08_by_document(spark, sf_dir):
    return filters.by_document(bridge.extractions(spark, sf_dir), bridge.documents(spark, sf_dir), "high", "digital").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("docs"))


@query("select extraction_result_id from fx_extraction where document_id in (select document_id from fx_gt where confirmed)", "tables")
def flt_16_of_documents(spark, sf_dir):
    return filters.of_documents(bridge.extractions(spark, sf_dir), bridge.ground_truth(spark, sf_dir).where("confirmed")).select("extraction_result_id")


@query("select extraction_result_id, tool_name, label, generation, tool_rank from fx_extraction join fx_tool using (tool_name)", "tables")
def prj_04_05_06_tools(spark, sf_dir):
    t = F.col("tool_name")
    return bridge.extractions(spark, sf_dir).select("extraction_result_id", "tool_name", dims.label(t).alias("label"), dims.generation(t).alias("generation"), dims.tool_rank(t).alias("tool_rank"))


@query(f"""select extraction_result_id, round(case tool_name {' '.join(f"when '{t}' then {dims.PAGE_PRICE[t]}" for t in dims.TOOLS)} end * coalesce(page_count, 0) + coalesce(case tool_name {' '.join(f"when '{t}' then coalesce(nullif(tin, 0), 1500 * coalesce(page_count, 0)) * {a} / 1000000.0 + coalesce(nullif(tout, 0), 2000 * coalesce(page_count, 0)) * {b} / 1000000.0" for t, (a, b) in dims.TOKEN_PRICE.items())} end, 0), 5) as cost
  from (select e.extraction_result_id, tool_name, page_count, case when l_partkey % 3 = 0 then null else l_partkey % 4 * 500 end as tin, case when l_partkey % 5 = 0 then null else l_partkey % 6 * 300 end as tout from fx_extraction e join fx_document d using (document_id))""", "tables")
def mth_07_cost(spark, sf_dir):
    part = F.col("l_partkey")
    rows = bridge.extractions(spark, sf_dir).join(bridge.documents(spark, sf_dir), "document_id")
    rows = rows.select("extraction_result_id", "tool_name", "page_count", F.when(part % 3 != 0, part % 4 * 500).alias("input_tokens"), F.when(part % 5 != 0, part % 6 * 300).alias("output_tokens"))
    return cost.with_cost(rows).select("extraction_result_id", F.round("cost_usd", 5).alias("cost"))


@query("select tool_name, round(sum(case when table_index = 0 then 1.0 else 0 end), 6) as runs, round(sum(cost_usd), 4) as before from fx_extraction group by all", "tables")
def snk_16_cost_before(spark, sf_dir):
    return bridge.extractions(spark, sf_dir).groupBy("tool_name").agg(F.sum(F.when(F.col("table_index") == 0, 1.0).otherwise(0.0)).alias("runs"), F.round(F.sum("cost_usd"), 4).alias("before"))


@query("""select document_id, tool_name, f1_score, row_number() over (partition by tool_name order by f1_score desc nulls last, document_id) as place from (select document_id, tool_name, round(f1_score, 6) as f1_score from slot where has_extraction)
  qualify place <= 5""")
def srt_03_04_top_documents(spark, sf_dir):
    """The five best documents of each tool, nulls last; ranks above the limit are dropped before the sort's full shuffle."""
    got = slots_of(spark, sf_dir).where("has_extraction").select("document_id", "tool_name", r6(F.col("f1_score")).alias("f1_score"))
    w = Window.partitionBy("tool_name").orderBy(F.desc_nulls_last("f1_score"), "document_id")
    return got.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")
