"""Queries of single predicates, policies, scans, sinks, graphs and streams, each with its own SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.functions import tables as tb
from gridgauge.operators import boxes, choice, cost, filters, policy, quality, sequences, sinks, store, truth
from gridgauge.plans.figures import r6
from gridgauge.plans.registry import folder, query, slots_of
from gridgauge.plans.results import SCORED, scored, scored_export, slot_export
from gridgauge.sources import bridge, payloads
from gridgauge.streaming import progress

SLOT = "document_id, tool_name"
TOOL_OF = "['pymupdf', 'docling', 'aws_textract', 'google_docai', 'gpt5', 'claude_sonnet', 'mistral']"


def orders(spark, sf_dir, *more) -> DataFrame:
    return bridge.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *more)


def kept(spark, sf_dir, **more) -> DataFrame:
    return filters.SlotFilter(**more).apply(slots_of(spark, sf_dir)).select("document_id", "tool_name")


# --- filters, one predicate each --------------------------------------------------------------------------------------


@query(f"select {SLOT} from slot where tool_name in ('docling', 'mistral') and generation in ('cv', 'llm') and tier in ('low', 'unconfirmed')")
def flt_02_lists(spark, sf_dir):
    return kept(spark, sf_dir, tools=("docling", "mistral"), generations=("cv", "llm"), tiers=("LOW", "unconfirmed"))


@query(f"select {SLOT} from slot where contains(lower(filename), '_1') or contains(cast(document_id as varchar), '_1')")
def flt_03_search(spark, sf_dir):
    return kept(spark, sf_dir, search="  _1 ")


@query(f"select {SLOT} from slot where carrier = 'Carrier4'")
def flt_04_carrier(spark, sf_dir):
    return kept(spark, sf_dir, carrier="Carrier4")


@query(f"select {SLOT}, 'open' as side from slot where open_source union all select {SLOT}, 'commercial' from slot where not open_source")
def flt_05_source(spark, sf_dir):
    return kept(spark, sf_dir, source="open_source").withColumn("side", F.lit("open")).unionByName(kept(spark, sf_dir, source="commercial").withColumn("side", F.lit("commercial")))


@query(f"select {SLOT} from slot where cost_per_page >= 0.001 and cost_per_page <= 0.01 and processing_time_ms >= 500 and processing_time_ms <= 4000 and page_count >= 3 and page_count <= 50")
def flt_06_ranges(spark, sf_dir):
    return kept(spark, sf_dir, cost=(0.001, 0.01), time_ms=(500, 4000), pages=(3, 50))


@query(f"select {SLOT}, 'digital' as scan from slot where is_digital union all select {SLOT}, 'scanned' from slot where not is_digital union all select {SLOT}, 'unknown' from slot where is_digital is null")
def flt_07_scan(spark, sf_dir):
    parts = [kept(spark, sf_dir, scan=s).withColumn("scan", F.lit(s)) for s in ("digital", "scanned", "unknown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select {SLOT}, 'failures' as status from slot where reliability = 'complete_failure' or is_transient_failure union all select {SLOT}, 'transient' from slot where is_transient_failure union all select {SLOT}, 'partial' from slot where reliability = 'partial'")
def flt_08_status(spark, sf_dir):
    parts = [kept(spark, sf_dir, status=s).withColumn("status", F.lit(s)) for s in ("failures", "transient", "partial")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select {SLOT} from slot where n_tables > 1 and gt_tables = 0")
def flt_09_more(spark, sf_dir):
    return kept(spark, sf_dir, more=(F.col("n_tables") > 1, F.col("gt_tables") == 0))


@query(f"select extraction_result_id from {SCORED} where lower(trim(complexity_tier)) = 'medium'", "tables")
def flt_14_tier(spark, sf_dir):
    return scored(spark, sf_dir).where(policy.tier(F.col("complexity_tier")) == dims.check_tier("medium")).select("extraction_result_id")


@query("select tool_name, count(*) as n from fx_extraction group by all union all select tool_name || '+', count(*) from fx_extraction where tool_name in ('gpt5', 'docling') group by all", "tables")
def flt_15_tools(spark, sf_dir):
    of = lambda tools: bridge.extractions(spark, sf_dir).where(F.col("tool_name").isin(*dims.check_tools(tools))).groupBy("tool_name").agg(F.count("*").alias("n"))
    return of("all").unionByName(of(["gpt5", "docling"]).withColumn("tool_name", F.concat("tool_name", F.lit("+"))))


@query("select o_orderkey as k, 'admin' as who from orders union all select o_orderkey, 'c3' from orders where o_custkey % 5 = 3 union all select o_orderkey, 'none' from orders where o_custkey % 5 = 0", None)
def flt_18_company(spark, sf_dir):
    c = F.col("o_custkey") % 5
    rows = orders(spark, sf_dir, F.when(c > 0, F.concat(F.lit("c"), c.cast("string"))).alias("company_id"))
    parts = [filters.of_company(rows, *x).select("k").withColumn("who", F.lit(n)) for n, x in (("admin", (True, None)), ("c3", (False, "c3")), ("none", (False, None)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select o_orderkey as k from orders where o_custkey % 3 = 1", None)
def flt_19_active(spark, sf_dir):
    return filters.active(orders(spark, sf_dir, (F.col("o_custkey") % 3).alias("is_active"))).select("k")


# --- policies ---------------------------------------------------------------------------------------------------------

RAW_TIER = "case o_orderkey % 6 when 0 then ' High ' when 1 then 'LOW' when 2 then 'medium' when 3 then '' when 4 then null else 'unconfirmed' end"


@query(f"select o_orderkey as k, case when lower(trim({RAW_TIER})) in ('low', 'medium', 'high') then lower(trim({RAW_TIER})) else 'unconfirmed' end as tier from orders", None)
def pol_02_tier(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, " High ").when(k == 1, "LOW").when(k == 2, "medium").when(k == 3, "").when(k == 5, "unconfirmed")
    return orders(spark, sf_dir, policy.tier(raw).alias("tier"))


@query("""select k, case when not has then 'unevaluated' when tr then 'complete_failure' when s = 0 then 'missing_f1' when s < t or g > 0 and t < g then 'partial' else 'success' end as state
  from (select o_orderkey as k, o_orderkey % 5 > 0 as has, o_orderkey % 7 = 0 as tr, least(o_orderkey % 4, o_custkey % 4) as s, o_orderkey % 4 as t, o_custkey % 3 * 2 as g from orders)""", None)
def pol_03_reliability(spark, sf_dir):
    """All combinations of run, failure, scored and annotated tables."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, sf_dir, policy.reliability(k % 5 > 0, k % 7 == 0, F.least(k % 4, c % 4), k % 4, c % 3 * 2).alias("state"))


@query("""select o_orderkey as k, case when o_orderkey % 8 in (0, 1, 2) then 'rate_limit' when o_orderkey % 8 in (3, 4) then 'server_down' when o_orderkey % 8 = 5 then 'timeout' else 'api_error' end as reason, o_orderkey % 8 <> 7 as retriable from orders""", None)
def pol_06_11_exceptions(spark, sf_dir):
    k = (F.col("o_orderkey") % 8 + 1).cast("int")
    of = lambda *v: F.element_at(F.array(*map(F.lit, v)), k)
    kind = of("RateLimitError", "ValueError", "ClientError", "APIConnectionError", "ConnectionError", "TimeoutError", "ValueError", "KeyError")
    code = of("", "503", "", "", "", "", "", "")
    said = of("Rate limit", "overloaded", "Rate exceeded: connection", "connection reset", "Connection refused", "timeout of 3 s", "HTTP 502", "no such key")
    return orders(spark, sf_dir, policy.failure_of_exception(kind, said, code).alias("reason"), policy.retriable(said).alias("retriable"))


@query("""with e as (select event_id, event_type, 430 + cast(json_extract_string(props, '$.k') as int) as code from events)
  select event_id, case when code in (503, 529) then 'rate_limit' when event_type = 'error' then 'server_down' when event_type = 'purchase' then 'timeout' else 'api_error' end as reason, code in (500, 502, 503, 504, 529) as retriable from e""", None)
def pol_06_11_events(spark, sf_dir):
    """Each event as a call that failed, with the status that it carries."""
    code = (430 + F.get_json_object("props", "$.k").cast("int")).cast("string")
    kind = F.when(F.col("event_type") == "error", "APIConnectionError").when(F.col("event_type") == "purchase", "TimeoutError").otherwise("ValueError")
    said = F.concat(F.lit("HTTP "), code)
    return bridge.load(spark, sf_dir, "events").select("event_id", policy.failure_of_exception(kind, said, code).alias("reason"), policy.retriable(said).alias("retriable"))


@query(f"select extraction_result_id, round(nullif(cost_usd, 0), 6) as cost, round(f1_score, 6) as f1 from {SCORED}", "tables")
def jn_03_prj_02_scored(spark, sf_dir):
    """Scored runs with their documents; costs of zero are missing, F1 of zero isn't."""
    return scored(spark, sf_dir).select("extraction_result_id", r6(policy.nonzero(F.col("cost_usd"))).alias("cost"), r6(policy.number(F.col("f1_score"))).alias("f1"))


@query("select t.tool_rank, t.tool_name, t.generation, t.label, t.tool_name in ('pymupdf', 'docling') as open_source, count(*) as runs from fx_tool t join fx_extraction e using (tool_name) group by all", "tables")
def prj_07_tools(spark, sf_dir):
    return dims.tool_dim(spark).join(bridge.extractions(spark, sf_dir).groupBy("tool_name").agg(F.count("*").alias("runs")), "tool_name")


@query(f"""select tool_name, {', '.join(f'round(avg(case when has_extraction and not is_transient_failure then round("{m}", 6) end), 5) as "{m}"' for m in dims.METRICS)}, count(*) filter (has_extraction) as runs, count(*) as lines from slot group by all""")
def jn_06_agg_32_export_means(spark, sf_dir):
    """Means over the lines of the slot export."""
    rows = slot_export(slots_of(spark, sf_dir))
    return rows.groupBy("tool_name").agg(*[F.round(F.avg(m), 5).alias(m) for m in dims.METRICS], F.count("processing_time_ms").alias("runs"), F.count("*").alias("lines"))


@query("""select extraction_result_id, case when n is null or n = 0 then null else n end as tokens from (select extraction_result_id, case l_partkey % 4 when 0 then 0 when 1 then null when 2 then cast(l_partkey as int) end as n from fx_extraction)""", "tables")
def mth_08_tokens(spark, sf_dir):
    p = F.col("l_partkey")
    raw = F.when(p % 4 == 0, '{"usage":{"input_tokens":0}}').when(p % 4 == 1, '{"usage":{"input_tokens":"many"}}').when(p % 4 == 2, F.concat(F.lit('{"usage":{"input_tokens":'), p.cast("string"), F.lit("}}"))).otherwise("[]")
    return bridge.extractions(spark, sf_dir).select("extraction_result_id", cost.tokens_of(raw, "input_tokens").alias("tokens"))


# --- cells, boxes, regions ----------------------------------------------------------------------------------------------

LN = "ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem)"


def lines(spark, sf_dir) -> DataFrame:
    from gridgauge.plans.rows import lines as numbered

    return numbered(spark, sf_dir)


@query(f"""with {LN}, p as (select l_orderkey as k, rn - 1 as r, l_linenumber % 2 as c, cast(l_suppkey as varchar) as v from ln where rn <> 3), t as (select l_orderkey as k, rn - 1 as r, l_linenumber % 2 as c, case when l_partkey % 4 = 0 then 'x' else cast(l_suppkey as varchar) end as v from ln where rn <> 2)
  select k, count(*) filter (p.v is not null and t.v is not null) as shared, count(*) filter (p.v = t.v) as equal, count(*) as places, round(count(*) filter (p.v = t.v) / count(*), 6) as match from p full outer join t using (k, r, c) group by k""", None)
def jn_13_mth_12_cells(spark, sf_dir):
    t = lines(spark, sf_dir)
    at = lambda rows, v: rows.select(F.col("l_orderkey").alias("k"), (F.col("rn") - 1).alias("row"), (F.col("l_linenumber") % 2).alias("col"), v.alias("value"))
    own = F.col("l_suppkey").cast("string")
    got = boxes.cell_match(at(t.where("rn <> 3"), own), at(t.where("rn <> 2"), F.when(F.col("l_partkey") % 4 == 0, "x").otherwise(own)), ["k"])
    return got.withColumn("match", r6(F.col("match")))


@query(f"""with {LN}, c as (select l_orderkey as k, count(*) as n, avg(length(cast(l_partkey * 100 as varchar))) as mean_length, count(distinct (round(l_quantity, -1), round(l_suppkey, -1))) as places from ln group by all)
  select k, n, round(mean_length, 6) as mean_length, places, case when n < 30 and mean_length < 15 and places <= n then 'simple' else 'complex' end as complexity from c""", None)
def mth_24_complexity(spark, sf_dir):
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") * 100).cast("string").alias("value"), F.col("l_quantity").alias("x"), F.col("l_suppkey").alias("y"))
    return quality.complexity(t, ["k"]).withColumn("mean_length", r6(F.col("mean_length")))


@query(f"""with {LN}, f as (select l_orderkey as k, rn, case when l_partkey % 3 = 0 then 'Acme ' || l_suppkey || ' Group' end as found, case when l_partkey % 3 = 0 then 'Acme ' || l_suppkey || ' Group' else 'v' || l_partkey end as a from ln),
  c as (select *, coalesce(last_value(found ignore nulls) over (partition by k order by rn rows between unbounded preceding and current row), '') as company from f)
  select k, rn, company || '|' || a || '|9' as every, case when found is not null or company = '' then a || '|9' else company || '|' || a || '|9' end as kept from c""", None)
def win_06_tbl_30_company_column(spark, sf_dir):
    p = F.col("l_partkey")
    a = F.when(p % 3 == 0, F.concat(F.lit("Acme "), F.col("l_suppkey").cast("string"), F.lit(" Group"))).otherwise(F.concat(F.lit("v"), p.cast("string")))
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), "rn", F.array(a, F.lit("9")).alias("cells"))
    every = sequences.with_company_column(t, ["k"], "rn", "cells").select("k", "rn", F.array_join("cells", "|").alias("every"))
    own = sequences.with_company_column(t, ["k"], "rn", "cells", keep_headers=True).select("k", "rn", F.array_join("cells", "|").alias("kept"))
    return every.join(own, ["k", "rn"])


@query("select o_orderkey as k, cast(o_orderkey % 3 as int) as r0, cast(o_orderkey % 4 as int) as c0, cast(o_orderkey % 3 + o_orderkey % 5 as int) as r1, cast(o_orderkey % 4 + o_orderkey % 2 + 1 as int) as c1 from orders", None)
def win_22_region(spark, sf_dir):
    """A full block somewhere in a grid, and one cell apart from it."""
    k = F.col("o_orderkey")
    up = lambda n: F.sequence(F.lit(0).cast("long"), n)
    block = orders(spark, sf_dir, F.explode(up(k % 5)).alias("i"), up(k % 2 + 1).alias("js")).select("k", "i", F.explode("js").alias("j"))
    cells = block.select("k", (F.col("k") % 3 + F.col("i")).alias("r"), (F.col("k") % 4 + F.col("j")).alias("c"), F.lit("x").alias("v"))
    apart = orders(spark, sf_dir).select("k", (F.col("k") * 0 + 19).alias("r"), (F.col("k") * 0 + 9).alias("c"), F.lit("y").alias("v"))
    return sequences.grown_region(cells.unionByName(apart), ["k"], density=0.01)


@query(f"""with {LN}, o as (select l_orderkey as k, rn from ln where l_partkey % 3 > 0 and l_partkey > 9), r as (select *, rn - row_number() over (partition by k order by rn) as run from o) select k, min(rn) as first, max(rn) as last, count(*) as n from r group by k, run having count(*) >= 2""", None)
def win_25_text_regions(spark, sf_dir):
    p = F.col("l_partkey")
    line = F.when(p % 3 == 0, F.concat(F.lit("plain text "), p.cast("string"))).when(p <= 9, F.concat(F.lit("a    "), p.cast("string"))).otherwise(F.concat(F.lit("cell   "), p.cast("string"), F.lit("     x")))
    return sequences.text_regions(lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), "rn", line.alias("line")), ["k"], "rn", "line")


SHEET = f"{LN}, c as (select l_orderkey as k, rn + rn // 3 as r, rn % 2 as c0 from ln where l_partkey % 5 > 0)"


@query(f"""with {SHEET}, r as (select *, r - row_number() over (partition by k order by r) as run from c) select k, min(r) as r0, max(r) as r1, min(c0) as c0, max(c0 + 2) as c1 from r group by k, run having max(r) > min(r)""", None)
def tbl_21_regions(spark, sf_dir):
    rn = F.col("rn")
    rows = lines(spark, sf_dir).where("l_partkey % 5 > 0").select(F.col("l_orderkey").alias("k"), (rn + F.floor(rn / 3)).alias("row"), F.explode(F.array(rn % 2, rn % 2 + 1, rn % 2 + 2)).alias("col"), rn)
    # Rows of one filled cell and blank ones are no part of a region.
    return payloads.excel_regions(rows.select("k", "row", "col", F.when((F.col("col") + F.col("rn")) % 2 == 0, " ").otherwise("v").alias("value")).where("value = 'v' or col >= 0").withColumn("value", F.lit("v")), ["k"])


@query(f"""with {LN}, w as (select l_orderkey as k, rn, (2 + (l_partkey % 3 > 0)::int) / 3.0 as score from ln where l_partkey % 3 < 2), v as (select l_orderkey as k, rn, case l_partkey % 3 when 0 then 1.0 / 3 when 1 then 2.0 / 3 else 1.0 end as score from ln where rn <= 5)
  select k, arg_max(rn, (score, -rn)) as header_row from v group by k""", None)
def tbl_22_header_row(spark, sf_dir):
    p = F.col("l_partkey")
    cells = F.array(F.lit("Name"), F.when(p % 3 == 0, "12").otherwise("Policy"), F.when(p % 3 < 2, "$5").otherwise("Date"))
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("rn").alias("row"), F.posexplode(cells).alias("col", "value"))
    return payloads.best_header_row(rows, ["k"])


@query("""select o_orderkey as k, case o_orderkey % 5 when 0 then '{"a":[1,2],"b":"x,]"}' when 1 then '[1,{"c":2}]' when 2 then '{"k":' || o_orderkey || '}' when 3 then null else '{"t":[[1],[2]]}' end as said from orders""", None)
def tbl_26_27_repair(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, '```json\n{"a": [1, 2,], "b": "x,]"}\n```').when(k % 5 == 1, 'Here: [1, {"c": 2}, {"d').when(k % 5 == 2, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).when(k % 5 == 3, "no json here").otherwise('{"t": [[1], [2], [3')
    got = payloads.repaired(orders(spark, sf_dir, raw.alias("said")), "said")
    return got.select("k", F.regexp_replace("said", r"(?<=[:,])\s", "").alias("said"))


@query("""with items as (select l_orderkey as k, '{"p":' || l_partkey || ',"n":"' || l_linenumber || '"}' as item from lineitem),
  placed as (select k, item, row_number() over w as i, sum(length(item) + 1) over (w rows unbounded preceding) as until, sum(length(item) + 1) over (partition by k) + 1 as total from items window w as (partition by k order by item))
  select k, case when count(*) filter (until <= k * 37 % (total + 1)) > 0 then '[' || string_agg(item, ',' order by item) filter (until <= k * 37 % (total + 1)) || ']' end as said from placed group by k""", None)
def tbl_26_27_cut_answers(spark, sf_dir):
    """Lines of each order as a JSON answer that breaks off somewhere: what is left is closed after its last whole line."""
    item = F.concat(F.lit('{"p":'), F.col("l_partkey").cast("string"), F.lit(',"n":"'), F.col("l_linenumber").cast("string"), F.lit('"}'))
    whole = bridge.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("whole"))
    cut = F.substring("whole", F.lit(1), F.col("k") * 37 % (F.length("whole") + 1))
    said = whole.select("k", F.concat(F.when(F.col("k") % 2 == 0, "```json\n").otherwise("Here it is: "), cut).alias("said"))
    return payloads.repaired(said, "said").select("k", F.regexp_replace("said", r"(?<=[:,])\s", "").alias("said"))


@query("""select o_orderkey as k, '{"a":' || case when o_orderkey % 2 = 0 then 'null' else '"' || o_orderstatus || '"' end || ',"n":' || o_custkey || '}' as said from orders""", None)
def tbl_02_json_text(spark, sf_dir):
    k = F.col("o_orderkey")
    return orders(spark, sf_dir, payloads.json_text(F.struct(F.when(k % 2 == 1, F.col("o_orderstatus")).alias("a"), F.col("o_custkey").alias("n"))).alias("said"))


@query("""with b as (select o_orderkey as k, o_orderkey % 3 as c from orders) select k, 1 as n_tables, case c when 0 then 'Name 0|Sum' when 1 then 'a|b' else 'h' end as headers, case c when 0 then 'x y|[X];z|' when 1 then 'c|d' else 'v' end as rows, case c when 0 then 90.0 when 1 then 80.0 else 0.0 end as confidence from b""", None)
def src_09_tbl_09_10_blocks(spark, sf_dir):
    """Block graphs of three kinds: marked headers with a chosen box and an empty column at the end; no header mark; one column without confidence."""
    cell = lambda i, r, c, kids, head=False, conf=90.0: (i, "CELL", kids, r, c, 1, 1, head, conf, None, None)
    word = lambda i, t: (i, "WORD", [], None, None, None, None, False, None, t, None)
    box = lambda i, on: (i, "SELECTION_ELEMENT", [], None, None, None, None, False, None, None, on)
    table = lambda kids: ("t", "TABLE", kids, None, None, None, None, False, None, None, None)
    graphs = {
        0: [table(["c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9"]), cell("c1", 1, 1, ["w1", "w2"], True), cell("c2", 1, 2, ["w3"], True), cell("c3", 1, 3, []), cell("c4", 2, 1, ["w4", "w5"]), cell("c5", 2, 2, ["s1"]), cell("c6", 2, 3, ["s2"]), cell("c7", 3, 1, ["w6"]), cell("c8", 3, 2, []), cell("c9", 4, 1, []),
            word("w1", "Name"), word("w2", "0"), word("w3", "Sum"), word("w4", "x"), word("w5", "y"), word("w6", "z"), box("s1", True), box("s2", False)],
        1: [table(["c1", "c2", "c3", "c4"]), cell("c1", 1, 1, ["w1"], conf=70.0), cell("c2", 1, 2, ["w2"]), cell("c3", 2, 1, ["w3"], conf=None), cell("c4", 2, 2, ["w4"], conf=0.0), *[word(f"w{k}", t) for k, t in enumerate("abcd", 1)]],
        2: [table(["c1", "c2"]), cell("c1", 2, 1, ["w1"], True, None), cell("c2", 3, 1, ["w2"], False, None), word("w1", "h"), word("w2", "v")],
    }
    schema = "c int, id string, type string, children array<string>, row int, col int, row_span int, col_span int, is_header boolean, confidence double, text string, selected boolean"
    blocks = spark.createDataFrame([(c, *b) for c, g in graphs.items() for b in g], schema)
    of = orders(spark, sf_dir).withColumn("c", (F.col("k") % 3).cast("int")).join(F.broadcast(blocks), "c").drop("c")
    got = payloads.blocks_to_tables(of, ["k"])
    return got.groupBy("k").agg(F.count("*").alias("n_tables"), F.first(F.array_join("headers", "|")).alias("headers"), F.first(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")).alias("rows"), F.first("confidence").alias("confidence"))


@query("select o_orderkey as k, case when o_orderkey % 4 = 3 then 'c' when o_orderkey % 4 = 2 then 'b' else 'a' end as best from orders", None)
def src_08_strategy(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    table = lambda name, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda j: F.struct(F.array(F.lit(name)).alias("headers"), F.when(j == 1, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit(name)))).alias("rows")))
    t = orders(spark, sf_dir, F.explode(F.array(F.struct(F.lit(0).alias("rank"), table("a", F.lit(2)).alias("tables")), F.struct(F.lit(1).alias("rank"), table("b", k + 1).alias("tables")), F.struct(F.lit(2).alias("rank"), table("c", F.when(k == 3, 5).otherwise(2)).alias("tables")))).alias("s"))
    return payloads.best_strategy(t.select("k", "s.rank", "s.tables"), ["k"]).select("k", F.get(F.get("tables", 0)["headers"], 0).alias("best"))


@query("select o_orderkey as k, case when o_orderkey % 4 > 0 and o_orderkey % 4 >= o_custkey % 5 then 'structured' else 'text' end as won from orders", None)
def src_14_arbitrate(spark, sf_dir):
    """Tables of a structured answer and of its text, with so many rows each; some answers hold no table."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    table = lambda name, n: F.array(F.struct(F.array(F.lit(name)).alias("headers"), F.transform(tb.numbers_to(n.cast("int")), lambda j: F.array(F.lit(name))).alias("rows")))
    got = payloads.arbitrate(F.when(k > 0, table("structured", k)), table("text", c))
    return orders(spark, sf_dir, F.get(F.get(got, 0)["headers"], 0).alias("won"))


@query("""with n as (select l_orderkey as k, count(*) filter (where l_linestatus = 'F') as f, count(*) filter (where l_linestatus <> 'F') as o,
    string_agg(l_partkey::varchar, ',' order by l_partkey::varchar) filter (where l_linestatus = 'F') as fs, string_agg(l_partkey::varchar, ',' order by l_partkey::varchar) filter (where l_linestatus <> 'F') as os from lineitem group by l_orderkey)
  select k, case when f > 0 and f >= o then 'structured' else 'text' end as won, case when f > 0 and f >= o then fs else os end as parts from n""", None)
def src_14_arbitrate_lines(spark, sf_dir):
    """Finished lines of each order as the structured answer's table, the others as that of its text."""
    done, part = F.col("l_linestatus") == "F", F.array(F.col("l_partkey").cast("string"))
    rows = lambda of: F.array_sort(F.collect_list(F.when(of, part)))
    both = bridge.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(rows(done).alias("done"), rows(~done).alias("open"))
    table = lambda name, of: F.when(F.size(of) > 0, F.array(F.struct(F.array(F.lit(name)).alias("headers"), F.col(of).alias("rows"))))
    won = both.select("k", F.get(payloads.arbitrate(table("structured", "done"), table("text", "open")), 0).alias("t"))
    return won.select("k", F.get("t.headers", 0).alias("won"), F.array_join(F.flatten("t.rows"), ",").alias("parts"))


@query("select o_orderkey as k, 'Name|' || o_custkey as header, 'a b|' || o_orderkey as row from orders", None)
def src_20_layout(spark, sf_dir):
    block = lambda *t: F.concat(F.lit('{"blocks":['), F.concat_ws(",", *[F.concat(F.lit('{"textBlock":{"text":"'), x, F.lit('"}}')) for x in t]), F.lit("]}"))
    row = lambda *c: F.concat(F.lit('[{"cells":['), F.concat_ws(",", *c), F.lit("]}]"))
    said = lambda c: F.col(c).cast("string")
    raw = F.concat(F.lit('{"headerRows":'), row(block(F.lit("Name ")), block(said("o_custkey"))), F.lit(',"bodyRows":'), row(block(F.lit("a"), F.lit("b")), block(said("o_orderkey"))), F.lit("}"))
    got = payloads.from_layout(orders(spark, sf_dir, raw.alias("layout")), "layout")
    return got.select("k", F.array_join(F.get("header_rows", 0), "|").alias("header"), F.array_join(F.get("rows", 0), "|").alias("row"))


def truth_tables(spark, sf_dir, headers, rows) -> DataFrame:
    return orders(spark, sf_dir).select(F.col("k").alias("document_id"), F.lit(0).alias("table_index"), F.lit("docling").alias("tool_name"), headers.alias("headers"), rows.alias("rows"))


@query("select o_orderkey as document_id, 0 as table_index, 'seed:docling' as source, false as confirmed, 0 as correction_count from orders where o_orderkey % 3 > 0", None)
def tbl_36_seed(spark, sf_dir):
    k = F.col("k")
    rows = F.when(k % 3 > 0, F.array(F.array(k.cast("string")))).otherwise(tb.no_rows())
    return truth.seed(truth_tables(spark, sf_dir, F.array(F.lit("h")), rows)).select("document_id", "table_index", "source", "confirmed", "correction_count")


@query("""with p as (select p_brand as b, avg(length(p_name)) as m, stddev_pop(length(p_name)) as s, sum(len(regexp_extract_all(p_name, '[0-9]'))) / sum(length(p_name)) as d from part group by all)
  select p_partkey as k, abs(length(v) - m) <= 2 * greatest(s, 1.0) and abs(len(regexp_extract_all(v, '[0-9]')) / greatest(length(v), 1) - d) <= 0.5 as fits from (select *, case p_partkey % 3 when 0 then p_name when 1 then cast(p_partkey as varchar) else p_name || p_name end as v from part) join p on b = p_brand""", None)
def tbl_42_fits(spark, sf_dir):
    p = bridge.load(spark, sf_dir, "part").withColumn("value", F.col("p_name"))
    profile = quality.column_profile(p, ["p_brand"])
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_partkey").cast("string")).otherwise(F.concat("p_name", "p_name"))
    own = p.select("p_partkey", "p_brand", v.alias("v")).join(F.broadcast(profile.withColumn("profile", F.struct("mean_length", "std_length", "digits"))), "p_brand")
    return own.select(F.col("p_partkey").alias("k"), quality.fits_column(F.col("v"), F.col("profile")).alias("fits"))


# --- writes -------------------------------------------------------------------------------------------------------------


@query(f"select document_id, tool_name, table_index, case when cost_usd <> 0 then cast(round(cost_usd, 6) as varchar) else '' end as cost_usd from {SCORED} where document_id = (select min(document_id) from {SCORED})", "tables")
def snk_03_one_document(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return scored_export(rows, rows.agg(F.min("document_id")).first()[0]).select("document_id", "tool_name", "table_index", "cost_usd")


TEXTS = "select p_partkey as k, p_name as name, case p_partkey % 3 when 0 then 'a \"quoted\", text' when 1 then null else p_brand || chr(10) || 'x' end as note from part"


def texts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 3
    return bridge.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.when(k == 0, 'a "quoted", text').when(k == 2, F.concat("p_brand", F.lit("\nx"))).alias("note"))


@query(f"select k, name, note, 'csv' as how from ({TEXTS}) union all select k, name, note, 'json' from ({TEXTS})", None)
def snk_04_06_round_trip(spark, sf_dir):
    """Written as CSV and as JSON lines, and read back."""
    t, at = texts(spark, sf_dir), folder(spark)
    sinks.csv(t, f"{at}/csv")
    sinks.json_lines(t, f"{at}/json")
    back = spark.read.schema(t.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{at}/csv")
    return back.withColumn("how", F.lit("csv")).unionByName(spark.read.schema(t.schema).json(f"{at}/json").withColumn("how", F.lit("json")))


@query("""select p_partkey as k, 'h,"x, y"' || chr(10) || p_name || ',"' || p_size || '""' || chr(10) || '"' || case when p_partkey % 3 = 0 then chr(10) || 'z,' else '' end as said from part""", None)
def snk_05_csv_text(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    rows = F.concat(F.array(F.array(F.col("p_name"), F.concat(n, F.lit('"\n')))), F.when(k % 3 == 0, F.array(F.array(F.lit("z"), F.lit(None).cast("string")))).otherwise(tb.no_rows()))
    return bridge.load(spark, sf_dir, "part").select(k.alias("k"), sinks.as_csv_text(F.array(F.lit("h"), F.lit("x, y")), rows).alias("said"))


@query("""select o_orderkey as document_id, i as table_index, case when i = 0 then o_orderkey % 100 else 0 end as ms, case when i = 0 then 0.5 else 0.0 end as cost, case when o_orderkey % 4 = 0 then 0 else 1 end as n_rows, case when o_orderkey % 4 = 0 then 'empty_output' end as reason from (select *, unnest(range(0, greatest(o_orderkey % 4, 1))) as i from orders)""", None)
def snk_08_run_rows(spark, sf_dir):
    k = F.col("k")
    one = F.struct(F.array(F.lit("h")).alias("headers"), F.array(F.array(k.cast("string"))).alias("rows"))
    runs = orders(spark, sf_dir).select(k.alias("document_id"), F.lit("gpt5").alias("tool_name"), (k % 100).alias("processing_time_ms"), F.lit(0.5).alias("cost_usd"), F.array_repeat(one, (k % 4).cast("int")).alias("tables"), F.when(k % 4 == 0, "empty_output").alias("failure_reason"), F.lit(False).alias("is_transient_failure"))
    rows = sinks.run_rows(runs)
    # Half of the runs are there; all come, and come again.
    t = store.Table(spark, folder(spark), buckets=16).create(rows.where("document_id % 8 < 4"))
    for _ in range(2):
        t.append(rows, ["document_id", "tool_name", "table_index"])
    return t.read().select("document_id", "table_index", F.col("processing_time_ms").alias("ms"), F.col("cost_usd").alias("cost"), F.size("rows").alias("n_rows"), F.col("failure_reason").alias("reason"))


@query("select document_id, table_index from fx_gt where not (document_id % 3 = 0 and table_index = 1)", "tables")
def snk_14_delete(spark, sf_dir):
    rows, keys = bridge.ground_truth(spark, sf_dir).select("document_id", "table_index"), ["document_id", "table_index"]
    t = store.Table(spark, folder(spark), buckets=16).create(rows)
    t.delete(rows.where("document_id % 3 = 0 and table_index = 1"), keys)
    return t.read()


# --- files and tools ----------------------------------------------------------------------------------------------------


@query("""select s_suppkey as k, length(s_name) + length(s_nationkey::varchar) + 1 as length, '.pdf' as ending, s_name || ' ' || s_nationkey as said from supplier where s_suppkey % 3 > 0""", None)
def src_06_files(spark, sf_dir):
    """A file for each supplier, written by the tasks, of which the PDF ones are read."""
    at, k = folder(spark), F.col("s_suppkey")
    sinks.files(bridge.load(spark, sf_dir, "supplier"), F.concat(k.cast("string"), F.when(k % 3 > 0, ".pdf").otherwise(".txt")), F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string")), at)
    got = payloads.pdf_files(spark, at)
    return got.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("k"), F.col("length").cast("long").alias("length"), F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ending"), F.col("content").cast("string").alias("said"))


@query("""select o_orderkey as k, t as tool_name, case when t = 'docling' and o_orderkey % 5 = 0 then null else '{"tables":[{"headers":["h"],"rows":[["' || o_orderkey || '"]]}]}' end as raw_output, case when t = 'docling' and o_orderkey % 5 = 0 then 'ValueError' end as kind, case when t = 'docling' and o_orderkey % 5 = 0 then 'bad 0' end as error from orders, (select unnest(['pymupdf', 'docling']) as t)""", None)
def src_10_udf_01_04_05_tools(spark, sf_dir):
    """Two registered tools over all files; an error is a row."""

    def fine(content: bytes) -> str:
        return json.dumps({"tables": [{"headers": ["h"], "rows": [[content.decode()]]}]}, separators=(",", ":"))

    def fussy(content: bytes) -> str:
        if int(content) % 5 == 0:
            raise ValueError(f"bad {int(content) % 5}")
        return fine(content)

    held = dict(choice.CONNECTORS)
    try:
        choice.CONNECTORS.clear()
        choice.register("pymupdf", fine)
        choice.register("docling", fussy)
        files = orders(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.col("k").cast("string").cast("binary").alias("content"))
        got = choice.run_all(files)
    finally:
        choice.CONNECTORS.clear()
        choice.CONNECTORS.update(held)
    return got.select(F.col("path").cast("long").alias("k"), "tool_name", "raw_output", "kind", "error")


@query("""select p_partkey as k, round(list_max(list_transform(string_split(p_type, ' '), lambda y: 1 - abs(length(y) - length(string_split(p_name, ' ')[1])) / 20)), 6) as best, 0.35 as least from part""", None)
def udf_02_03_pairs(spark, sf_dir):
    """A likeness given as a function of columns, and a threshold from the session."""
    near = lambda x, y: 1 - F.abs(F.length(y) - F.length(x)) / 20
    best = choice.best_pairs(F.split("p_name", " "), F.split("p_type", " "), near)
    return bridge.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), r6(F.get(best, 0)).alias("best"), F.lit(choice.setting(spark, "least", 0.35)).alias("least"))


# --- streams ------------------------------------------------------------------------------------------------------------


def source(spark, sf_dir):
    return spark.readStream.schema(bridge.load(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query("select event_id, user_id, event_type from events where user_id = (select min(user_id) from events)", None)
def stm_01_fan_out(spark, sf_dir):
    """One job's events, as a listener receives them."""
    at = folder(spark)
    job = bridge.load(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    progress.fan_out(source(spark, sf_dir), lambda df, k: df.select("event_id", "user_id", "event_type").write.mode("overwrite").parquet(f"{at}/data/batch={k}"), f"{at}/state", job).awaitTermination()
    return spark.read.parquet(f"{at}/data").drop("batch")


STAGE_OF = {"view": "document_processing", "signup": "metadata_extraction", "click": "table_detection", "purchase": "financial_processing"}


@query(f"""with s as (select user_id, max(case event_type {' '.join(f"when '{e}' then {list(progress.STAGES).index(s) + 1}" for e, s in STAGE_OF.items())} else 0 end) as stage, count(*) as n from events group by all)
  select user_id, n, 100 * stage // 6 as percent, case stage {' '.join(f"when {k} then 'Processing {v}...'" for k, v in enumerate(progress.STAGES.values(), 1))} else '' end as message from s""", None)
def stm_02_percent(spark, sf_dir):
    at = folder(spark)
    e = F.col("event_type")
    stage = F.lit(None).cast("string")
    for name, s in STAGE_OF.items():
        stage = F.when(e == name, s).otherwise(stage)
    got = progress.percent(source(spark, sf_dir), stage)
    got.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/data")).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{at}/data")


@query("select user_id, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) as seconds, date_diff('microsecond', min(ts), max(ts)) / 1e6 > 86400 as timed_out from events group by all", None)
def stream_elapsed(spark, sf_dir):
    at = folder(spark)
    got = progress.elapsed(source(spark, sf_dir), 86_400)
    got.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/data")).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{at}/data").select("user_id", F.round("seconds", 3).alias("seconds"), "timed_out")


HOURS = 30


@query(f"""with j as (select user_id, min(ts) as started, max(ts) as newest from events group by all),
  e as (select distinct user_id from events join j using (user_id) where event_type = 'purchase' and date_trunc('millisecond', ts) <= date_trunc('millisecond', started) + interval {HOURS} hour)
  select user_id as job, date_trunc('millisecond', started) as started, date_trunc('millisecond', started) + interval {HOURS} hour as deadline from j anti join e using (user_id) where started + interval {HOURS} hour <= (select max(ts) from events) - interval 2 hour""", None)
def stm_03_timeouts(spark, sf_dir):
    """Jobs without a purchase in so many hours after their first event, as their timers report them."""
    at = folder(spark)
    got = progress.timeouts(source(spark, sf_dir), HOURS * 3600, F.col("event_type") == "purchase")
    name, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got.writeStream.format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, held)
    back = spark.read.schema(got.schema).parquet(f"{at}/data")
    return back.select("job", F.col("started").cast("timestamp_ntz").alias("started"), F.col("deadline").cast("timestamp_ntz").alias("deadline"))


@query("""with l as (select distinct user_id as job, k from events, (select unnest([0, 1, 2]) as k) where user_id % 3 = 0 or k = 0), n as (select user_id as job, count(*) as n from events group by all)
  select 'listener-' || job || '-' || k as listener, job, case when k = 1 then 0 else n end as n, k = 1 as dead, k <> 1 as stays from l join n using (job)""", None)
def stm_01_listeners(spark, sf_dir):
    """All jobs' events to one listener each, and to three for every third job, of which the second is dead; who got how many, and who is still there."""
    at = folder(spark)
    jobs = bridge.load(spark, sf_dir, "events").select("user_id").distinct()
    k = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    table = store.Table(spark, f"{at}/listeners", "user_id", 16).create(jobs.select("user_id", F.explode(k).alias("k")).select("user_id", F.concat_ws("-", F.lit("listener"), "user_id", "k").alias("listener")))

    def send(listener, batch, piece, rows):
        if listener.endswith("-1"):
            raise ConnectionError("gone")

    progress.deliver(source(spark, sf_dir), table, send, f"{at}/sent", f"{at}/state").awaitTermination()
    sent = spark.read.parquet(f"{at}/sent").groupBy("listener", "job").agg(F.sum("n").alias("n"), F.max("dead").alias("dead"))
    return sent.join(table.read().select("listener", F.lit(True).alias("stays")), "listener", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
