"""Queries of the row, text, date, box, truth and stream operators over the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.functions import dates, text
from gridgauge.functions import tables as tb
from gridgauge.operators import boxes, policy, quality, sequences, store, truth
from gridgauge.plans.figures import r6
from gridgauge.plans.registry import folder, query
from gridgauge.shared import written
from gridgauge.sources import bridge, payloads
from gridgauge.streaming import progress


def lines(spark, sf_dir) -> DataFrame:
    """Order lines numbered without ties."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return bridge.dealt(bridge.load(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("rn", F.row_number().over(w))


LINES = "ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem)"
key = lambda c="l_orderkey": F.col(c)
text_of = lambda c: F.col(c).cast("string")


@query("""select p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower('  $' || (p_partkey % 9 + 1) || ',' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') || '.50   ' || p_name || ' '), '[$€£¥₹]', '', 'g'), '\\s+', ' ', 'g')), '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g') as cell from part""", None)
def str_01_cell(spark, sf_dir):
    raw = F.concat(F.lit("  $"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".50   "), F.col("p_name"), F.lit(" "))
    return bridge.load(spark, sf_dir, "part").select("p_partkey", text.cell(raw).alias("cell"))


def _ocr_sql(c: str, rules) -> str:
    for p, to in rules:
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return c


OCR_TEXT = "'MN' || replace(cast(p_partkey as varchar), '0', 'O') || ' $' || replace(cast(p_size as varchar), '0', 'O') || '.OO 2O2' || p_size % 10 || ' 1O9.O1 O5 5O.O%'"


@query(f"select p_partkey, {_ocr_sql(OCR_TEXT, text.OCR_RULES)} as fixed from part", None)
def str_04_ocr(spark, sf_dir):
    zero = lambda c: F.replace(text_of(c), F.lit("0"), F.lit("O"))
    raw = F.concat(F.lit("MN"), zero("p_partkey"), F.lit(" $"), zero("p_size"), F.lit(".OO 2O2"), (F.col("p_size") % 10).cast("string"), F.lit(" 1O9.O1 O5 5O.O%"))
    return bridge.load(spark, sf_dir, "part").select("p_partkey", text.fix_ocr(raw).alias("fixed"))


@query("select p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' one. two' as cleaned from part", None)
def str_06_clean(spark, sf_dir):
    raw = F.concat(F.lit(" __"), F.col("p_name"), F.lit("___one... \t two  "))
    return bridge.load(spark, sf_dir, "part").select("p_partkey", text.clean(raw).alias("cleaned"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'Acme&co' when 1 then 'Unknown' when 2 then 'Clerk7' else 'Ab' end as carrier from orders", None)
def str_03_carrier(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "statement_acme&co-2024.pdf").when(k == 1, "2024 final/statement_01.copy").when(k == 2, "a clerk7 report.docx").otherwise("Monthly-ab_x.PDF")
    return bridge.load(spark, sf_dir, "orders").select("o_orderkey", text.carrier(name).alias("carrier"))


FILE_OF_PART = "case p_size % 3 when 0 then 'statement_2024-' || p_name || '.pdf' when 1 then p_brand || ' final/' || p_name || '.copy' else 'scan ' || p_size || '_' || p_type || '.PDF' end"


@query(f"""with f as (select p_partkey, {FILE_OF_PART} as file from part),
  w as (select p_partkey, file, list_filter(list_transform(regexp_split_to_array(regexp_replace(file, '\\.[^/.]+$', ''), '[\\s_/-]+'), lambda x: regexp_replace(x, '[^a-zA-Z0-9&]', '', 'g')),
    lambda x: length(x) >= 2 and not regexp_matches(x, '^[0-9]') and lower(x) not in ({", ".join(f"'{x}'" for x in text.NO_CARRIER)})) as words from f)
  select p_partkey, file, case when len(words) = 0 then 'Unknown' else upper(words[1][1]) || words[1][2:] end as carrier from w""", None)
def str_03_carrier_of_files(spark, sf_dir):
    """File names made of each part's name, brand or type."""
    k = F.col("p_size") % 3
    file = F.when(k == 0, F.concat(F.lit("statement_2024-"), "p_name", F.lit(".pdf"))).when(k == 1, F.concat("p_brand", F.lit(" final/"), "p_name", F.lit(".copy"))).otherwise(F.concat(F.lit("scan "), F.col("p_size").cast("string"), F.lit("_"), "p_type", F.lit(".PDF")))
    return bridge.load(spark, sf_dir, "part").select("p_partkey", file.alias("file")).withColumn("carrier", text.carrier(F.col("file")))


@query("""select a.p_partkey, round(len(list_intersect(list_distinct(string_split(a.p_name, ' ')), list_distinct(string_split(a.p_type, ' ')))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(a.p_type, ' ')))), 6) as jaccard,
  array_to_string(list_sort(list_distinct(string_split(a.p_type, ' '))), ' ') as words from part a""", None)
def set_05_07_jaccard(spark, sf_dir):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return bridge.load(spark, sf_dir, "part").select("p_partkey", r6(text.jaccard(a, b)).alias("jaccard"), F.array_join(F.array_sort(F.array_distinct(b)), " ").alias("words"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m') as month from orders""", None)
def dat_01_03_06_statement_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    said = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" thru 2030-01-01"))).when(k == 1, F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" - 04/14/2035"))).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.concat(F.lit("Statement of "), F.date_format(d, "d MMM yyyy"))).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return bridge.load(spark, sf_dir, "orders").select("o_orderkey", dates.statement_date(said).alias("iso")).withColumn("month", dates.month(F.col("iso")))


@query("select o_orderkey, 2 as n, strftime(o_orderdate, '%m/%d/%Y') || ',' || strftime(o_orderdate, '%Y-%m-%d') as sorted from orders", None)
def dat_02_07_find_dates(spark, sf_dir):
    line = F.concat(F.lit("Run "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" for "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; again "), F.date_format("o_orderdate", "MM/dd/yyyy"))
    found = dates.find(line)
    return bridge.load(spark, sf_dir, "orders").select("o_orderkey", F.size(F.filter(found, dates.looks_like_date)).alias("n"), F.array_join(F.array_sort(found), ",").alias("sorted"))


@query("""select l_orderkey, rn, case (rn - 1) % 5 when 0 then '-$' || q || '.50' when 1 then '-$1' || q || '.00' when 2 then '-$' || q when 3 then '$' || q || '.25' else 'n' || q end as v, (rn - 1) % 5 <> 4 and (rn - 1) % 5 = 3 as is_number
  from (select *, cast(cast(l_quantity as int) as varchar) as q from ln)""".join([f"with {LINES} ", ""]), None)
def mth_14_15_17_brackets(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int").cast("string"), (F.col("rn") - 1) % 5
    raw = F.when(k == 0, F.concat(F.lit(" ($"), q, F.lit(".50)"))).when(k == 1, F.concat(F.lit("($-1"), q, F.lit(".00$)"))).when(k == 2, F.concat(F.lit("("), q, F.lit(")"))).when(k == 3, F.concat(F.lit("$"), q, F.lit(".25"))).otherwise(F.concat(F.lit("n"), q))
    return lines(spark, sf_dir).select("l_orderkey", "rn", tb.brackets(raw).alias("v"), tb.numeric(raw).alias("is_number"))


@query(f"with {LINES} select l_orderkey, rn, coalesce(last_value(case when l_partkey % 3 = 0 then l_returnflag || l_linestatus end ignore nulls) over (partition by l_orderkey order by rn rows between unbounded preceding and current row), '') as company from ln", None)
def win_05_carry_forward(spark, sf_dir):
    found = F.when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", "l_linestatus"))
    return sequences.carry_forward(lines(spark, sf_dir), ["l_orderkey"], "rn", found).select("l_orderkey", "rn", "company")


@query(f"with {LINES}, c as (select l_orderkey, rn, coalesce(last_value(case when l_partkey % 3 = 0 then l_returnflag || l_linestatus end ignore nulls) over (partition by l_orderkey order by rn rows between unbounded preceding and current row), '') as company from ln) select l_orderkey, company, string_agg(cast(rn as varchar), ',' order by rn) as rows from c where company <> '' group by all", None)
def win_07_company_rows(spark, sf_dir):
    got = sequences.company_rows(sequences.carry_forward(lines(spark, sf_dir), ["l_orderkey"], "rn", F.when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", "l_linestatus"))), ["l_orderkey"], "rn")
    return got.withColumn("rows", F.array_join(F.transform("rows", lambda x: x.cast("string")), ","))


@query(f"with {LINES} select l_orderkey, rn, sum(opens) over (partition by l_orderkey order by l_partkey range between unbounded preceding and current row) as cluster from (select *, case when l_partkey - lag(l_partkey) over (partition by l_orderkey order by l_partkey) >= 100 then 1 else 0 end as opens from ln)", None)
def win_12_gap_clusters(spark, sf_dir):
    return sequences.clusters_by_gap(lines(spark, sf_dir), ["l_orderkey"], "l_partkey", 100).select("l_orderkey", "rn", "cluster")


@query(f"""with {LINES}, s as (select *, l_partkey - lag(l_partkey) over (partition by l_orderkey order by l_partkey) as step from ln), m as (select l_orderkey, median(step) * 0.5 as lim from s where step > 0 group by all)
  select l_orderkey, rn, sum(case when step >= greatest(coalesce(lim, 5.0), 5.0) then 1 else 0 end) over (partition by l_orderkey order by l_partkey range between unbounded preceding and current row) as cluster from s left join m using (l_orderkey)""", None)
def win_13_median_gap_clusters(spark, sf_dir):
    return sequences.clusters_by_median_gap(lines(spark, sf_dir), ["l_orderkey"], "l_partkey").select("l_orderkey", "rn", "cluster")


@query(f"""with recursive {LINES}, s as (select l_orderkey, rn, l_quantity as q, row_number() over (partition by l_orderkey order by l_quantity, rn) as i from ln),
  r as (select *, cast(q as double) as total, 1 as n, 0 as cluster from s where i = 1 union all select s.*, case when abs(s.q - total / n) <= 5 then total + s.q else s.q end, case when abs(s.q - total / n) <= 5 then n + 1 else 1 end, case when abs(s.q - total / n) <= 5 then cluster else cluster + 1 end from r join s on s.l_orderkey = r.l_orderkey and s.i = r.i + 1)
  select l_orderkey, rn, q as l_quantity, cluster from r""", None)
def win_11_running_mean_clusters(spark, sf_dir):
    return sequences.clusters_by_running_mean(lines(spark, sf_dir).select("l_orderkey", "rn", "l_quantity"), ["l_orderkey"], "l_quantity", 5.0)


def _leaders_sql(rows: str, least: float) -> str:
    """Rows (g, i, v) with the group that each joins: the first whose head shares ``least`` of their distinct characters."""
    alike = f"list_transform(heads, lambda h: len(list_intersect(h, s.c)) / len(list_distinct(list_concat(h, s.c))) >= {least})"
    return f"""s as (select *, list_distinct(string_split(lower(v), '')) as c from ({rows})),
  r as (select g, i, v, [c] as heads, 1 as leader from s where i = 1 union all
    select g, i, v, case when place > 0 then heads else list_append(heads, c) end, case when place > 0 then place else len(heads) + 1 end from (select s.*, heads, coalesce(list_position({alike}, true), 0) as place from r join s on s.g = r.g and s.i = r.i + 1))"""


@query(f"with recursive {LINES}, {_leaders_sql('select l_orderkey as g, rn as i, l_returnflag || l_linestatus || l_suppkey as v from ln', 0.6)} select g as l_orderkey, i as rn, v, leader - 1 as leader from r", None)
def win_17_26_leaders(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "rn", F.concat("l_returnflag", "l_linestatus", text_of("l_suppkey")).alias("v"))
    return sequences.leaders(rows, ["l_orderkey"], "rn", "v", 0.6)


@query(f"with {LINES} select l_orderkey, rn, string_agg(cast(l_partkey as varchar), chr(10)) over (partition by l_orderkey order by rn rows between 2 preceding and 2 following) as context, coalesce(sum(case when l_partkey % 4 = 0 then 1 else 0 end) over (partition by l_orderkey order by rn rows between unbounded preceding and 1 preceding), 0) as page from ln", None)
def win_20_21_context_pages(spark, sf_dir):
    got = sequences.context(lines(spark, sf_dir).withColumn("line", text_of("l_partkey")), ["l_orderkey"], "rn", "line")
    return sequences.pages(got, ["l_orderkey"], "rn", F.col("l_partkey") % 4 == 0).select("l_orderkey", "rn", "context", "page")


@query(f"with {LINES} select l_orderkey, sum(goes_on) as span from (select l_orderkey, min(case when l_discount > 0.03 then 1 else 0 end) over (partition by l_orderkey order by rn rows between unbounded preceding and current row) as goes_on from ln) group by all", None)
def win_24_span(spark, sf_dir):
    return sequences.span(lines(spark, sf_dir), ["l_orderkey"], "rn", F.col("l_discount"), 0.03)


SUMMARY_TEXT = "case when last_ = rn and l_partkey % 2 = 0 then 'Total for group' when l_partkey % 17 = 0 then 'Subtotal sum' else 'item' || l_partkey end"


@query(f"""with {LINES}, t as (select *, count(*) over (partition by l_orderkey) as n, max(rn) over (partition by l_orderkey) as last_, rn - 1 as pl from ln),
  r as (select *, {SUMMARY_TEXT} as a, case when l_partkey % 5 = 0 or (last_ = rn and l_partkey % 2 = 0) then '' else cast(cast(l_quantity as int) as varchar) end as b, case when last_ = rn and l_partkey % 2 = 0 then '' else cast(l_suppkey as varchar) end as c from t),
  s as (select *, lower(trim(a || ' ' || b || ' ' || c)) as said, ((a <> '')::int + (b <> '')::int + (c <> '')::int) / 3 as full_ from r),
  u as (select *, regexp_matches(said, '[0-9]') as dg, avg(full_) over (partition by l_orderkey) as mf, (contains(said, 'total'))::int + (contains(said, 'sum'))::int + (contains(said, 'subtotal'))::int as weak from s),
  v as (select *, coalesce((abs(full_ - lag(full_) over w) > 0.3 or dg <> lag(dg) over w) and (abs(full_ - lead(full_) over w) > 0.3 or dg <> lead(dg) over w), false) as apart from u window w as (partition by l_orderkey order by rn)),
  x as (select *, case when regexp_matches(said, '^total\\s+for\\s+group:?|^sub\\s*total:?') then 0.95 when weak >= 2 then least(0.7 + weak * 0.1, 0.85) when weak = 1 then 0.4 else 0.1 end as sem, case when contains(said, 'total for group') then 0.9 else 0.1 end as bus,
    case when pl = n - 1 then 0.7 when pl > n * 0.8 then 0.5 when pl > n * 0.6 then 0.3 when pl > 0 and apart then 0.4 else 0.2 end as pos, case when full_ < mf * 0.5 then 0.8 when full_ < mf * 0.7 then 0.6 when full_ < mf * 0.9 then 0.3 else 0.1 end as den from v),
  y as (select *, least(round(0.45 * sem + 0.35 * bus + 0.15 * den + 0.05 * pos, 9), 1.0) as conf from x),
  z as (select *, conf > 0.75 and (sem > 0.8)::int + (bus > 0.7)::int + (den > 0.6)::int + (pos > 0.5)::int >= 2 and n >= 3 as cand from y),
  c as (select *, cand and row_number() over (partition by l_orderkey order by cand desc, conf desc, rn) <= greatest(1, floor(n * 0.35)) as chosen from z),
  d as (select *, sum(chosen::int) over (partition by l_orderkey) as gone from c)
  select l_orderkey, rn, round(conf, 6) as confidence, chosen and gone <= n * 0.35 and n - gone >= 3 as removed from d""", None)
def win_08_09_10_mth_16_tbl_28_summary_rows(spark, sf_dir):
    last = F.max("rn").over(Window.partitionBy("l_orderkey")) == F.col("rn")
    total = last & (F.col("l_partkey") % 2 == 0)
    cells = F.array(F.when(total, "Total for group").when(F.col("l_partkey") % 17 == 0, "Subtotal sum").otherwise(F.concat(F.lit("item"), text_of("l_partkey"))), F.when((F.col("l_partkey") % 5 == 0) | total, "").otherwise(F.col("l_quantity").cast("int").cast("string")), F.when(total, "").otherwise(text_of("l_suppkey")))
    rows = lines(spark, sf_dir).withColumn("cells", cells).select("l_orderkey", "rn", "cells")
    return sequences.drop_summary_rows(rows, ["l_orderkey"], "rn", "cells").select("l_orderkey", "rn", r6(F.col("confidence")).alias("confidence"), "removed")


@query("""select document_id, tool_name, table_index, case when failure_reason in ('tool_limitation', 'empty_output') then 0.0 else 1.0 end as zero_rule, failure_reason is not null and is_transient_failure as transient,
  case when is_transient_failure then 'transient_failure' when is_draft then 'draft' when coalesce(n, 0) = 0 then 'no_ground_truth' end as guard,
  case when table_index % 4 = 0 then 'rate_limit' when table_index % 4 = 1 then 'timeout' when table_index % 4 = 2 then 'server_down' else 'api_error' end as of_text
  from fx_extraction left join (select document_id, count(*) as n from fx_gt where confirmed group by all) using (document_id)""", "tables")
def pol_05_09_10_guards(spark, sf_dir):
    k = F.col("table_index") % 4
    error = F.when(k == 0, "HTTP 429 from service").when(k == 1, "Timeout after 30 s").when(k == 2, "Connection refused").otherwise("bad request")
    n = bridge.ground_truth(spark, sf_dir).where("confirmed").groupBy("document_id").agg(F.count("*").alias("n"))
    rows = bridge.extractions(spark, sf_dir).join(n, "document_id", "left")
    zero = F.when(policy.zero_scored(F.col("failure_reason")), 0.0).otherwise(1.0)
    return rows.select("document_id", "tool_name", "table_index", zero.alias("zero_rule"), policy.transient(F.col("failure_reason")).alias("transient"), policy.scoring_guard(F.lit(True), F.col("is_transient_failure"), F.col("is_draft"), F.coalesce("n", F.lit(0))).alias("guard"), policy.failure_of_text(error).alias("of_text"))


@query("""select document_id, tool_name, case when first_ = 'rate_limit' then 'rate_limited' when tr then 'api_error' when has then 'done' when is_digital = false then 'no_tables_scanned' when first_ is null or first_ = 'empty_output' then 'no_tables' else 'failed' end as state, case when tool_name in ('pymupdf', 'docling') and is_digital = false then 'tool_limitation' else 'empty_output' end as of_empty
  from (select document_id, tool_name, arg_min_null(failure_reason, table_index) as first_, bool_or(is_transient_failure) as tr, bool_or(failure_reason is null) as has from fx_extraction group by all) join fx_document using (document_id)""", "tables")
def pol_04_07_states(spark, sf_dir):
    runs = bridge.extractions(spark, sf_dir).groupBy("document_id", "tool_name").agg(F.count("*").alias("n"), F.min_by("failure_reason", "table_index").alias("first"), F.bool_or("is_transient_failure").alias("tr"), F.bool_or(F.col("failure_reason").isNull()).alias("has"))
    d = runs.join(bridge.documents(spark, sf_dir), "document_id")
    return d.select("document_id", "tool_name", policy.extraction_state(F.col("n"), F.col("first"), F.col("tr"), F.col("has"), F.col("is_digital"), F.lit(None).cast("string")).alias("state"), policy.failure_of_empty(F.col("tool_name"), F.col("is_digital")).alias("of_empty")).withColumn("state", F.col("state"))


@query("select document_id, count(*) filter (sc) as ready, bool_and(sc) as all_complete, bool_or(is_draft) as pending from (select *, failure_reason is null and not is_draft as sc from fx_extraction where table_index = 0) group by all", "tables")
def pol_12_ready(spark, sf_dir):
    rows = bridge.extractions(spark, sf_dir).where("table_index = 0").withColumn("sc", F.col("failure_reason").isNull() & ~F.col("is_draft"))
    return rows.groupBy("document_id").agg(F.count_if("sc").alias("ready"), F.bool_and("sc").alias("all_complete"), F.bool_or("is_draft").alias("pending"))


@query("""select o_orderkey as id, o_orderkey % 50 as page, b.band from orders, (select unnest(range(0, 10)) as band) b where o_orderkey % 97 * 7 between b.band * 70 and b.band * 70 + 80 and (o_orderkey % 50) % 2 = b.band % 2""", None)
def jn_14_inside(spark, sf_dir):
    k = F.col("o_orderkey")
    points = bridge.load(spark, sf_dir, "orders").select((k % 50).alias("page"), k.alias("id"), (k % 97 * 7).cast("double").alias("x"), F.lit(5.0).alias("y"))
    areas = spark.range(50).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("band")).where("page % 2 = band % 2")
    areas = areas.select("page", F.col("band").alias("id"), (F.col("band") * 70.0).alias("x0"), (F.col("band") * 70.0 + 80).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    return boxes.inside(points, areas).select(F.col("point").alias("id"), "page", F.col("area").cast("long").alias("band"))


def _boxes(spark, sf_dir, shift: float) -> DataFrame:
    k = F.col("o_orderkey")
    x, y = (k % 83 * 11 + shift * (k % 3)).cast("double"), (k % 71 * 13).cast("double")
    return bridge.load(spark, sf_dir, "orders").select(F.floor(k / 64).alias("page"), k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1"), (k % 7).alias("rows"), (k % 5).alias("cols"))


def _box_sql(name: str, shift: int) -> str:
    return f"{name} as (select o_orderkey // 64 as page, o_orderkey as id, cast(o_orderkey % 83 * 11 + {shift} * (o_orderkey % 3) as double) as x0, cast(o_orderkey % 71 * 13 as double) as y0, o_orderkey % 7 as rows, o_orderkey % 5 as cols from orders)"


#: Pairs of a page from the most alike down, one step a pair; ``used`` holds the boxes that are taken.
MATCH = f"""with recursive {_box_sql("p", 0)}, {_box_sql("t", 4)},
  o as (select p.page, p.id as pred, t.id as true_, greatest(least(p.x0, t.x0) + 40 - greatest(p.x0, t.x0), 0.0) * greatest(least(p.y0, t.y0) + 30 - greatest(p.y0, t.y0), 0.0) as s from p join t using (page)),
  i as (select page, pred, true_, s / (1200.0 + 1200.0 - s) as iou from o where s / (1200.0 + 1200.0 - s) >= 0.5), n as (select *, row_number() over (partition by page order by iou desc, pred, true_) as k from i),
  g as (select page, pred, true_, iou, k, true as kept, [pred] as used_p, [true_] as used_t from n where k = 1
    union all select n.page, n.pred, n.true_, n.iou, n.k, not list_contains(used_p, n.pred) and not list_contains(used_t, n.true_), case when not list_contains(used_p, n.pred) and not list_contains(used_t, n.true_) then list_append(used_p, n.pred) else used_p end,
      case when not list_contains(used_p, n.pred) and not list_contains(used_t, n.true_) then list_append(used_t, n.true_) else used_t end from g join n on n.page = g.page and n.k = g.k + 1),
  m as (select page, pred, true_, iou from g where kept)"""


@query(f'{MATCH} select page, pred, true_ as "true", round(iou, 6) as iou from m', None)
def jn_12_mth_10_box_match(spark, sf_dir):
    return boxes.match(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 4)).withColumn("iou", r6(F.col("iou")))


@query(f"""{MATCH}, c as (select (select count(*) from p) as np, (select count(*) from t) as nt, (select count(*) from m) as tp) select 'detection' as kind, cast(tp as double) as a, cast(np - tp as double) as b, cast(nt - tp as double) as c, round(tp / np, 6) as d, round(tp / nt, 6) as e, round(2 * tp / (np + nt), 6) as f, (select round(avg(iou), 6) from m) as g from c
  union all select 'structure', round(avg((p.rows = t.rows)::int), 6), round(avg((p.cols = t.cols)::int), 6), round(avg((p.rows = t.rows and p.cols = t.cols)::int), 6), null, null, null, null from m join p on p.id = pred join t on t.id = true_""", None)
def agg_33_34_detection(spark, sf_dir):
    """One line of counts, precision, recall, F1 and mean IoU; one of equal rows, columns and both."""
    p, t = _boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 4)
    m = boxes.match(p, t)
    none = F.lit(None).cast("double")
    line = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[r6(x.cast("double")).alias(n) for n, x in zip("abcdefg", (*c, *[none] * (7 - len(c))))])
    return line(boxes.detection(p, t, m), "detection", *map(F.col, ("tp", "fp", "fn", "precision", "recall", "f1", "mean_iou"))).unionByName(line(boxes.structure(m, p, t), "structure", *map(F.col, ("rows", "cols", "structure"))))


@query(f"""with recursive {_box_sql("p", 4)}, n as (select *, row_number() over (partition by page order by id) as k from p),
  g as (select page, id, x0, y0, k, true as kept, [struct_pack(x := x0, y := y0)] as held from n where k = 1
    union all select page, id, x0, y0, k, free, case when free then list_append(held, struct_pack(x := x0, y := y0)) else held end
    from (select n.page, n.id, n.x0, n.y0, n.k, held, len(list_filter(held, lambda b: greatest(least(b.x, n.x0) + 40 - greatest(b.x, n.x0), 0.0) * greatest(least(b.y, n.y0) + 30 - greatest(b.y, n.y0), 0.0) / 1200.0 > 0.5)) = 0 as free from g join n on n.page = g.page and n.k = g.k + 1))
  select page, id, x0, y0, x0 + 40 as x1, y0 + 30 as y1 from g where kept""", None)
def srt_10_suppress(spark, sf_dir):
    return boxes.suppress(_boxes(spark, sf_dir, 4).drop("rows", "cols"))


@query("select o_orderkey, arg_max(band, (share, -band)) as row from (select o_orderkey, b.band, greatest(least(lo + 30, b.band * 25 + 25 + step) - greatest(lo, b.band * 25 + step), 0) / 30 as share from (select o_orderkey, o_orderkey // 64 % 5 as step, o_orderkey % 71 * 3 as lo from orders), (select unnest(range(0, 10)) as band) b) group by all", None)
def jn_16_17_bands(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = bridge.load(spark, sf_dir, "orders").select("o_orderkey", F.floor(k / 64).alias("page"), (k % 71 * 3).cast("double").alias("y0"), (k % 71 * 3 + 30).cast("double").alias("y1"))
    # Each page has bands of its own.
    low = F.col("band") * 25.0 + F.col("page") % 5
    bands = cells.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("band")).select("page", "band", low.alias("low"), (low + 25).alias("high"))
    return boxes.best_band(cells, bands, "page", "y0", "y1", "row").select("o_orderkey", F.col("row").cast("long").alias("row"))


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as \"min\", round(max(value), 6) as \"max\", round(sum(value), 3) as total, round(count(*) / sum(value), 6) as mb_s from events group by all", None)
def agg_35_36_speed(spark, sf_dir):
    got = quality.speed(bridge.load(spark, sf_dir, "events").withColumn("mb", F.lit(1)), ["event_type"], "value", "mb")
    return got.select("event_type", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")], F.round("total", 3).alias("total"), r6(F.col("mb_s")).alias("mb_s"))


@query("""select o_orderpriority, round(avg(case when o_orderstatus = 'F' then 1.0 else 0 end), 6) as success_rate, round(avg(q), 6) as mean_quality, round(avg(nullif(s, 0)), 6) as mean_seconds, count(*) filter (q >= 0.9) as excellent, count(*) filter (q >= 0.8 and q < 0.9) as good, count(*) filter (q >= 0.7 and q < 0.8) as acceptable, count(*) filter (q >= 0.6 and q < 0.7) as poor, count(*) filter (q < 0.6) as failed
  from (select *, (o_orderkey % 100) / 100.0 as q, o_orderkey % 7 as s from orders) group by all""", None)
def agg_37_benchmark(spark, sf_dir):
    k = F.col("o_orderkey")
    got = quality.benchmark(bridge.load(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("ok"), (k % 100 / 100.0).alias("quality"), (k % 7).alias("seconds")), ["o_orderpriority"])
    return got.select("o_orderpriority", *[r6(F.col(c)).alias(c) for c in ("success_rate", "mean_quality", "mean_seconds")], "excellent", "good", "acceptable", "poor", "failed")


@query("select p_brand, count(*) as n, round(avg(length(p_name)), 6) as mean_length, round(stddev_pop(length(p_name)), 6) as std_length, min(length(p_name)) as min_length, max(length(p_name)) as max_length, round(avg(len(regexp_split_to_array(trim(p_name), '\\s+'))), 6) as mean_words from part where trim(p_name) <> '' group by all", None)
def agg_53_column_profile(spark, sf_dir):
    got = quality.column_profile(bridge.load(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("value")), ["p_brand"])
    return got.select("p_brand", "n", r6(F.col("mean_length")).alias("mean_length"), r6(F.col("std_length")).alias("std_length"), "min_length", "max_length", r6(F.col("mean_words")).alias("mean_words"))


@query("select p_brand, round(avg(case when trim(v) = '' then 1.0 else 0 end), 6) as empty_share, count(*) filter (regexp_matches(v, '^[0-9.]+$')) as numbers, count(*) filter (v like '$%') as amounts, round(avg(length(v)), 6) as mean_length from (select p_brand, case when p_size % 3 = 0 then '' when p_size % 3 = 1 then '$' || p_size else cast(p_size as varchar) end as v from part) group by all", None)
def agg_49_cell_profile(spark, sf_dir):
    s = F.col("p_size")
    v = F.when(s % 3 == 0, "").when(s % 3 == 1, F.concat(F.lit("$"), s.cast("string"))).otherwise(s.cast("string"))
    got = quality.cell_profile(bridge.load(spark, sf_dir, "part").select("p_brand", v.alias("value")), ["p_brand"])
    return got.select("p_brand", r6(F.col("empty_share")).alias("empty_share"), "numbers", "amounts", r6(F.col("mean_length")).alias("mean_length"))


@query("select l_orderkey, round(sum(l_extendedprice), 2) as total, count(*) as n, round(avg(l_extendedprice), 6) as mean from lineitem where l_extendedprice > 0 group by all", None)
def agg_50_commission_summary(spark, sf_dir):
    v = F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2))
    got = quality.commission_summary(bridge.load(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("value")), ["l_orderkey"])
    return got.select("l_orderkey", F.round("total", 2).alias("total"), "n", r6(F.col("mean")).alias("mean"))


@query("select doc_id as document_id, cast(len(p) as int) as page_count, len(list_filter(p, lambda x: length(trim(x)) > 50)) > 0.5 * len(p) as is_digital from (select doc_id, string_split(text, chr(10)) as p from documents)", None)
def src_07_profile_pages(spark, sf_dir):
    pages = bridge.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("text"))
    return payloads.profile_pages(pages)


@query("select o_orderkey, cast(0 as int) as table_index, cast(o_orderkey % 5 as int) as page_number, 'a,b' as headers, 'x,' || o_orderkey || ';true,1.0' as rows from orders", None)
def tbl_01_src_19_payloads(spark, sf_dir):
    """Payloads of both shapes and names, parsed back."""
    k = F.col("o_orderkey")
    table = lambda h, r: F.concat(F.lit(f'{{"{h}":["a","b"],"{r}":[["x",'), k.cast("string"), F.lit('],[true,1.0]],"page_number":'), (k % 5).cast("string"), F.lit("}"))
    raw = F.when(k % 2 == 0, F.concat(F.lit('{"usage":{"input_tokens":5},"tables":['), table("headers", "rows"), F.lit("]}"))).otherwise(F.concat(F.lit("["), table("header", "data"), F.lit("]")))
    got = payloads.normalise(bridge.load(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw_output")))
    return got.select("o_orderkey", "table_index", "page_number", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


def _truth(spark, sf_dir) -> DataFrame:
    got = lines(spark, sf_dir)
    row = F.array(text_of("l_partkey"), text_of("l_suppkey"))
    return got.select(F.col("l_orderkey").alias("document_id"), (F.col("rn") - 1).alias("table_index"), F.array(F.lit("part"), F.lit("supplier")).alias("headers"), F.array(row).alias("rows"), F.lit(None).cast("string").alias("notes"), F.lit("manual").alias("source"), F.lit(True).alias("confirmed"), F.lit(0).alias("correction_count"), F.array().cast(truth.LOG).alias("log"))


def _orders(spark, sf_dir) -> DataFrame:
    return bridge.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("primary"), F.lit(1).alias("secondary"), F.lit(0).alias("survivor"))


@query(f"""with {LINES} select l_orderkey as document_id, case when rn <= 2 then 0 else rn - 2 end as table_index, string_agg(l_partkey || ',' || l_suppkey, ';' order by rn) as rows, case when rn <= 2 and max(n) > 1 then 1 else 0 end as correction_count
  from (select *, count(*) over (partition by l_orderkey) as n from ln) group by l_orderkey, case when rn <= 2 then 0 else rn - 2 end, rn <= 2""", None)
def tbl_03_04_win_19_truth_merge(spark, sf_dir):
    got = truth.merge_tables(_truth(spark, sf_dir), _orders(spark, sf_dir))
    return got.select("document_id", F.col("table_index").cast("long").alias("table_index"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), "correction_count")


@query(f"with {LINES} select l_orderkey as document_id, rn - 1 as table_index, l_partkey || ',' || l_suppkey as rows, 0 as correction_count from ln", None)
def tbl_05_06_truth_undo(spark, sf_dir):
    """Undoing a merge gives back what was there."""
    merged = truth.merge_tables(_truth(spark, sf_dir), _orders(spark, sf_dir))
    got = truth.undo_merge(merged, _orders(spark, sf_dir))
    return got.select("document_id", F.col("table_index").cast("long").alias("table_index"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), "correction_count")


@query(f"with {LINES} select l_orderkey as document_id, rn - 1 as table_index, 0 as row, 0 as col, cast(l_partkey as varchar) as original, l_partkey || '!' as corrected from ln where l_partkey % 9 = 0", None)
def jn_09_10_diff(spark, sf_dir):
    before = _truth(spark, sf_dir)
    after = before.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda x, j: F.when((j == 0) & (x.cast("int") % 9 == 0), F.concat(x, F.lit("!"))).otherwise(x))))
    return truth.diff(before, after).withColumn("table_index", F.col("table_index").cast("long"))


@query("select (select count(*) from fx_document where document_id % 10 <> 0) as docs, (select count(*) from fx_gt where document_id % 10 <> 0) as truths, (select count(*) from fx_extraction where document_id % 10 <> 0) as runs, (select count(*) from fx_score s join fx_extraction e using (extraction_result_id) where document_id % 10 <> 0) as scores", "tables")
def snk_09_cascade_delete(spark, sf_dir):
    """From four written tables; what is left of each."""
    at = folder(spark)
    frames = {"docs": bridge.documents(spark, sf_dir), "truths": bridge.ground_truth(spark, sf_dir), "runs": bridge.extractions(spark, sf_dir)}
    made = {n: store.Table(spark, f"{at}/{n}", "document_id", 16).create(f) for n, f in frames.items()}
    # The written runs have what scores are made of: their lines aren't numbered again.
    made["scores"] = store.Table(spark, f"{at}/scores", "extraction_result_id", 16).create(bridge.scores(made["runs"].read()))
    store.delete_documents(*made.values(), frames["docs"].where("document_id % 10 = 0"))
    left = [t.read().select(F.lit(n).alias("part")) for n, t in made.items()]
    return left[0].union(left[1]).union(left[2]).union(left[3]).agg(*[F.count_if(F.col("part") == n).alias(n) for n in made])


@query("select document_id, table_index, case when document_id % 3 = 0 and table_index = 0 then 'new' else 'old' end as origin from fx_gt union all select document_id, 9, 'new' from fx_document where document_id % 3 = 0", "tables")
def snk_10_11_12_replace(spark, sf_dir):
    """Rows replaced and added in a written table, twice: the second time changes nothing."""
    keys = ["document_id", "table_index"]
    old = bridge.ground_truth(spark, sf_dir).select(*keys, F.lit("old").alias("origin"))
    first = old.where("document_id % 3 = 0 and table_index = 0").withColumn("origin", F.lit("new"))
    more = bridge.documents(spark, sf_dir).where("document_id % 3 = 0").select("document_id", F.lit(9).alias("table_index"), F.lit("new").alias("origin"))
    t = store.Table(spark, folder(spark), buckets=16).create(old)
    for _ in range(2):
        t.replace(first, keys)
        t.insert_absent(more, keys)
    return t.read()


@query("""select * from (with e as (select * from fx_extraction), g as (select document_id, tool_name, max(case when table_index = 0 then processing_time_ms end) as ms, max(case when table_index = 0 then cost_usd end) as cost from e where document_id % 6 = 0 group by all)
  select document_id, tool_name, table_index, processing_time_ms as ms, round(cost_usd, 6) as cost, 'old' as origin from e where document_id % 6 <> 0
  union all select document_id, tool_name, i, case when i = 0 then ms else 0 end, case when i = 0 then round(cost, 6) else 0.0 end, 'new' from g, (select unnest([0, 1]) as i))""", "tables")
def snk_10_replace_run(spark, sf_dir):
    """Each run of every sixth document gets two tables in a written table; time and cost of the run stay on the first."""
    er = bridge.extractions(spark, sf_dir).select("document_id", "tool_name", "table_index", "processing_time_ms", "cost_usd", F.lit("old").alias("origin"))
    t = store.Table(spark, folder(spark), buckets=16).create(er)
    # Written, as the table itself changes; from it, so that lines aren't numbered again for each use.
    new = t.read().where("document_id % 6 = 0").select("document_id", "tool_name").distinct()
    new = new.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("table_index"), F.lit(7).alias("processing_time_ms"), F.lit(7.0).alias("cost_usd"), F.lit("new").alias("origin"))
    new = written(new)
    t.replace_run(new)
    t.replace_run(new)
    return t.read().select("document_id", "tool_name", "table_index", F.col("processing_time_ms").alias("ms"), r6(F.col("cost_usd")).alias("cost"), "origin")


@query("select document_id, case when document_id % 4 = 0 then 'low' else complexity_tier end as complexity_tier, case when document_id % 8 = 0 then null else is_digital end as is_digital from fx_document", "tables")
def snk_13_15_update(spark, sf_dir):
    docs = bridge.documents(spark, sf_dir).select("document_id", "complexity_tier", "is_digital")
    changes = docs.where("document_id % 4 = 0").select("document_id", F.lit("low").alias("complexity_tier"), F.lit(None).cast("boolean").alias("is_digital"), (F.col("document_id") % 8 == 0).alias("set_is_digital"))
    t = store.Table(spark, folder(spark), buckets=16).create(docs)
    t.update(changes, ["document_id"], ("is_digital",))
    return t.read()


def _stream(spark, sf_dir, build, mode: str) -> DataFrame:
    """What a stream over ``events`` has written once it has read all of it."""
    out = folder(spark)
    static = bridge.load(spark, sf_dir, "events")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    got = build(source)
    if mode == "append":
        q = got.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = got.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{out}/data")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean_value, count(*) filter (value > 0) as ok from events group by all", None)
def stm_04_05_06_running(spark, sf_dir):
    got = _stream(spark, sf_dir, progress.running, "complete")
    return got.select("event_type", "n", r6(F.col("mean_value")).alias("mean_value"), "ok")


@query("select user_id, round(arg_max(value, (ts, event_id)), 6) as value from events group by all", None)
def stream_latest(spark, sf_dir):
    return _stream(spark, sf_dir, progress.latest, "complete").select("user_id", r6(F.col("value")).alias("value"))


@query("""with recursive e as (select user_id, ts, epoch_us(ts) / 1e6 as sec, value - 50 as v, row_number() over (partition by user_id order by ts, value) as i from events),
  r as (select user_id, ts, i, false as open, case when v > 0 then 0 else 1 end as n, cast(0.0 as double) as opened from e where i = 1
    union all select user_id, ts, i, held > 0, n, case when n >= 3 and held = 0 then sec else held end from (select e.user_id, e.ts, e.i, e.sec, case when opened > 0 and e.sec - opened >= 300 then 0.0 else opened end as held,
      case when e.v > 0 then 0 when opened > 0 and e.sec - opened >= 300 then 1 else n + 1 end as n from r join e on e.user_id = r.user_id and e.i = r.i + 1))
  select user_id, ts, open from r""", None)
def stm_07_breaker(spark, sf_dir):
    got = _stream(spark, sf_dir, lambda s: progress.breaker(s.withColumn("value", F.col("value") - 50)), "append")
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hour", None)
def stm_10_windows(spark, sf_dir):
    """Windows that the watermark has closed."""
    got = _stream(spark, sf_dir, progress.counts, "append")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))
