"""Queries of scores and choices over documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text
from gridgauge.operators import choice, sequences
from gridgauge.plans.registry import query, slots_of
from gridgauge.plans.results import SCORED, scored
from gridgauge.plans.rows import _leaders_sql
from gridgauge.plans.tables import KEYS, found
from gridgauge.plans.values import COMPLETE, KIND, LIKE_DATA, RAGGED, all_like, count, full
from gridgauge.sources import bridge, markdown


def lines_as_pages(spark, sf_dir):
    return bridge.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text"))


@query(f"select complexity_tier, tool_name, table_index, extraction_result_id from {SCORED}", "tables")
def srt_02_by_tier(spark, sf_dir):
    return choice.by_tier(scored(spark, sf_dir)).select("complexity_tier", "tool_name", "table_index", "extraction_result_id")


@query("select document_id, tool_name, coalesce(cast(failure_reason as varchar), '') as failure_reason from slot")
def srt_05_as_text(spark, sf_dir):
    return choice.as_text(slots_of(spark, sf_dir).select("document_id", "tool_name", F.coalesce("failure_reason", F.lit("")).alias("failure_reason")), "failure_reason")


@query("select document_id, filename from fx_document order by filename, document_id limit 50 offset 100", "tables")
def srt_11_page(spark, sf_dir):
    return choice.page_of(bridge.documents(spark, sf_dir).select("document_id", "filename"), [F.col("filename"), F.col("document_id")], 2, 50)


@query("""with p as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as page, unnest(string_split(text, chr(10))) as t from documents), s as (select *, lower(t) as said, count(*) over (partition by doc_id) as n from p),
  c as (select *, case when page = 0 then 10 when page < n * 0.3 then 5 when page >= n - 1 then -5 else 0 end""" + "".join(f" + case when contains(said, '{w}') then 5 else 0 end" for w in ("commission", "statement", "total", "summary", "premium", "policy", "agent")) + "".join(f" - case when contains(said, '{w}') then 10 else 0 end" for w in ("terms and conditions", "disclaimer", "privacy", "legal notice")) + """
    + case when length(said) > 500 then 3 else 0 end + case when regexp_matches(said, '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}') then 3 else 0 end as score from s)
  select doc_id, page, score, row_number() over (partition by doc_id order by score desc, page) as rank from c where score > 0 or page = 0 and score > -20 qualify rank <= 3""", None)
def srt_07_str_21_content_pages(spark, sf_dir):
    return choice.content_pages(lines_as_pages(spark, sf_dir), "doc_id", 3).select("doc_id", F.col("page").cast("long").alias("page"), "score", F.col("rank").cast("long").alias("rank"))


@query("""with p as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as page, unnest(string_split(text, chr(10))) as t from documents),
  c as (select *, least(len(regexp_extract_all(t, '\\S {3,}\\S')), 10) + case when trim(t) = '' then -8 else 0 end""" + "".join(f" + case when contains(lower(t), '{w}') then {v} else 0 end" for v, ws in choice.KEYWORDS.items() for w in ws) + """ as score from p)
  select doc_id, page, score, row_number() over (partition by doc_id order by score desc, page) as rank from c qualify rank <= 2""", None)
def srt_12_keyword_pages(spark, sf_dir):
    return choice.keyword_pages(lines_as_pages(spark, sf_dir), "doc_id", 2).select("doc_id", F.col("page").cast("long").alias("page"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("select l_orderkey, arg_max('t' || l_partkey, (least(greatest(l_discount * 12, 0), 1), -l_partkey)) as text from lineitem group by all", None)
def srt_15_best_text(spark, sf_dir):
    rows = bridge.load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_discount") * 12).alias("score"), F.col("l_partkey").alias("nth"))
    return choice.best_text(rows, ["l_orderkey"])


@query("select p_partkey, p_size + 0.0 as seconds, round(least(power(2, p_size % 9), 60), 6) as retry, 1 - p_size % 3 as legacy from part", None)
def mth_11_18_legacy(spark, sf_dir):
    k = F.col("p_size") % 3
    pred = F.when(k == 0, "abc").when(k == 1, "abx").otherwise("axx")
    return bridge.load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 0.0).alias("seconds"), F.round(choice.retry_seconds(F.col("p_size") % 9), 6).alias("retry"), choice.teds_by_characters(pred, F.lit("abc")).cast("int").alias("legacy"))


#: A value's place by its type where neither pattern nor sample holds it, and its score in the column of its own type.
PLACE = "case when v like '$%' then 100 when kind = 'date' then 60 when kind = 'currency' then 50 when kind = 'percentage' then 40 when kind = 'number' then 30 else 10 end"


@query(f"""with f as (select doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]{{1,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,4}}|[$]\\s?[0-9,]+(?:[.][0-9]+)?|-?[0-9,]+(?:[.][0-9]+)?\\s?%|\\b[0-9][0-9,]*(?:[.][0-9]+)?\\b') as vs from documents),
  d as (select doc_id, v, min(i) as i from (select doc_id, unnest(vs) as v, unnest(range(0, len(vs))) as i from f) group by all),
  k as (select *, {KIND("v")} as kind from d),
  g as (select doc_id, count(*) as n, list(v order by {PLACE} desc, i) as ordered, list(case kind when 'text' then 55 else 80 end order by i) as scores from k group by all)
  select doc_id, coalesce(n, 0) as n, coalesce(ordered, []) as ordered, coalesce(scores, []) as scores from documents left join g using (doc_id)""", None)
def set_08_srt_14_str_19_values(spark, sf_dir):
    """Typed values of all documents in order of priority, and the score of each against the column of its type."""
    values = choice.typed_values(F.col("text"))
    docs = bridge.load(spark, sf_dir, "documents").select("doc_id", values.alias("v"))
    own = F.transform("v", lambda x: x["value"])
    none = F.array().cast("array<string>")
    best = F.transform("v", lambda x: choice.column_score(x["value"], x["type"], text.pattern_of(x["type"]), none))
    return docs.select("doc_id", F.size("v").alias("n"), choice.value_priority(own, F.array(F.lit(r"^\$")), none).alias("ordered"), best.alias("scores"))


# Pieces of SQL over the columns of a table.
SCORE = "coalesce(list_sum(list_transform(headers, lambda h: greatest(0.0, " + ", ".join(f"case when contains(lower(h), '{w}') then {v} else 0.0 end" for w, v in choice.HEADER_WEIGHTS.items()) + "))), 0.0)"
NAMED = f"(case when len(headers) > 0 then {count('headers', 'h', full('h'))} / len(headers) else 0.0 end)"
TRADE = f"({count('headers', 'h', "regexp_matches(lower(h), 'commission|premium|policy|amount|date|name|group')")} > 0)"
TYPES = "list_transform(range(0, len(headers)), lambda i: case when " + all_like("^-?[0-9,]+([.][0-9]+)?$") + " then 'number' when " + all_like("^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$") + " then 'date' when " + all_like("^[($-]*[$][ ]*[0-9,.]+[)]?$") + " then 'currency' else 'text' end)"
LENGTH = "coalesce(list_avg(list_transform(flatten(rows), lambda x: length(x))), 0.0)"
BONUS = "coalesce(list_sum(list_transform(headers, lambda h: case when regexp_matches(lower(h), 'commission|premium') then 3 when regexp_matches(lower(h), 'policy|group|date|amount|name') then 2 else 0 end)), 0)"
FIXED = "(case " + " ".join(f"when regexp_matches(x, '{p}') then '$' || regexp_extract(x, '{p}', 1)" for p, _ in tb.BRACKETS) + " else x end)"
of_words = lambda words: "|".join(words)
WEAK = " + ".join(f"(contains(said, '{w}'))::int" for w in sequences.WEAK)
#: Rows of each table that stay once its summary rows are out: ``stays`` (doc_id, table_index, n_rows).
STAYS = f"""sr as (select doc_id, table_index, unnest(range(0, len(rows))) as i, unnest(rows) as c from md_table),
  ss as (select doc_id, table_index, i, lower(trim(array_to_string(list_transform(c, lambda x: {FIXED}), ' '))) as said, len(list_filter(c, lambda x: x <> '')) / len(c) as full_ from sr),
  su as (select *, regexp_matches(said, '[0-9]') as dg, avg(full_) over t as mf, count(*) over t as n, {WEAK} as weak, row_number() over (partition by doc_id, table_index order by i) - 1 as pl from ss window t as (partition by doc_id, table_index)),
  sv as (select *, coalesce((abs(full_ - lag(full_) over w) > 0.3 or dg <> lag(dg) over w) and (abs(full_ - lead(full_) over w) > 0.3 or dg <> lead(dg) over w), false) as apart from su window w as (partition by doc_id, table_index order by i)),
  sx as (select *, case when regexp_matches(said, '{of_words(sequences.STRONG)}') then 0.95 when regexp_matches(said, '{of_words(sequences.AGENT)}') then 0.85 when weak >= 2 then least(0.7 + weak * 0.1, 0.85) when weak = 1 then 0.4 else 0.1 end as sem,
    case when regexp_matches(said, '{of_words(sequences.TOTALS)}') then 0.9 when regexp_matches(said, '{of_words(sequences.AGENT_KEYS)}') then 0.8 else 0.1 end as bus,
    case when pl = n - 1 then 0.7 when pl > n * 0.8 then 0.5 when pl > n * 0.6 then 0.3 when pl > 0 and apart then 0.4 else 0.2 end as pos, case when full_ < mf * 0.5 then 0.8 when full_ < mf * 0.7 then 0.6 when full_ < mf * 0.9 then 0.3 else 0.1 end as den from sv),
  sy as (select *, least(round(0.45 * sem + 0.35 * bus + 0.15 * den + 0.05 * pos, 9), 1.0) as conf from sx),
  sz as (select *, conf > 0.75 and (sem > 0.8)::int + (bus > 0.7)::int + (den > 0.6)::int + (pos > 0.5)::int >= 2 and n >= 3 as cand from sy),
  sc as (select *, cand and row_number() over (partition by doc_id, table_index order by cand desc, conf desc, i) <= greatest(1, floor(n * 0.35)) as chosen from sz),
  stays as (select doc_id, table_index, case when sum(chosen::int) <= max(n) * 0.35 and max(n) - sum(chosen::int) >= 3 then max(n) - sum(chosen::int) else max(n) end as n_rows from sc group by all)"""


@query(f"""with {markdown.SQL}, {STAYS}, m as (select doc_id, table_index, headers, rows, {SCORE} as header_score, {TYPES} as types, {COMPLETE} as dense, {LENGTH} as length_, list_distinct(list_transform(headers, lambda h: lower(trim(h)))) as names, {NAMED} as named,
    len(headers) + {BONUS} - case when {LIKE_DATA} then 10 else 0 end as as_headers, {RAGGED} as ragged from md_table),
  b as (select doc_id, arg_max(headers, (as_headers, -table_index)) as best_headers from m group by all)
  select a.doc_id, a.table_index, list_filter([case when len(a.headers) = 0 then 'no headers' end, case when len(a.rows) = 0 then 'no rows' end, case when a.ragged then 'ragged' end, case when len(a.names) < len(a.headers) then 'repeated headers' end, case when a.dense < 0.1 then 'nearly empty' end], lambda x: x is not null) as faults,
    a.header_score, a.header_score >= 2 or (len(flatten(a.rows)) > 0 and 3 * len(list_filter(flatten(a.rows), lambda x: {KIND("x")} in ('currency', 'percentage'))) >= len(flatten(a.rows))) as financial,
    round(least(0.3 * a.dense + 0.2 * a.named + case when len(a.rows) >= 3 then 0.2 else 0.1 end + case when {TRADE.replace("headers", "a.headers")} then 0.3 else 0.0 end, 1.0), 6) as excel_confidence, round(0.4 * a.dense + case when a.ragged then 0.0 else 0.3 end + 0.3 * a.named, 6) as excel_quality,
    round(0.3 * coalesce(len(list_intersect(a.names, f.names)) / nullif(len(list_distinct(list_concat(a.names, f.names))), 0), 0.0) + 0.2 * coalesce(least(len(a.headers), len(f.headers)) / nullif(greatest(len(a.headers), len(f.headers)), 0), 1.0)
      + 0.25 * coalesce(len(list_filter(range(0, least(len(a.types), len(f.types))), lambda i: a.types[i + 1] = f.types[i + 1])) / nullif(greatest(len(a.headers), len(f.headers)), 0), 1.0)
      + 0.15 * (1 - abs(a.dense - f.dense)) + 0.1 * coalesce(least(a.length_, f.length_) / nullif(greatest(a.length_, f.length_), 0), 1.0), 6) as similarity, best_headers, n_rows
  from m a join m f on f.doc_id = a.doc_id and f.table_index = 0 join b on b.doc_id = a.doc_id join stays s on s.doc_id = a.doc_id and s.table_index = a.table_index""", None)
def tbl_19_31_32_37_39_mth_22_tables(spark, sf_dir):
    """Faults, scores and enhanced rows of all tables in the documents, and their likeness to the document's first table."""
    t = found(spark, sf_dir).select(*KEYS, "headers", "rows")
    first = t.where("table_index = 0").select("doc_id", F.col("headers").alias("h0"), F.col("rows").alias("r0"))
    best = choice.best_header_table(t, ["doc_id"]).select("doc_id", F.col("headers").alias("best_headers"))
    h, r = F.col("headers"), F.col("rows")
    excel = choice.excel_confidence(h, r)
    got = choice.enhance(t, KEYS).withColumnRenamed("rows", "enhanced").drop("headers").join(t, KEYS).join(first, "doc_id").join(best, "doc_id")
    return got.select(*KEYS, choice.structure_faults(h, r).alias("faults"), choice.header_score(h).alias("header_score"), choice.is_financial(h, r).alias("financial"), excel["confidence"].alias("excel_confidence"), excel["quality"].alias("excel_quality"), F.round(choice.table_similarity((h, r), (F.col("h0"), F.col("r0"))), 6).alias("similarity"), "best_headers", F.size("enhanced").alias("n_rows"))


@query(f"""with recursive {_leaders_sql("select o_custkey as g, o_orderstatus || o_orderpriority as v, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey, o_totalprice from orders", 0.8)},
  b as (select r.g, leader, r.v, o_orderkey, least(greatest(cast(o_totalprice as double) / 1e5, 0.0), 1.0) as score from r join s on s.g = r.g and s.i = r.i) select g as o_custkey, leader - 1 as leader, arg_max(v, (score, -o_orderkey)) as text, count(*) as n from b group by g, leader""", None)
def tbl_38_fuse(spark, sf_dir):
    rows = bridge.load(spark, sf_dir, "orders").select("o_custkey", F.concat("o_orderstatus", "o_orderpriority").alias("text"), (F.col("o_totalprice") / 1e5).alias("score"), F.col("o_orderkey").alias("nth"))
    return choice.fuse(rows, ["o_custkey"])


@query(f"select document_id, tool_name, table_index, filename, round(f1_score, 6) as f1_score, case when l_partkey % 3 > 0 then 'n' || l_partkey || '|' || table_index end as body, case when l_partkey % 3 > 0 then l_partkey % 3 end as n_rows from {SCORED}", "tables")
def prj_03_document_results(spark, sf_dir):
    """Scored runs with the bodies of their tables; a run without a stored body keeps a null one."""
    p = F.col("l_partkey")
    row = F.array(F.concat(F.lit("n"), p.cast("string")), F.col("table_index").cast("string"))
    bodies = bridge.extractions(spark, sf_dir).where("l_partkey % 3 > 0").select("document_id", "tool_name", "table_index", row.alias("headers"), F.array_repeat(row, (p % 3).cast("int")).alias("rows"))
    return choice.document_results(scored(spark, sf_dir), bodies).select("document_id", "tool_name", "table_index", "filename", F.round("f1_score", 6).alias("f1_score"), F.array_join("headers", "|").alias("body"), F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"))
