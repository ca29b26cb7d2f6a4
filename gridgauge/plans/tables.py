"""Queries over tables found in documents: parsing, scoring, merging, cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text
from gridgauge.operators import merge, metrics
from gridgauge.plans.registry import query
from gridgauge.shared import written
from gridgauge.sources import bridge, markdown, payloads

KEYS = ["doc_id", "table_index"]
with_md = lambda body: f"with {markdown.SQL} {body}"


def found(spark, sf_dir):
    return markdown.tables(bridge.load(spark, sf_dir, "documents"))


def pairs(spark, sf_dir):
    """The tables of the documents as truth; as prediction the same with every seventh row missing and every eleventh cell changed."""
    kept = F.filter(F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: x["i"] % 7 != 6)
    cell = lambda x, i, j: F.when((i * 8 + j) % 11 == 0, F.concat(x, F.lit("x"))).otherwise(x)
    pred = F.transform(kept, lambda x: F.transform(x["r"], lambda c, j: cell(c, x["i"], j)))
    return found(spark, sf_dir).select(*KEYS, F.col("headers").alias("true_headers"), F.col("rows").alias("true_rows"), F.col("headers").alias("pred_headers"), pred.alias("pred_rows"))


CELL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '[$€£¥₹]', '', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"
PAIRS = f"""{markdown.SQL}, tr as (select doc_id, table_index, unnest(range(0, len(rows))) as i, unnest(rows) as r from md_table),
tc as (select doc_id, table_index, i, unnest(range(0, len(r))) as j, unnest(r) as c from tr),
tcell as (select doc_id, table_index, i, j, {CELL.format("c")} as c from tc),
pcell as (select doc_id, table_index, i, j, {CELL.format("case when (i * 8 + j) % 11 = 0 then c || 'x' else c end")} as c from tc where i % 7 <> 6)"""


@query(with_md("select doc_id, table_index, first_pos as line, array_to_string(headers, '|') as headers, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) as rows from md_table"), None)
def src_16_markdown_tables(spark, sf_dir):
    return found(spark, sf_dir).select(*KEYS, "line", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


@query(f"""with {PAIRS}, n as (select doc_id, table_index, c, sum(p) as p, sum(t) as t from (select doc_id, table_index, c, 1 as p, 0 as t from pcell union all select doc_id, table_index, c, 0, 1 from tcell) group by all)
  select doc_id, table_index, sum(least(p, t)) as tp, sum(greatest(p - t, 0)) as fp, sum(greatest(t - p, 0)) as fn, round(2.0 * sum(least(p, t)) / (sum(p) + sum(t)), 6) as f1_score from n group by all""", None)
def mth_01_set_01_02_cell_f1(spark, sf_dir):
    return metrics.cell_f1(pairs(spark, sf_dir), KEYS).select(*KEYS, "tp", "fp", "fn", F.round("f1_score", 6).alias("f1_score"))


@query(f"""with {PAIRS}, n as (select doc_id, table_index, c, sum(p) as p, sum(t) as t from (select doc_id, table_index, c, 1 as p, 0 as t from pcell union all select doc_id, table_index, c, 0, 1 from tcell) group by all)
  select doc_id, table_index, sum(greatest(p, t)) as cells from n group by all""", None)
def set_03_union(spark, sf_dir):
    """Cells of either table, as multisets."""
    return metrics.cell_f1(pairs(spark, sf_dir), KEYS).select(*KEYS, (F.col("tp") + F.col("fp") + F.col("fn")).alias("cells"))


def paged_answers(spark, sf_dir, size):
    """The documents' tables with headers as a block graph in answers of ``size`` blocks, chained by tokens; every third answer is there twice, and an old one leads on to nothing."""
    t = found(spark, sf_dir).where(F.size("headers") > 0)
    lines = t.select(*KEYS, F.posexplode(F.concat(F.array("headers"), F.col("rows"))).alias("r", "cells"))
    cells = lines.select(*KEYS, "r", F.posexplode("cells").alias("c", "x"))
    of = lambda *parts: F.concat_ws("-", F.lit("t"), *[F.col(p).cast("string") for p in parts])
    words = F.filter(F.split("x", r"\s+"), lambda w: w != "")
    cells = cells.select("*", of("table_index", "r", "c").alias("id"), words.alias("words"))
    child = lambda ids: F.array(F.struct(F.lit("CHILD").alias("Type"), ids.alias("Ids")))
    none = lambda kind: F.lit(None).cast(kind)

    def block(rows, ident, kind, kids=none("array<struct<Type:string,Ids:array<string>>>"), row=none("int"), col=none("int"), heads=none("array<string>"), confidence=none("double"), said=none("string")):
        return rows.select("doc_id", F.struct(ident.alias("Id"), F.lit(kind).alias("BlockType"), kids.alias("Relationships"), row.alias("RowIndex"), col.alias("ColumnIndex"), heads.alias("EntityTypes"), confidence.alias("Confidence"), said.alias("Text")).alias("b"))

    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "id"))), lambda x: x["id"])
    tables = block(cells.groupBy(*KEYS).agg(ids.alias("ids")), of("table_index"), "TABLE", child(F.col("ids")))
    kids = F.transform("words", lambda w, i: F.concat_ws("-", "id", i.cast("string")))
    own = block(cells, F.col("id"), "CELL", child(kids), (F.col("r") + 1).cast("int"), (F.col("c") + 1).cast("int"), F.when(F.col("r") == 0, F.array(F.lit("COLUMN_HEADER"))), F.lit(50.0) + F.col("r") % 2)
    each = cells.select("doc_id", "id", F.posexplode("words").alias("i", "w"))
    blocks = tables.unionByName(own).unionByName(block(each, F.concat_ws("-", "id", F.col("i").cast("string")), "WORD", said=F.col("w")))
    placed = blocks.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("b.Id")) - 1) / size))
    token = lambda n: F.when(n > 0, F.concat(F.lit("next "), n.cast("string")))
    pages = placed.groupBy("doc_id", "page").agg(F.to_json(F.struct(F.collect_list("b").alias("Blocks"))).alias("payload"))
    last = F.max("page").over(Window.partitionBy("doc_id"))
    pages = pages.select("doc_id", "page", token(F.col("page")).alias("token"), F.when(F.col("page") < last, token(F.col("page") + 1)).alias("next_token"), "payload")
    old = pages.where("page = 0").select("doc_id", F.lit("old").alias("token"), F.lit(None).cast("string").alias("next_token"), "payload")
    return pages.unionByName(pages.where("page % 3 = 0")).drop("page").unionByName(old)


@query(f"""with {markdown.SQL}, t as (select *, greatest(len(headers), list_max(list_transform(rows, lambda r: coalesce(list_max(list_transform(range(0, len(r)), lambda i: case when trim(r[i + 1]) <> '' then i + 1 else 0 end)), 0)))) as w,
    list_concat(list_transform(headers, lambda x: 50.0), flatten(list_transform(range(0, len(rows)), lambda i: list_transform(rows[i + 1], lambda x: 50.0 + (i + 1) % 2)))) as conf from md_table where len(headers) > 0)
  select doc_id, table_index, array_to_string(list_transform(range(0, w), lambda i: coalesce(regexp_replace(headers[i + 1], '\\s+', ' ', 'g'), '')), '|') as headers,
  array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(range(0, w), lambda i: coalesce(regexp_replace(trim(r[i + 1]), '\\s+', ' ', 'g'), '')), '|')), chr(10)) as rows, round(list_avg(conf), 2) as confidence, true as whole from t""", None)
def src_09_paged_blocks(spark, sf_dir):
    """Tables read back from the answers of a paged service."""
    answers = payloads.answers_in_order(written(paged_answers(spark, sf_dir, 100)), ["doc_id"])
    got = payloads.blocks_to_tables(payloads.blocks_of(answers, ["doc_id", "whole"]), ["doc_id", "whole"])
    return got.select("doc_id", F.substring_index("table", "-", -1).cast("int").alias("table_index"), F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"), "confidence", "whole")


@query()
def mth_02_03_teds(spark, sf_dir):
    return metrics.teds(pairs(spark, sf_dir), KEYS)


@query(f"""with {PAIRS}, ph as (select doc_id, table_index, {CELL.format("unnest(headers)")} as c, unnest(range(0, len(headers))) as j from md_table),
  p as (select doc_id, table_index, -1 as i, j, c from ph union all select * from pcell), t as (select doc_id, table_index, -1 as i, j, c from ph union all select * from tcell),
  pn as (select doc_id, table_index, i, count(*) as n from p group by all), tn as (select doc_id, table_index, i, count(*) as n from t group by all),
  sh as (select doc_id, table_index, pi, ti, sum(least(a.n, b.n)) as s from (select doc_id, table_index, i as pi, c, count(*) as n from p group by all) a join (select doc_id, table_index, i as ti, c, count(*) as n from t group by all) b using (doc_id, table_index, c) group by all),
  best as (select pn.doc_id, pn.table_index, pn.i, max(coalesce(sh.s / (pn.n + tn.n - sh.s), 0)) as v from pn join tn using (doc_id, table_index) left join sh on sh.doc_id = pn.doc_id and sh.table_index = pn.table_index and sh.pi = pn.i and sh.ti = tn.i group by all),
  shape as (select doc_id, table_index, count(distinct i) as r, max(j) + 1 as c from p group by all), tshape as (select doc_id, table_index, count(distinct i) as r, max(j) + 1 as c from t group by all)
  select b.doc_id, b.table_index, round(avg(v), 6) as grits_con, round(max((least(s.r, t.r) / greatest(s.r, t.r)) * (least(s.c, t.c) / greatest(s.c, t.c))), 6) as grits_top from best b join shape s using (doc_id, table_index) join tshape t using (doc_id, table_index) group by all""", None)
def mth_04_05_jn_11_grits(spark, sf_dir):
    return metrics.grits(pairs(spark, sf_dir), KEYS).select(*KEYS, F.round("grits_con", 6).alias("grits_con"), F.round("grits_top", 6).alias("grits_top"))


@query()
def mth_06_all_metrics(spark, sf_dir):
    return metrics.scores(pairs(spark, sf_dir), KEYS)


def fragments(spark, sf_dir):
    """Rows of each order as tables of a page, so that neighbours may go together."""
    lines = bridge.dealt(bridge.load(spark, sf_dir, "lineitem"), "l_orderkey")
    got = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"), F.count("*").alias("k"))
    n = F.col("l_linenumber")
    rows = F.when(F.col("part") % 10 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(n.cast("string"), F.col("part").cast("string"))))
    return got.select(F.col("l_orderkey").alias("document_id"), ((n - 1) / 3).cast("int").alias("page_number"), ((n - 1) % 3).cast("int").alias("table_index"), F.array(F.concat(F.lit(" "), F.col("flag")), F.lit("Part")).alias("headers"), rows.alias("rows"))


@query("""with f as (select l_orderkey as document_id, cast(floor((l_linenumber - 1) / 3) as int) as page, cast((l_linenumber - 1) % 3 as int) as ti, min(l_returnflag) as flag, min(l_partkey) as part, l_linenumber as ln from lineitem group by l_orderkey, l_linenumber),
  g as (select *, part % 10 <> 0 as full_, lag(page) over w as lp, lag(ti) over w as lt, lag(flag) over w as lf, lag(part % 10 <> 0) over w as lfull from f window w as (partition by document_id order by page, ti)),
  r as (select *, sum(case when coalesce(flag = lf and full_ and lfull and ((page = lp and ti = lt + 1) or (page = lp + 1 and ti in (0, 1))), false) then 0 else 1 end) over (partition by document_id order by page, ti) as run from g)
  select document_id, row_number() over (partition by document_id order by run) - 1 as table_index, count(*) filter (full_) as row_count, count(*) as merged_from, min(page) as page_from, max(page) as page_to,
  coalesce(string_agg(cast(ln as varchar), ',' order by page, ti) filter (full_), '') as lines from r group by document_id, run""", None)
def win_01_02_03_merge(spark, sf_dir):
    got = merge.merge_fragments(fragments(spark, sf_dir), ["document_id"])
    return got.select("document_id", "table_index", "row_count", "merged_from", "page_from", "page_to", F.array_join(F.transform("rows", lambda r: F.get(r, 0)), ",").alias("lines"))


@query("""with f as (select l_orderkey as document_id, l_linenumber as ln, min(l_returnflag) as flag from lineitem group by all), r as (select *, sum(x) over (partition by document_id order by ln) as run from (select *, case when flag = lag(flag) over (partition by document_id order by ln) then 0 else 1 end as x from f))
  select document_id, row_number() over (partition by document_id order by run) - 1 as table_index, count(*) as merged_from from r group by document_id, run""", None)
def win_04_merge_equal_headers(spark, sf_dir):
    return merge.merge_fragments(fragments(spark, sf_dir), ["document_id"], check_place=False).select("document_id", "table_index", "merged_from")


@query("""with f as (select l_orderkey as document_id, l_linenumber as ln, min(l_returnflag) as flag from lineitem group by all) select document_id, lower(flag) || '|part' as header_key, count(*) as merged_from from f group by all""", None)
def tbl_18_20_stitch(spark, sf_dir):
    t = fragments(spark, sf_dir).withColumn("table_index", F.col("page_number") * 3 + F.col("table_index"))
    return merge.stitch(t, ["document_id"]).select("document_id", "header_key", "merged_from")


@query(with_md("""select doc_id, table_index, greatest(len(headers), list_max(list_transform(rows, lambda r: len(r)))) as width, list_bool_or(list_transform(rows, lambda r: len(r) <> len(headers))) as ragged, len(rows) as n_rows,
  round(list_sum(list_transform(rows, lambda r: len(list_filter(r, lambda x: trim(x) <> '')))) / (len(headers) * len(rows)), 6) as raw_completeness from md_table where len(headers) > 0"""), None)
def tbl_12_agg_38_shape(spark, sf_dir):
    got = found(spark, sf_dir).where(F.size("headers") > 0)
    cells = F.aggregate("rows", F.lit(0), lambda acc, r: acc + F.size(F.filter(r, lambda x: ~tb.blank(x))))
    return got.select(*KEYS, tb.widest(F.col("headers"), F.col("rows")).alias("width"), tb.ragged(F.col("headers"), F.col("rows")).alias("ragged"), F.size("rows").alias("n_rows"), F.round(cells / (F.size("headers") * F.size("rows")), 6).alias("raw_completeness"))


@query()
def tbl_cleaning(spark, sf_dir):
    """TBL-03, 07, 08, 13 to 17, 23 to 25, 29, 35, 40; AGG-38 to 40, 42, 44; MTH-21 over all tables of the documents."""
    h, r = F.col("headers"), F.col("rows")
    names, cells = tb.reconcile(h, r)
    heads, kept = tb.drop_empty(h, r)
    valid, even = tb.valid_structure(h, r)
    score = 0.25 * tb.completeness(h, r) + 0.25 * tb.structure_score(h, r) + 0.25 * tb.fidelity(h, r)
    return found(spark, sf_dir).select(
        *KEYS, names.alias("reconciled_headers"), F.size(cells).alias("n_rows"), heads.alias("filled_headers"), F.size(kept).alias("n_filled"), valid.alias("valid_headers"), F.size(F.flatten(even)).alias("n_cells"),
        tb.column_types(h, r).alias("types"), F.transform(tb.numbers_to(F.size(h)), lambda i: tb.header_from_data(r, i)).alias("guessed"), F.size(tb.nulls_for_blanks(r)).alias("n_valued"), tb.fill_sub_headers(h).alias("sub_headers"),
        tb.split_compound(h).alias("compound"), tb.zip_headers(F.array(h, F.get(r, 0))).alias("zipped"), tb.fix_brackets(r).alias("bracketed"), tb.auto_named(h).alias("auto_named"), text.headers_look_like_data(h).alias("data_like"),
        F.round(tb.completeness(h, r), 6).alias("completeness"), F.round(tb.structure_score(h, r), 6).alias("structure"), F.round(tb.fidelity(h, r), 6).alias("fidelity"), F.round(score, 6).alias("overall"), tb.level(score).alias("level"), tb.letter(score).alias("grade"), F.round(tb.text_table_confidence(h, r), 6).alias("confidence"),
    )
