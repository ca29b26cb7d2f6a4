"""Queries of single functions over table values and texts, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridgauge.functions import dates, text
from gridgauge.functions import tables as tb
from gridgauge.operators import quality, sequences
from gridgauge.plans.figures import r6
from gridgauge.plans.registry import query
from gridgauge.sources import bridge

# Tables made of parts: ragged, blank, data-like, repeated and auto-named ones.  The same text serves Spark and DuckDB.
ROWS = (
    "{A}(p_brand, '$' || cast(p_size * 37 as string) || '.50', cast(p_size as string), '03/0' || cast(p_size % 9 + 1 as string) || '/2024')",
    "{A}('', '', p_type)",
    "{A}('', ' ', '', '')",
    "{A}('Total', '($' || cast(p_size as string) || '.25)', cast(p_size as string) || '%', '', 'extra')",
    "{A}('Group Name: Acme ' || p_brand, 'Client: ab')",
)
HEADERS = "case when p_partkey % 13 = 0 then {E1} when p_partkey % 5 = 0 then {A}('Group Name', 'Premium', 'Rate', 'Date') when p_partkey % 5 = 1 then {A}('Company', '', 'Amount') when p_partkey % 5 = 2 then {A}('x', 'Column_2', 'column 3', 'Total', 'Agent') when p_partkey % 5 = 3 then {A}('12/01/2024', '$5', '7', 'a') else {A}('Policy', 'Policy', ' ', 'Policy') end"
BODY = "case when p_partkey % 11 = 0 then {E2} when p_size % 4 = 0 then {A}(" + ", ".join(ROWS[k] for k in (0, 1, 2, 3)) + ") when p_size % 4 = 1 then {A}(" + ", ".join(ROWS[k] for k in (0, 0)) + ") when p_size % 4 = 2 then {A}(" + ", ".join(ROWS[k] for k in (0, 3, 2)) + ") else {A}(" + ", ".join(ROWS[k] for k in (4, 0, 1)) + ") end"
SPARK = {"A": "array", "E1": "cast(array() as array<string>)", "E2": "cast(array() as array<array<string>>)"}
DUCK = {"A": "list_value", "E1": "cast([] as varchar[])", "E2": "cast([] as varchar[][])"}
TAB = f"with tab as (select p_partkey as k, p_size as s, {HEADERS.format(**DUCK)} as headers, {BODY.format(**DUCK)} as rows from part)"


def parts(spark, sf_dir):
    """The parts, dealt over tasks: a small file is one task's, however long the work on its rows takes."""
    return bridge.dealt(bridge.load(spark, sf_dir, "part"), "p_partkey")


def tab(spark, sf_dir):
    return parts(spark, sf_dir).selectExpr("p_partkey as k", "p_size as s", f"{HEADERS.format(**SPARK)} as headers", f"{BODY.format(**SPARK)} as rows")


def H():  # noqa: N802
    return F.col("headers")


def R():  # noqa: N802
    return F.col("rows")



flat = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit("~"))), "|")), ";")
heads = lambda c: F.array_join(c, "|")
# Pieces of SQL.
flat_sql = lambda rows: f"array_to_string(list_transform({rows}, lambda r_: array_to_string(list_transform(r_, lambda x_: coalesce(x_, '~')), '|')), ';')"
heads_sql = lambda c: f"array_to_string({c}, '|')"
full = lambda x: f"trim(coalesce({x}, '')) <> ''"
count = lambda l, v, c: f"len(list_filter({l}, lambda {v}: {c}))"
WIDTH = "greatest(len(headers), coalesce(list_max(list_transform(rows, lambda q: len(q))), 0))"
KIND = lambda v: f"""(case when regexp_matches(trim({v}), '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}$|^\\d{{4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}$') then 'date' when regexp_matches(trim({v}), '^[($-]*\\$\\s*[\\d,]+(\\.\\d+)?\\)?$') then 'currency'
  when regexp_matches(trim({v}), '^-?[\\d,]+(\\.\\d+)?\\s*%$') then 'percentage' when regexp_matches(trim({v}), '^-?[\\d,]+(\\.\\d+)?$') then 'number' else 'text' end)"""  # noqa: E731
LIKE_DATA = f"(case when len(headers) > 0 then {count('headers', 'h', KIND('h') + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) + 'text' + chr(39))} / len(headers) >= case when len(headers) >= 5 then 0.4 else 0.5 end else false end)"
FULL_CELLS = f"coalesce(list_sum(list_transform(rows, lambda r: {count('r', 'x', full('x'))})), 0)"
COMPLETE = f"(case when len(headers) * len(rows) > 0 then least(1.0, {FULL_CELLS} / (len(headers) * len(rows))) else 0.0 end)"
RAGGED = "(len(list_filter(rows, lambda r: len(r) <> len(headers))) > 0)"
STRUCTURE = f"""(0.4 * case when len(headers) > 0 then {count('headers', 'h', full('h') + " and length(trim(h)) > 1 and not regexp_matches(lower(h), '^column[_ ]?[0-9]+$')")} / len(headers) else 0.0 end
  + 0.4 * case when len(rows) > 0 then {count('rows', 'r', 'len(r) = len(headers)')} / len(rows) else 0.0 end + case when len(headers) * len(rows) between 6 and 500 then 0.2 else 0.0 end)"""
FILLED = f"list_filter(flatten(list_slice(rows, 1, 10)), lambda x: {full('x')})"
FIDELITY = f"""(case when len({FILLED}) > 0 then 0.6 * {count(FILLED, 'x', "regexp_matches(x, '^[($-]*[$]?[ ]*[0-9,]+[.][0-9][0-9][)]?$|^[$][ ]*[0-9,]+|^-?[0-9]+([.][0-9]+)?[ ]*%$')")} / len({FILLED}) else 0.0 end
  + case when {count('headers', 'h', "regexp_matches(lower(h), 'company|group|client|customer|carrier')")} > 0 then 0.4 else 0.0 end)"""
COMPANIES = (
    "(?i)(?:company name|group name|client|customer)\\s*:\\s*([^\\n|]+)",
    "(?i)\\b([a-z][\\w&.,'' -]*?\\s(?:llc|inc|corp|ltd|llp|lp)\\b\\.?)",
    "(?i)\\b([a-z][\\w&.,'' -]*?\\s(?:company|corporation|incorporated|group|associates|enterprises)\\b)",
)
found_sql = lambda c: "list_filter(list_transform(list_concat(" + ", ".join(f"regexp_extract_all({c}, '{p}', 1)" for p in COMPANIES) + "), lambda w_: trim(w_)), lambda w_: length(w_) > 3)"
HIERARCHY = f"(case when len(list_filter(list_slice(rows, 1, 5), lambda r: len({found_sql(chr(97) + 'rray_to_string(r, ' + chr(39) + ' ' + chr(39) + ')')}) > 0)) > 0 then 0.6 else 0.0 end)"
of_tab = lambda select, more="": f"{TAB}{more} select k, {select} from tab"


@query(of_tab(f"{heads_sql(f'list_transform(range(0, {WIDTH}), lambda i: coalesce(headers[i + 1], ' + chr(39) + 'Col ' + chr(39) + ' || (i + 1)))')} as names, {flat_sql(f'list_transform(rows, lambda r: list_transform(range(0, {WIDTH}), lambda i: coalesce(r[i + 1], ' + chr(39) * 2 + ')))')} as cells"), None)
def tbl_07_reconcile(spark, sf_dir):
    h, r = tb.reconcile(H(), R())
    return tab(spark, sf_dir).select("k", heads(h).alias("names"), flat(r).alias("cells"))


HELD = f"list_filter(range(0, {WIDTH}), lambda i: {full('headers[i + 1]')} or len(list_filter(rows, lambda r: {full('r[i + 1]')})) > 0)"


@query(f"""{TAB}, h as (select *, {HELD} as held from tab) select k, {heads_sql("list_transform(held, lambda i: case when i < len(headers) then headers[i + 1] else 'Column_' || (i + 1) end)")} as names,
  {flat_sql(f"list_filter(list_transform(rows, lambda r: list_transform(held, lambda i: coalesce(r[i + 1], ''))), lambda r: {count('r', 'x', full('x'))} > 0)")} as cells from h""", None)
def tbl_08_drop_empty(spark, sf_dir):
    h, r = tb.drop_empty(H(), R())
    return tab(spark, sf_dir).select("k", heads(h).alias("names"), flat(r).alias("cells"))


@query(of_tab("case when k % 2 = 0 then 'A||C' when len(rows) > 0 then array_to_string(rows[1], '|') else '' end as names, " + flat_sql("case when k % 2 = 0 then rows else list_slice(rows, 2, 99) end") + " as cells"), None)
def tbl_11_split_header(spark, sf_dir):
    h, r = tb.split_header(R(), F.col("k") % 2 == 0, F.array(F.lit("A"), F.lit(None).cast("string"), F.lit("C")))
    return tab(spark, sf_dir).select("k", heads(h).alias("names"), flat(r).alias("cells"))


@query(f"""{TAB}, h as (select k, headers, unnest(range(0, len(headers))) as i from tab), j as (select *, list_max(list_filter(range(0, i + 1), lambda j: {full('headers[j + 1]')})) as j from h)
  select k, coalesce(string_agg(case when j is null then '' when i = j then trim(j.headers[i + 1]) else trim(j.headers[j + 1]) || ' ' || (i - j + 1) end, '|' order by i), '') as names from tab left join j using (k) group by k""", None)
def tbl_13_sub_headers(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(tb.fill_sub_headers(H())).alias("names"))


@query(f"""{TAB}, w as (select *, {WIDTH} as w from tab), n as (select *, list_transform(range(0, w), lambda i: case when {full('headers[i + 1]')} then headers[i + 1] else 'Column_' || (i + 1) end) as n from w)
  select k, {heads_sql("list_transform(range(0, w), lambda i: case when len(list_filter(list_slice(n, 1, i), lambda x: x = n[i + 1])) > 0 then n[i + 1] || '_' || len(list_filter(list_slice(n, 1, i), lambda x: x = n[i + 1])) else n[i + 1] end)")} as names, coalesce(list_sum(list_transform(rows, lambda r: w)), 0) as n_cells from n""", None)
def tbl_14_valid_structure(spark, sf_dir):
    h, r = tb.valid_structure(H(), R())
    return tab(spark, sf_dir).select("k", heads(h).alias("names"), F.size(F.flatten(r)).alias("n_cells"))


VALUES_AT = "list_transform(list_slice(rows, 1, 5), lambda r: coalesce(r[i + 1], ''))"
any_like = lambda p: f"len(list_filter({VALUES_AT}, lambda v: regexp_matches(v, '{p}'))) > 0"


@query(of_tab(heads_sql("list_transform(range(0, len(headers)), lambda i: case when " + any_like("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}") + " then 'Date' when " + any_like("[$][ ]*[0-9,]+|^[0-9]+[.][0-9]{2}$") + " then 'Amount' when " + any_like("^[A-Za-z][A-Za-z .,&''-]{2,}$") + " then 'Name' else 'Column_' || (i + 1) end)") + " as names"), None)
def tbl_15_header_from_data(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(F.transform(tb.numbers_to(F.size(H())), lambda i: tb.header_from_data(R(), i))).alias("names"))


SAMPLES = f"list_slice(list_filter(list_transform(rows, lambda r: trim(coalesce(r[i + 1], ''))), lambda v: v <> ''), 1, 10)"
all_like = lambda p: f"len({SAMPLES}) > 0 and len(list_filter({SAMPLES}, lambda v: not regexp_matches(v, '{p}'))) = 0"


@query(of_tab(heads_sql("list_transform(range(0, len(headers)), lambda i: case when " + all_like("^-?[0-9,]+([.][0-9]+)?$") + " then 'number' when " + all_like("^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$") + " then 'date' when " + all_like("^[($-]*[$][ ]*[0-9,.]+[)]?$") + " then 'currency' else 'text' end)") + " as types"), None)
def tbl_16_column_types(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(tb.column_types(H(), R())).alias("types"))


@query(of_tab(flat_sql(f"list_filter(list_transform(rows, lambda r: list_transform(r, lambda x: case when {full('x')} then x end)), lambda r: {count('r', 'x', 'x is not null')} > 0)") + " as cells"), None)
def tbl_17_nulls(spark, sf_dir):
    return tab(spark, sf_dir).select("k", flat(tb.nulls_for_blanks(R())).alias("cells"))


@query("select p_partkey as k, 'Policy|' || p_brand || '|a|b|' || p_type || '|x|y' as names from part", None)
def tbl_23_compound(spark, sf_dir):
    h = F.array(F.concat(F.lit("Policy / "), F.col("p_brand")), F.lit("a  b"), F.col("p_type"), F.lit(" x\ny "))
    return bridge.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), heads(tb.split_compound(h)).alias("names"))


@query(of_tab(heads_sql("list_transform(range(0, greatest(len(headers), coalesce(len(rows[1]), 0))), lambda i: array_to_string(list_filter([trim(coalesce(headers[i + 1], '')), trim(coalesce(rows[1][i + 1], ''))], lambda x: x <> ''), ' '))") + " as names"), None)
def tbl_24_zip_headers(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(tb.zip_headers(F.array(H(), F.coalesce(F.get(R(), 0), tb.no_cells())))).alias("names"))


@query(of_tab(heads_sql("list_transform(range(0, 3), lambda i: coalesce(headers[i + 1], ''))") + " as three, " + flat_sql("list_transform(rows, lambda r: list_transform(range(0, s % 6), lambda i: coalesce(r[i + 1], '')))") + " as cells"), None)
def tbl_25_40_width(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(tb.to_width(H(), 3)).alias("three"), flat(tb.all_to_width(R(), F.col("s") % 6)).alias("cells"))


NUM = "([0-9,]+(?:[.][0-9]+)?)"
MONEY = "((contains(v, '.') and length(v) - length(regexp_replace(v, '[^.]*$', '')) <= 2) or contains(v, ',') or coalesce(try_cast(regexp_replace(v, '[,()$ ]', '', 'g') as double) between 0.01 and 1e9, false))"
first_n = lambda p: f"replace(regexp_extract(v, '{p}', 1), ',', '')"
FIXED = [(f"^[(] *[$] *{NUM} *[)]", "'-$'"), (f"^[(] *[$]? *- *{NUM} *[$]? *[)]", "'-$'"), (f"^\\\\[(] *[$]? *{NUM} *\\\\[)]", "'-$'"), (f"^[(] *{NUM} *[)]", f"case when {MONEY} then '-$' else '-' end"), (f"^[$] *{NUM}", "'$'")]


@query(f"""{TAB}, c as (select k, i, unnest(range(0, len(r))) as j, trim(unnest(r)) as v from (select k, unnest(range(0, len(rows))) as i, unnest(rows) as r from tab)),
  raw as (select k, i, unnest(range(0, len(r))) as j, unnest(r) as o from (select k, unnest(range(0, len(rows))) as i, unnest(rows) as r from tab))
  select k, i, string_agg(case when v = '' then o {' '.join(f"when regexp_matches(v, '{p}') then {s} || {first_n(p)}" for p, s in FIXED)} else v end, '|' order by j) as cells from c join raw using (k, i, j) group by all""", None)
def tbl_29_brackets(spark, sf_dir):
    return tab(spark, sf_dir).select("k", F.posexplode(tb.fix_brackets(R())).alias("i", "r")).select("k", F.col("i").cast("long").alias("i"), heads(F.col("r")).alias("cells"))


@query(of_tab(flat_sql("list_transform(list_concat(rows, list_slice(rows, 1, 1)), lambda r: list_transform(range(0, len(headers)), lambda i: coalesce(r[i + 1], '')))") + " as cells"), None)
def tbl_34_set_04_append(spark, sf_dir):
    return tab(spark, sf_dir).select("k", flat(tb.append(H(), R(), F.slice(R(), 1, 1))).alias("cells"))


@query("select p_partkey as k, p_partkey % 3 = 0 as auto from part", None)
def tbl_35_auto_named(spark, sf_dir):
    k = F.col("p_partkey")
    h = F.when(k % 3 == 0, F.array(F.lit(" Column 1"), F.lit("column 2 "))).when(k % 3 == 1, F.array(F.lit("column 1"), F.lit("column 3"))).otherwise(tb.no_cells())
    return bridge.load(spark, sf_dir, "part").select(k.alias("k"), tb.auto_named(h).alias("auto"))


@query(of_tab("coalesce(list_sum(list_transform(rows, lambda r: len(list_filter(range(0, len(r)), lambda j: (s + j) % 3 = 0)))), 0) as n"), None)
def tbl_33_corrections(spark, sf_dir):
    after = F.transform(R(), lambda r: F.transform(r, lambda x, j: F.when((F.col("s") + j) % 3 == 0, F.concat(x, F.lit("!"))).otherwise(x)))
    return tab(spark, sf_dir).select("k", tb.corrections(R(), after).alias("n"))


OVERALL = f"(0.25 * {COMPLETE} + 0.25 * {STRUCTURE} + 0.25 * {FIDELITY} + 0.15 * {HIERARCHY} + 0.10 * 0.8)"


@query(f"""{TAB}, q as (select k, {COMPLETE} as c, {STRUCTURE} as s, {FIDELITY} as f, {HIERARCHY} as h, {RAGGED} as ragged, len(rows) as n, len(headers) as w, {count('rows', 'r', 'len(r) <> len(headers)')} as uneven from tab), o as (select *, 0.25 * c + 0.25 * s + 0.25 * f + 0.15 * h + 0.1 * 0.8 as o from q)
  select k, round(c, 6) as completeness, round(s, 6) as structure, round(f, 6) as fidelity, round(h, 6) as hierarchy, round(o, 6) as overall, case when round(o, 9) >= 0.9 then 'excellent' when round(o, 9) >= 0.8 then 'good' when round(o, 9) >= 0.7 then 'acceptable' when round(o, 9) >= 0.6 then 'poor' else 'failed' end as level,
  array_to_string(list_filter([case when n = 0 then 'empty' end, case when w = 0 then 'no_headers' end, case when uneven > 0.2 * n then 'ragged' end, case when round(o, 9) < 0.6 then 'low_score' end], lambda x: x is not null), ',') as issues from o""", None)
def agg_39_40_41_42_43_validate(spark, sf_dir):
    got = quality.validate(tab(spark, sf_dir), F.lit(0.8))
    return got.select("k", *[r6(F.col(c)).alias(c) for c in ("completeness", "structure", "fidelity", "hierarchy", "overall")], "level", F.array_join("issues", ",").alias("issues"))


@query(f"""{TAB}, q as (select k, round((case when {RAGGED} then 0.5 else 1.0 end + {COMPLETE} + coalesce(case when k % 3 > 0 then k % 3 * 0.5 end, 0.0)) / 3, 9) as score from tab)
  select k, round(score, 6) as score, case when score >= 0.9 then 'A' when score >= 0.8 then 'B' when score >= 0.7 then 'C' when score >= 0.6 then 'D' else 'F' end as grade from q""", None)
def agg_44_graded(spark, sf_dir):
    k = F.col("k")
    got = quality.graded(H(), R(), F.when(k % 3 > 0, k % 3 * 0.5))
    return tab(spark, sf_dir).select("k", got["score"].alias("score"), got["grade"].alias("grade"))


FACTOR = f"(case when len(headers) > 0 then 0.3 else 0.0 end + case when len(rows) > 0 then 0.3 else 0.0 end + case when not {RAGGED} then 0.2 else 0.0 end + 0.2 * {COMPLETE})"


@query(f"{TAB} select k % 700 as run, round(least(sum(round({FACTOR}, 9)), 1.0), 6) as score from tab group by all", None)
def agg_45_factors(spark, sf_dir):
    return quality.factors(tab(spark, sf_dir).withColumn("run", F.col("k") % 700), ["run"]).select("run", r6(F.col("score")).alias("score"))


@query("select p_partkey as k, round(least(1.0, 0.55 + 0.1 * ((p_partkey % 2 = 0)::int + 1 + (p_partkey % 5 = 0)::int)), 6) as score from part", None)
def agg_46_consistency(spark, sf_dir):
    k = F.col("p_partkey")
    texts = F.array(F.when(k % 2 == 0, F.concat(F.lit("by "), F.upper("p_brand"))), F.concat(F.lit("for "), F.col("p_brand"), F.lit(" only")), F.when(k % 5 == 0, F.lower("p_brand")).otherwise("none"))
    return bridge.load(spark, sf_dir, "part").select(k.alias("k"), r6(quality.consistency(F.lit(0.55), F.col("p_brand"), texts)).alias("score"))


@query("select p_partkey as k, round(least(1.0, greatest(0.0, 0.3 * (p_partkey % 7 / 3.0) + 0.3 * (p_partkey % 5 - 2) + 0.2 * (p_size % 2) + 0.1 * 0.5 + 0.1 * (p_size % 3))), 6) as score from part", None)
def agg_47_overall(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return bridge.load(spark, sf_dir, "part").select(k.alias("k"), r6(quality.overall_confidence(k % 7 / 3.0, k % 5 - 2, s % 2, F.lit(0.5), s % 3)).alias("score"))


ONE_KIND = f"len(list_distinct(list_transform(list_filter(list_transform(rows, lambda r: r[i + 1]), lambda x: {full('x')}), lambda x: {KIND('x')}))) <= 1"
FALLBACK = f"""(0.3 * {COMPLETE} + 0.3 * case when len(rows) > 0 then {count('rows', 'r', 'len(r) = len(headers)')} / len(rows) else 0.0 end
  + 0.2 * case when len(headers) > 0 then {count('range(0, len(headers))', 'i', ONE_KIND)} / len(headers) else 0.0 end + 0.2 * case when len(headers) > 0 then {count('headers', 'h', "regexp_matches(h, '[A-Za-z]{2,}')")} / len(headers) else 0.0 end)"""


@query(of_tab(f"round({FALLBACK}, 6) as score"), None)
def agg_48_fallback(spark, sf_dir):
    return tab(spark, sf_dir).select("k", r6(quality.fallback_quality(H(), R())).alias("score"))


@query(f"{TAB} select k, {flat_sql('list_transform(rows, lambda r: list_transform(r, lambda x: trim(x)))')} as cells from tab where round({FALLBACK}, 9) >= 0.6", None)
def flt_20_keep_good(spark, sf_dir):
    return quality.keep_good(tab(spark, sf_dir), 0.6).select("k", flat(R()).alias("cells"))


@query(f"""{TAB} select k % 500 as run, cast(floor(round(100 * sum(case when len(headers) > 0 then 0.5 else 0.0 end + case when len(rows) > 0 then 0.5 else 0.0 end + 0.5 * {COMPLETE}) / (1.5 * count(*)), 9)) as bigint) as percent from tab group by all""", None)
def agg_51_percent(spark, sf_dir):
    return quality.percent_quality(tab(spark, sf_dir).withColumn("run", F.col("k") % 500), ["run"])


@query(f"""{TAB}, b as (select k % 90 as run, count(*) as t, sum(len(rows)) as r from tab group by all), a as (select k % 90 as run, count(*) as t, sum(len(rows)) as r from tab where k % 3 > 0 and k % 90 > 4 group by all)
  select run, round(coalesce(100.0 * coalesce(a.t, 0) / b.t, 0), 6) as tables_percent, round(coalesce(100.0 * coalesce(a.r, 0) / nullif(b.r, 0), 0), 6) as rows_percent from b left join a using (run)""", None)
def agg_52_preservation(spark, sf_dir):
    t = tab(spark, sf_dir).withColumn("run", F.col("k") % 90)
    got = quality.preservation(t, t.where("k % 3 > 0 and run > 4"), ["run"])
    return got.select("run", r6(F.col("tables_percent")).alias("tables_percent"), r6(F.col("rows_percent")).alias("rows_percent"))


@query(of_tab(f"array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(rows), lambda x: {full('x')}), lambda x: {KIND('x')}))), ',') as kinds"), None)
def agg_54_diversity(spark, sf_dir):
    return tab(spark, sf_dir).select("k", F.array_join(quality.diversity(R()), ",").alias("kinds"))


@query(of_tab(f"round(least(1.0, 0.3 + 0.3 * case when len(headers) > 0 then {count('headers', 'h', 'length(trim(h)) > 2')} / len(headers) else 0.0 end + 0.4 * {COMPLETE}), 6) as score"), None)
def mth_21_text_table(spark, sf_dir):
    return tab(spark, sf_dir).select("k", r6(tb.text_table_confidence(H(), R())).alias("score"))


@query(of_tab(f"array_to_string(list_transform(rows, lambda r: cast(len(r) - {count('r', 'x', full('x'))} >= 0.9 * len(r) as varchar)), ',') as gone"), None)
def mth_23_mostly_empty(spark, sf_dir):
    return tab(spark, sf_dir).select("k", F.array_join(F.transform(R(), lambda r: tb.mostly_empty(r).cast("string")), ",").alias("gone"))


@query(of_tab(f"array_to_string(list_transform(headers, lambda h: {KIND('h')}), ',') as kinds, {LIKE_DATA} as data_like"), None)
def str_24_25_kinds(spark, sf_dir):
    return tab(spark, sf_dir).select("k", F.array_join(F.transform(H(), text.data_type), ",").alias("kinds"), text.headers_look_like_data(H()).alias("data_like"))


@query(f"""{TAB}, t as (select k % 40 as g, k, headers, case when {LIKE_DATA} then list_concat([headers], rows) else list_filter(rows, lambda r: r <> headers) end as rows, array_to_string(list_sort(list_transform(headers, lambda h: lower(trim(h)))), '|') as header_key from tab)
  select g, header_key, count(*) as merged_from, min(k) as table_index, sum(len(rows)) as n_rows, arg_min(array_to_string(headers, '|'), k) as names from t group by all""", None)
def win_18_tbl_41_consolidate(spark, sf_dir):
    got = sequences.consolidate(tab(spark, sf_dir).withColumns({"g": F.col("k") % 40, "table_index": F.col("k")}), ["g"])
    return got.select("g", "header_key", "merged_from", "table_index", F.size("rows").alias("n_rows"), heads(H()).alias("names"))


# --- texts ----------------------------------------------------------------------------------------------------------


def part(spark, sf_dir, *more):
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("k"), *more)


def ocr(c: str, rules) -> str:
    for p, to in rules:
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return c


RAW_OCR = "'IL' || replace(cast(p_partkey as varchar), '0', 'O') || ' $O5 2O2' || p_size % 10 || ' 1O9.O1 X O5 y 5O.O% GAO' || p_size"


def raw_ocr():
    return F.concat(F.lit("IL"), F.replace(F.col("p_partkey").cast("string"), F.lit("0"), F.lit("O")), F.lit(" $O5 2O2"), (F.col("p_size") % 10).cast("string"), F.lit(" 1O9.O1 X O5 y 5O.O% GAO"), F.col("p_size").cast("string"))



@query(f"select p_partkey as k, {ocr(RAW_OCR, text.OCR_RULES[:8])} as fixed from part", None)
def str_05_ocr_some(spark, sf_dir):
    return part(spark, sf_dir, text.fix_ocr(raw_ocr(), 8).alias("fixed"))


@query(of_tab("array_to_string(list_transform(headers, lambda h: lower(trim(h))), '|') as names"), None)
def str_02_headers(spark, sf_dir):
    return tab(spark, sf_dir).select("k", heads(text.headers(H())).alias("names"))


DASHED = "'__' || p_name || '--' || p_brand || '...' || chr(9) || '  x' || chr(10) || chr(10) || chr(10) || ' 2O24 '"


@query(f"""select p_partkey as k, trim({ocr("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + DASHED + ", '_+', ' ', 'g'), '-+', ' ', 'g'), '[.]+', '.', 'g'), '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{2,}', chr(10), 'g')", text.OCR_RULES)}, ' ' || chr(10)) as cleaned from part""", None)
def str_07_clean_dashes(spark, sf_dir):
    raw = F.concat(F.lit("__"), F.col("p_name"), F.lit("--"), F.col("p_brand"), F.lit("...\t  x\n\n\n 2O24 "))
    return part(spark, sf_dir, text.clean(raw, True).alias("cleaned"))


@query("select p_partkey as k, 'Al be ce ' || string_split(p_name, ' ')[1] || ' of ' || p_size || ' de' as said from part", None)
def str_08_repeats(spark, sf_dir):
    n = F.col("p_partkey") % 4 + 1
    said = F.concat(F.lit("Al be ce "), F.when(n > 2, F.lit("al BE ce ")).otherwise(""), F.repeat(F.concat(F.get(F.split("p_name", " "), 0), F.lit(" ")), n.cast("int")), F.lit("of "), F.repeat(F.concat("p_size", F.lit(" ")), n.cast("int")), F.lit("de"), F.when(n > 1, " DE").otherwise(""))
    return part(spark, sf_dir, text.drop_repeats(said).alias("said"))


@query("select p_partkey as k, trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g')) || ' z' as said from part", None)
def str_09_sanitize(spark, sf_dir):
    return part(spark, sf_dir, text.sanitize(F.concat(F.lit("\x00 "), F.col("p_name"), F.lit("\x1f\n\t "), F.col("p_brand"), F.lit("\x7f\x9f  z\r\n"))).alias("said"))


STATES = (("\\b([A-Z]{2})O{2,}([0-9]+)\\b", "\\100\\2"), ("\\b([A-Z]{2})O([0-9]+)\\b", "\\10\\2"), ("\\b([A-Z]{2}[0-9]+)O{2,}\\b", "\\100"), ("\\b([A-Z]{2}[0-9]+)O\\b", "\\10"), ("\\b([A-Z]{2}[0-9]+)O([0-9]+)\\b", "\\10\\2"))
CODED = "'Acme ' || p_brand || ' IL' || replace(cast(p_partkey as varchar), '0', 'O') || ' TXOO' || p_size || ' NY' || p_size % 7 || 'O end'"


def coded():
    return F.concat(F.lit("Acme "), F.col("p_brand"), F.lit(" IL"), F.replace(F.col("p_partkey").cast("string"), F.lit("0"), F.lit("O")), F.lit(" TXOO"), F.col("p_size").cast("string"), F.lit(" NY"), (F.col("p_size") % 7).cast("string"), F.lit("O end"))



def states(c: str) -> str:
    for p, to in STATES:
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return c


@query(f"""with s as (select p_partkey as k, {states(CODED)} as said from part) select k, said as codes, trim(regexp_replace(case {' '.join(f"when regexp_matches(said, '{p}') then regexp_replace(said, '{p}', '', 'g')" for p in (*[chr(92) + 'b[A-Z]{2}[0-9]{' + str(n) + '}' + chr(92) + 'b' for n in (5, 4, 3, 2, 1)], chr(92) + 'b[A-Z]{2}[0-9]+' + chr(92) + 'b'))} else said end, '\\s+', ' ', 'g')) as company from s""", None)
def str_10_11_codes(spark, sf_dir):
    return part(spark, sf_dir, text.fix_state_codes(coded()).alias("codes"), text.clean_company(coded()).alias("company"))


NAMED = "'Client: ' || p_brand || chr(10) || 'to ' || p_type || case p_partkey % 3 when 0 then ' Inc. and' when 1 then ' Group' else ' x' end || ' for ' || p_name || ' LLC'"


def named():
    return F.concat(F.lit("Client: "), F.col("p_brand"), F.lit("\nto "), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, " Inc. and").when(F.col("p_partkey") % 3 == 1, " Group").otherwise(" x"), F.lit(" for "), F.col("p_name"), F.lit(" LLC"))



@query(f"select p_partkey as k, array_to_string(list_sort(list_distinct({found_sql(NAMED)})), '|') as names from part", None)
def str_12_companies(spark, sf_dir):
    return part(spark, sf_dir, heads(F.array_sort(text.companies(named()))).alias("names"))


SCORED = "case p_partkey % 4 when 0 then p_brand || ' LLC' when 1 then p_type || ' inc' when 2 then 'a' else p_name || ' (x) LP' end"
suffix = lambda names: f"case when regexp_matches(upper(trim(n)), '\\b({names})\\b') then 0.4 else 0.0 end + case when length(trim(n)) between 3 and 100 then 0.3 else 0.0 end + case when regexp_matches(upper(trim(n)), '^[A-Z0-9&.,''\\- ]+$') then 0.3 else 0.0 end"


@query(f"select k, round({suffix('LLC|LP|LLP|PC|PA')}, 6) as strict, round({suffix('LLC|INC|CORP|LTD|CO|LP|LLP|PC|PA')}, 6) as loose from (select p_partkey as k, {SCORED} as n from part)", None)
def str_13_company_score(spark, sf_dir):
    k = F.col("p_partkey") % 4
    n = F.when(k == 0, F.concat("p_brand", F.lit(" LLC"))).when(k == 1, F.concat("p_type", F.lit(" inc"))).when(k == 2, "a").otherwise(F.concat("p_name", F.lit(" (x) LP")))
    return part(spark, sf_dir, text.company_score(n).alias("strict"), text.company_score(n, False).alias("loose"))


MOVES = "len(list_filter(r, lambda x: regexp_matches(x, '[$] *[0-9,]+([.][0-9]+)?|[0-9]+([.][0-9]+)? *%|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}'))) > 0"


@query(f"{TAB}, r as (select k, unnest(range(0, len(rows))) as i, unnest(rows) as r from tab) select k, i, len(list_filter(r, lambda x: {full('x')})) <= 3 and len({found_sql('array_to_string(r, chr(32))')}) > 0 and not ({MOVES}) as header, {MOVES} as transaction from r", None)
def str_14_rows(spark, sf_dir):
    r = F.col("r")
    return tab(spark, sf_dir).select("k", F.posexplode(R()).alias("i", "r")).select("k", F.col("i").cast("long").alias("i"), text.is_header_row(r).alias("header"), text.is_transaction_row(r).alias("transaction"))


CARRIED = "repeat('Aetna x ', cast(p_partkey % 5 as int)) || repeat('w', cast(p_size as int) * 6) || repeat(' UHC', cast(p_partkey % 3 as int)) || case when p_partkey % 7 = 0 then ' Blue Cross' else '' end"
conf = lambda p: f"least(1.0, least(0.9, 0.5 + 0.1 * len(regexp_extract_all(lower(t), '\\b(?:{p})\\b'))) + case when regexp_matches(lower(t[1:200]), '\\b(?:{p})\\b') then 0.2 else 0.0 end)"


@query(f"""with t as (select p_partkey as k, {CARRIED} as t from part), c as (select k, name, round(conf, 6) as conf from (select k, unnest([{', '.join("'" + n + "'" for n in text.CARRIERS)}]) as name, unnest([{', '.join(f"case when regexp_matches(lower(t), '{chr(92)}b(?:{'|'.join(p)}){chr(92)}b') then {conf('|'.join(p))} end" for p in text.CARRIERS.values())}]) as conf from t) where conf is not null)
  select k, arg_max(name, (conf, name)) as carrier, max(conf) as confidence from t left join c using (k) group by k""", None)
def str_15_carrier_in_text(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.concat(F.repeat(F.lit("Aetna x "), (k % 5).cast("int")), F.repeat(F.lit("w"), F.col("p_size") * 6), F.repeat(F.lit(" UHC"), (k % 3).cast("int")), F.when(k % 7 == 0, " Blue Cross").otherwise(""))
    got = text.carrier_in_text(t)
    return part(spark, sf_dir, got["carrier"].alias("carrier"), got["confidence"].alias("confidence"))


@query("""select p_partkey as k, round(case when x = '' or y = '' then 0.0 when x = y then 1.0 else len(list_filter(string_split(x, ''), lambda c: c <> '' and contains(y, c))) / greatest(length(x), length(y)) end, 6) as score
  from (select p_partkey, case when p_partkey % 9 = 0 then '' else lower(p_brand) end as x, case when p_partkey % 4 = 0 then lower(p_brand) else lower(p_type) end as y from part)""", None)
def str_16_contains(spark, sf_dir):
    k = F.col("p_partkey")
    return part(spark, sf_dir, r6(text.contains_similarity(F.when(k % 9 != 0, F.col("p_brand")), F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.col("p_type")))).alias("score"))


@query("select p_partkey as k, p_brand || case when p_partkey % 2 = 0 then '|page x' else '' end as cells from part", None)
def str_17_noise(spark, sf_dir):
    row = F.array(F.lit(" -- "), F.lit("N/A"), F.col("p_brand"), F.lit("Page 3 of 9"), F.lit("||"), F.lit(None).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "page x").otherwise("page 7"))
    return part(spark, sf_dir, heads(text.drop_noise(row)).alias("cells"))


@query("""select k, v, case k % 5 when 0 then regexp_matches(v, '^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$') when 1 then regexp_matches(v, '^[($-]*[$] *[0-9,]+([.][0-9]+)?[)]?$') when 2 then regexp_matches(v, '^-?[0-9,]+([.][0-9]+)? *%$') when 3 then regexp_matches(v, '^-?[0-9,]+([.][0-9]+)?$') else v <> '' end as fits
  from (select p_partkey as k, case p_size % 4 when 0 then '$' || p_size when 1 then p_size || '%' when 2 then '1/2/' || p_size else cast(p_size as varchar) end as v from part)""", None)
def str_18_pattern(spark, sf_dir):
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    n = s.cast("string")
    v = F.when(s % 4 == 0, F.concat(F.lit("$"), n)).when(s % 4 == 1, F.concat(n, F.lit("%"))).when(s % 4 == 2, F.concat(F.lit("1/2/"), n)).otherwise(n)
    kind = F.when(k == 0, "date").when(k == 1, "currency").when(k == 2, "percentage").when(k == 3, "number").otherwise("text")
    return part(spark, sf_dir, v.alias("v"), F.regexp_like(v, text.pattern_of(kind)).alias("fits"))


@query("select p_partkey as k, case p_partkey % 4 when 0 then p_brand || ';x y;' || p_size when 1 then p_brand || ';x  y;' || p_size when 2 then p_brand || ';x y;' || p_size else array_to_string(string_split(p_brand || ' x ' || p_size, ' '), ';') end as cells from part", None)
def str_20_split_line(spark, sf_dir):
    k, b, s = F.col("p_partkey") % 4, F.col("p_brand"), F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat(b, F.lit("\tx y\t"), s)).when(k == 1, F.concat(b, F.lit(" | x  y |"), s)).when(k == 2, F.concat(b, F.lit("   x y  "), s)).otherwise(F.concat(b, F.lit(" x "), s))
    return part(spark, sf_dir, F.array_join(text.split_line(line), ";").alias("cells"))


@query("select p_partkey as k, p_size * 4 + length(p_brand) > 100 and p_partkey % 3 > 0 as digital from part", None)
def str_22_digital(spark, sf_dir):
    word = F.when(F.col("p_partkey") % 3 == 1, "AGENT").when(F.col("p_partkey") % 3 == 2, "Poli" + "cy").otherwise("none")
    room = F.repeat(F.lit("w"), F.col("p_size") * 4 - F.length(word))
    return part(spark, sf_dir, text.digital_pdf(F.concat(F.lit(" \n"), word, room, F.col("p_brand"), F.lit("  "))).alias("digital"))


@query("select p_partkey as k, array_to_string([p_brand, case when p_partkey % 3 > 0 then p_type else '' end, case when p_partkey % 3 > 1 then '9' else '' end][1 : 1 + p_partkey % 4], '|') || case when p_partkey % 4 = 3 then '|' else '' end as cells from part", None)
def str_23_gaps(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.lit("  "), F.col("p_brand"), F.when(k % 3 > 0, F.concat(F.lit("    "), F.col("p_type"))).otherwise(""), F.when(k % 3 > 1, "     9").otherwise(""))
    return part(spark, sf_dir, heads(text.gap_columns(line, (k % 4 + 1).cast("int"))).alias("cells"))


@query("""select p_partkey as k, case when stem = '' then 'results.csv' else stem || '_results.csv' end as name from (select p_partkey, trim(regexp_replace(regexp_replace(regexp_extract(n, '([^/\\\\]*)$', 1), '(.)[.][^.]*$', '\\1'), '[^\\p{L}\\p{N}._ \\-]', '', 'g')[1:120]) as stem
  from (select p_partkey, case p_partkey % 4 when 0 then 'a/b\\' || p_name || '.final.pdf' when 1 then p_brand || '#§é' || repeat('x', cast(p_size * 5 as int)) when 2 then '' else '***.pdf' end as n from part))""", None)
def snk_07_filename(spark, sf_dir):
    k = F.col("p_partkey") % 4
    n = F.when(k == 0, F.concat(F.lit("a/b\\"), F.col("p_name"), F.lit(".final.pdf"))).when(k == 1, F.concat(F.col("p_brand"), F.lit("#§é"), F.repeat(F.lit("x"), F.col("p_size") * 5))).when(k == 2, "").otherwise("***.pdf")
    return part(spark, sf_dir, text.safe_filename(n).alias("name"))


@query("""select p_partkey as k, coalesce({'pdf': 'pdf', 'docx': 'docx', 'doc': 'docx', 'png': 'image', 'jpeg': 'image', 'xlsx': 'excel', 'xlsm': 'excel'}[e], 'unknown') as format from (select p_partkey, ['pdf', 'docx', 'doc', 'png', 'jpeg', 'xlsx', 'xlsm', 'txt'][1 + p_partkey % 8] as e from part)""".replace("{'pdf'", "map {'pdf'"), None)
def src_17_format(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("PDF", "docx", "doc", "png", "jpeg", "xlsx", "XLSM", "txt"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return part(spark, sf_dir, text.file_format(F.concat(F.lit("/x.y/"), F.col("p_brand"), F.lit(".a."), ext)).alias("format"))


# --- dates and numbers ----------------------------------------------------------------------------------------------

WORDS = [w for words in dates.LABELS.values() for w in words]
LINE = "case p_partkey % 6 when 0 then 'Statement Date' when 1 then 'Paid date' when 2 then 'PERIOD' when 3 then 'none' when 4 then 'Run date and invoice' else 'Due date' end || repeat('.', cast(p_size * 2 as int)) || ' 03/04/2024 effective'"


def dated_line():
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Statement Date").when(k == 1, "Paid date").when(k == 2, "PERIOD").when(k == 3, "none").when(k == 4, "Run date and invoice").otherwise("Due date")
    return F.concat(name, F.repeat(F.lit("."), F.col("p_size") * 2), F.lit(" 03/04/2024 effective"))


LABELLED = f"""l as (select p_partkey as k, {LINE} as line from part), w as (select unnest([{', '.join(f"'{w}'" for w in WORDS)}]) as w), c as (select k, w, strpos(lower(line), w) as p, strpos(line, '03/04/2024') as pl from l cross join w),
  own as (select k, max(round(0.8 + 0.2 * (1 - least(1.0, (pl - p) / 100)), 6)) as confidence, arg_max(w, (round(0.8 + 0.2 * (1 - least(1.0, (pl - p) / 100)), 6), w)) as label from c where p > 0 and p < pl group by k)"""


@query(f"with {LABELLED} select k, coalesce(confidence, 0.2) as confidence, coalesce(label, 'inferred') as label from l left join own using (k)", None)
def dat_04_label(spark, sf_dir):
    got = dates.label(dated_line(), F.lit("03/04/2024"))
    return part(spark, sf_dir, got["confidence"].alias("confidence"), got["label"].alias("label"))


@query(f"select p_partkey as k, case {' '.join(f'''when regexp_matches(said, '{'|'.join(w)}') then '{n}' ''' for n, w in dates.LABELS.items())} else 'unknown' end as kind from (select p_partkey, lower({LINE}) as said from part)", None)
def dat_05_kind(spark, sf_dir):
    return part(spark, sf_dir, dates.date_type(dated_line()).alias("kind"))


@query("""select p_partkey as k, p_partkey % 4 <> 3 and (p_size % 3 = 0 or p_size % 3 = 2 and p_partkey % 2 = 0) as valid from part""", None)
def dat_08_context(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    date = F.when(k % 4 == 3, "13/45/2024").otherwise("3/4/2024")
    context = F.when(s % 3 == 0, "Statement no 12345").when(s % 3 == 1, "policy id: 123456").otherwise(F.when(k % 2 == 0, "hello there").otherwise("paid $ 5.00"))
    return part(spark, sf_dir, dates.valid_context(date, context).alias("valid"))


@query(f"""with {LABELLED} select k, case when label is not null then greatest(0.8, confidence) when k % 4 = 0 then 0.6 when k % 4 = 1 then 0.5 else 0.3 end as confidence, case when label is not null then label when k % 4 = 0 then 'payment' when k % 4 = 1 then 'date' else 'inferred' end as label from l left join own using (k)""", None)
def dat_09_context_label(spark, sf_dir):
    k = F.col("p_partkey") % 4
    got = dates.context_label(dated_line(), F.lit("03/04/2024"), F.when(k == 0, "see check date below").when(k == 1, "As of today").otherwise("x"))
    return part(spark, sf_dir, got["confidence"].alias("confidence"), got["label"].alias("label"))


@query("""with d as (select p_partkey as k, unnest(range(0, 9)) as i, p_size as s from part), e as (select k, i, 'd' || (i * s) % 5 as date, (i * 7 + s) % 10 / 10.0 as c from d), f as (select k, date, max(c) as c, arg_min(i, (-c, i)) as i from e group by all)
  select k, string_agg(date || ':' || c, ',' order by c desc, i) as best from (select * from f qualify row_number() over (partition by k order by c desc, i) <= 3) group by k""", None)
def srt_09_13_set_06_best_dates(spark, sf_dir):
    s = F.col("p_size")
    found = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(((i * 7 + s) % 10 / 10.0).alias("confidence"), F.concat(F.lit("d"), (i * s % 5).cast("string")).alias("date")))
    return part(spark, sf_dir, F.array_join(F.transform(dates.best_dates(found, 3), lambda x: F.concat_ws(":", x["date"], x["confidence"])), ",").alias("best"))


@query("""select p_partkey as k, case p_partkey % 5 when 0 then '$' || format('{:,}', p_size * 1000) || '.50' when 1 then '-$' || p_size || '.00' when 2 then p_size || '.5%' when 3 then 'n' || p_size else cast(p_size as varchar) end as said from part""", None)
def mth_13_format(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" $ "), n, F.lit("000.5 "))).when(k == 1, F.concat(F.lit("("), n, F.lit(")"))).when(k == 2, F.concat(n, F.lit(".50 %"))).when(k == 3, F.concat(F.lit("n"), n)).otherwise(n)
    return part(spark, sf_dir, tb.format_number(raw).alias("said"))


@query("""select p_partkey as k, case when n <= 10 then 'small' when n <= 50 then 'medium' when n <= 100 then 'large' else 'max' end as size, case when n <= 10 then 300 when n <= 50 then 600 when n <= 100 then 1200 else 1800 end as seconds, length(p_name) // 4 as text_tokens, cast(floor(n * 750 * case when p_partkey % 2 = 0 then 0.3 else 1.0 end) as bigint) as page_tokens
  from (select *, p_partkey % 120 as n from part)""", None)
def mth_19_20_sizes(spark, sf_dir):
    n = F.col("p_partkey") % 120
    size = tb.size_class(n)
    return part(spark, sf_dir, size["size"].alias("size"), size["seconds"].alias("seconds"), text_tokens(), tb.page_tokens(n, F.col("p_partkey") % 2 == 0).alias("page_tokens"))


def text_tokens():
    return tb.text_tokens(F.col("p_name")).alias("text_tokens")


@query("""select k, case when n <= 8 then array_to_string(range(0, n), ',') else '0,1,2,' || cast(cast(floor(3 + 1 * (n - 6) / 3.0) as int) as varchar) || ',' || cast(cast(floor(3 + 2 * (n - 6) / 3.0) as int) as varchar) || ',' || (n - 3) || ',' || (n - 2) || ',' || (n - 1) end as pages from (select p_partkey as k, p_partkey % 90 as n from part)""", None)
def srt_08_pages(spark, sf_dir):
    got = tb.representative_pages((F.col("p_partkey") % 90).cast("int"), 8)
    return part(spark, sf_dir, F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("pages"))


@query("""select k, n - n % greatest(m, 1) as x, case when n = 0 then 0 else (n + m - 1) // m end as chunks, n * l + greatest(n - case when n = 0 then 0 else (n + m - 1) // m end, 0) as characters from (select p_partkey as k, p_partkey % 13 as n, p_size % 9 + 1 as l, greatest(21 // (p_size % 9 + 2), 1) as m from part)""", None)
def win_14_15_chunks(spark, sf_dir):
    """Lines of one length, up to 20 characters a chunk."""
    n, l = (F.col("p_partkey") % 13).cast("int"), F.col("p_size") % 9 + 1
    got = tb.chunk_lines(F.array_repeat(F.repeat(F.lit("w"), l), n), 20)
    m = F.greatest(F.floor(F.lit(21) / (l + 1)), F.lit(1))
    return part(spark, sf_dir, (n - n % m).alias("x"), F.size(got).alias("chunks"), F.aggregate(got, F.lit(0), lambda acc, c: acc + F.length(c)).alias("characters"))


@query("""select k, array_to_string(list_transform(range(0, n, 7), lambda a: a || '-' || (least(a + 7, n) - 1)), ',') as ranges from (select p_partkey as k, p_partkey % 40 as n from part)""", None)
def win_16_ranges(spark, sf_dir):
    got = tb.page_ranges((F.col("p_partkey") % 40).cast("int"), 7)
    return part(spark, sf_dir, F.array_join(F.transform(got, lambda x: F.concat_ws("-", x["first"], x["last"])), ",").alias("ranges"))
