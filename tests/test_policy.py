"""Policies, costs, rollups, filters, dates and streams on small cases."""

import pytest
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.functions import dates, text
from gridgauge.operators import boxes, cost, filters, policy, rollup, sequences
from gridgauge.sources import payloads


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [(" HIGH ", "high"), ("weird", "unconfirmed"), (None, "unconfirmed")])
def test_tier(spark, raw, want):
    assert one(spark, policy.tier(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("row", "want"),
    [((False, False, 0, 0, 2), "unevaluated"), ((True, True, 3, 3, 0), "complete_failure"), ((True, False, 0, 2, 0), "missing_f1"), ((True, False, 1, 2, 0), "partial"), ((True, False, 2, 2, 3), "partial"), ((True, False, 2, 2, 2), "success")],
)
def test_reliability(spark, row, want):
    assert one(spark, policy.reliability(*map(F.lit, row))) == want


@pytest.mark.parametrize(("state", "value", "strict", "zero"), [("missing_f1", None, None, 0.0), ("success", 0.0, 0.0, 0.0), ("partial", float("nan"), None, 0.0), ("success", None, None, None), ("unevaluated", None, None, None)])
def test_metric_value(spark, state, value, strict, zero):
    df = spark.createDataFrame([(state, value, state != "unevaluated", False)], "reliability string, f1_score double, has_extraction boolean, is_transient_failure boolean")
    assert df.select(policy.metric_value("f1_score").alias("x")).first().x == strict
    assert df.select(policy.metric_value("f1_score", "zero_impute_failed").alias("x")).first().x == zero
    gone = df.withColumn("is_transient_failure", F.lit(True))
    assert gone.select(policy.metric_value("f1_score", "zero_impute_failed").alias("x")).first().x is None


@pytest.mark.parametrize(("tool", "pages", "tokens", "want"), [("gpt5", 2, (None, None), 0.038), ("mistral", 3, (1000, 500), 0.011), ("aws_textract", 3, (None, None), 0.045), ("other", 3, (5, 5), 0.0), ("gpt5", None, (0, 0), 0.0)])
def test_cost(spark, tool, pages, tokens, want):
    df = spark.createDataFrame([(tool, pages, *tokens)], "tool_name string, page_count int, input_tokens int, output_tokens int")
    assert cost.with_cost(df).first().cost_usd == pytest.approx(want)


def test_quantiles(spark):
    df = spark.createDataFrame([("t", float(v)) for v in (1, 2, 3, 10)], "tool string, v double")
    r = rollup.five_numbers(["tool"], df, F.col("v")).first()
    assert (r.min, r.q1, r.median, r.q3, r.max, r.n) == (1, 2, 3, 3, 10, 4)


def test_carrier_and_names(spark):
    for name, want in (("aetna_statement_2024.pdf", "Aetna"), ("statement-01.pdf", "Unknown"), ("", "Unknown")):
        assert one(spark, text.carrier(F.lit(name))) == want
    for name, want in (("a/b c?.pdf", "b c_results.csv"), ("???.pdf", "results.csv"), (None, "results.csv"), ("x" * 200 + ".pdf", "x" * 120 + "_results.csv")):
        assert one(spark, text.safe_filename(F.lit(name).cast("string"))) == want
    assert one(spark, text.clean_company(F.lit("MDOO500 Acme LLC"))) == "Acme LLC"
    assert one(spark, text.file_format(F.lit("/a/b.XLSX"))) == "excel"
    assert one(spark, text.drop_repeats(F.lit("total total for you for you now"))) == "total for you now"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2025-03-15 thr 2025-04-14", "2025-03-15"), ("March 15, 2025 through April 14, 2025", "2025-03-15"), ("03/15/2025 - 04/14/2025", "2025-03-15"), ("no date", "no date"), ("Period: Mar 3, 2024", "2024-03-03"), ("01/02/49", "2049-01-02"), ("01/02/51", "1951-01-02")],
)
def test_statement_date(spark, raw, want):
    assert one(spark, dates.statement_date(F.lit(raw))) == want


def test_date_labels(spark):
    line = F.lit("Statement Date: 03/15/2025")
    got = one(spark, dates.label(line, F.lit("03/15/2025")))
    assert got.label in ("statement date", "statement") and got.confidence > 0.9
    assert one(spark, dates.label(F.lit("x 03/15/2025"), F.lit("03/15/2025"))).label == "inferred"
    assert one(spark, dates.date_type(F.lit("Due Date"))) == "due"
    assert one(spark, dates.valid_context(F.lit("03/15/2025"), F.lit("policy no: 123456"))) is False
    ds = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(d).alias("date")) for c, d in ((0.5, "a"), (0.9, "a"), (0.7, "b"))])
    assert [(x.confidence, x.date) for x in one(spark, dates.best_dates(ds, 5))] == [(0.9, "a"), (0.7, "b")]


def test_tools():
    assert dims.check_tools("all") == list(dims.TOOLS)
    with pytest.raises(ValueError):
        dims.check_tools(["nope"])
    with pytest.raises(ValueError):
        dims.check_tier("nope")


def test_company_rows(spark):
    rows = spark.createDataFrame([(1, 0, ["Head", "1"]), (1, 1, ["Acme Group"]), (1, 2, ["a", "$5"]), (1, 3, ["b", "$6"])], "t long, i int, cells array<string>")
    got = [r.cells for r in sequences.with_company_column(rows, ["t"], "i", "cells").orderBy("i").collect()]
    assert got == [["", "Head", "1"], ["Acme Group", "Acme Group"], ["Acme Group", "a", "$5"], ["Acme Group", "b", "$6"]]
    got = [r.cells for r in sequences.with_company_column(rows, ["t"], "i", "cells", keep_headers=True).orderBy("i").collect()]
    assert got == [["Head", "1"], ["Acme Group"], ["Acme Group", "a", "$5"], ["Acme Group", "b", "$6"]]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate((0, 15, 30, 45, 100))], "p long, i int, y double")
    assert [r.cluster for r in sequences.clusters_by_running_mean(rows, ["p"], "y", 20).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert [r.cluster for r in sequences.clusters_by_gap(rows, ["p"], "y", 20).orderBy("i").collect()] == [0, 0, 0, 0, 1]


def test_regions(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["Name    Amount", "Alpha    12", "x", "lonely    line here"])], "p long, i int, t string")
    assert [tuple(r)[1:] for r in sequences.text_regions(lines, ["p"], "i", "t").collect()] == [(0, 1, 2)]
    cells = spark.createDataFrame([(1, r, c, v) for r, c, v in ((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, ""), (0, 0, ""), (3, 3, ""))], "p long, r int, c int, v string")
    assert tuple(sequences.grown_region(cells, ["p"]).first()) == (1, 1, 1, 2, 2)


def test_boxes(spark):
    box = lambda i, x, y, w=10.0: (1, i, x, y, x + w, y + w)
    schema = "page long, id long, x0 double, y0 double, x1 double, y1 double"
    p, t = spark.createDataFrame([box(1, 0.0, 0.0), box(2, 195.0, 195.0), box(3, 500.0, 0.0)], schema), spark.createDataFrame([box(7, 1.0, 0.0), box(8, 196.0, 196.0), box(9, 900.0, 0.0)], schema)
    m = boxes.match(p, t)
    assert sorted((r.pred, r.true) for r in m.collect()) == [(1, 7), (2, 8)]
    d = boxes.detection(p, t, m).first()
    assert (d.tp, d.fp, d.fn) == (2, 1, 1)
    over = spark.createDataFrame([box(1, 0.0, 0.0, 100.0), box(2, 5.0, 5.0), box(3, 300.0, 300.0)], schema)
    assert sorted(r.id for r in boxes.suppress(over).collect()) == [1, 3]


def test_filters(spark, sf_dir):
    from gridgauge.plans.registry import slots_of

    slots = slots_of(spark, sf_dir)
    assert filters.SlotFilter().apply(slots) is slots
    n = {s: filters.SlotFilter(status=s).apply(slots).count() for s in dims.RELIABILITY}
    assert sum(n.values()) == slots.count()


def test_payload_outcome(spark):
    raw = spark.createDataFrame([('{"success":false,"error":"HTTP 529"}',), ('{"tables":[],"usage":{"input_tokens":7,"output_tokens":0}}',), ("bad",), (None,)], "raw_output string")
    got = payloads.outcome(raw).collect()
    assert [(r.failure_reason, r.is_transient_failure, r.input_tokens, r.output_tokens) for r in got] == [("rate_limit", True, None, None), (None, False, 7, None), (None, False, None, None), (None, False, None, None)]


def test_recompute(spark):
    er = spark.createDataFrame([(1, "mistral", 0, 9.0, '{"usage":{"input_tokens":1000,"output_tokens":500}}'), (1, "mistral", 1, 9.0, None), (1, "gpt5", 0, 5.0, None)], "document_id long, tool_name string, table_index int, cost_usd double, raw_output string")
    got = {(r.tool_name, r.table_index): r.cost_usd for r in cost.recompute(er, spark.createDataFrame([(1, 3)], "document_id long, page_count int"), "mistral").collect()}
    assert got == {("mistral", 0): pytest.approx(0.011), ("mistral", 1): 0.0, ("gpt5", 0): 5.0}


def test_sinks(spark, tmp_path):
    from gridgauge.operators import sinks

    df = spark.createDataFrame([("a", 'q"x,'), (None, "")], "x string, y string")
    sinks.csv(df.coalesce(1), str(tmp_path / "c"))
    said = "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))
    assert said.splitlines()[:2] == ["x,y", 'a,"q""x,"']
    assert one(spark, sinks.as_csv_text(F.array(F.lit("a"), F.lit("b,c")), F.array(F.array(F.lit("1"), F.lit('"'))))) == 'a,"b,c"\n1,""""'
