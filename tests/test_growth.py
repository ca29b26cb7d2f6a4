"""Steps whose work or memory must not gather in one task, or be done again for each row."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from gridgauge.functions import dates
from gridgauge.operators import choice, metrics, rollup, store
from gridgauge.plans import QUERIES, values
from gridgauge.plans.registry import rows_of, slots_of
from gridgauge.sources import bridge, excel, markdown


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sort_by_a_text_of_few_values(spark):
    """Nearly all rows have one text: they are in one order, and in ranges of several partitions."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.when(F.col("id") % 1000 == 0, "late").alias("reason"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = choice.as_text(df, "reason")
        assert [r.k for r in got.where("reason is null").collect()] == sorted(r.k for r in df.where("reason is null").collect())
        sizes = [len(p) for p in got.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_rollup_is_dealt_before_it_is_sorted(spark, sf_dir):
    """No aggregate of texts stands below the rollup's shuffle, where it would sort all rows for nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        lines = plan(rollup.merge_rows(rows_of(spark, sf_dir))).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = next(k for k, x in enumerate(lines) if "Exchange" in x)
    assert not any("Aggregate" in x for x in lines[first:])


def test_what_a_document_says_is_found_once(spark, sf_dir):
    """The carrier's patterns run below the explode of the seven tools."""
    lines = plan(slots_of(spark, sf_dir).select("document_id", "tool_name", "carrier")).split("\n")
    explode = next(k for k, x in enumerate(lines) if "Generate explode" in x and "pymupdf" in x)
    assert [k > explode for k, x in enumerate(lines) if "regexp_replace" in x and "Project" in x] == [True]


def test_only_formats_of_a_dates_shape_are_tried(spark):
    """Each format is behind a check of the text's shape, which every text fits that it can read; the text is cleaned once."""
    text = plan(spark.createDataFrame([("3/4/2024",)], "t string").select(dates.parse(F.col("t"))))
    assert text.count("RLIKE") > len(dates.FORMATS) and text.count("regexp_replace") < 10
    for form, said in (("M/d/yyyy", "0003/4/+12024"), ("MMMM yyyy", "May -2024"), ("d MMM yyyy", "07 jan 2024"), ("d.M.yyyy", "31.12.2024")):
        assert re.search(dates.shape(form), said), (form, said)
    assert not re.search(dates.shape("M/d/yyyy"), "13/4/2024") and not re.search(dates.shape("yyyy-M-d"), "3-4-2024")


def test_runs_are_counted_in_one_sort_of_bounded_tasks(spark, sf_dir, monkeypatch):
    """One sort for lines and tables; more rows are more tasks, not larger ones."""
    assert len(re.findall(r"\bSort \[", plan(bridge.extractions(spark, sf_dir)))) == 1
    few = bridge.tasks(bridge.load(spark, sf_dir, "lineitem"))
    monkeypatch.setattr(bridge, "ROWS", 500)
    assert bridge.extractions(spark, sf_dir).rdd.getNumPartitions() > few


def test_lines_of_tables_are_dealt_by_number(spark, sf_dir):
    """Spark's sizing by bytes put all lines with a pipe into one task below a union."""
    assert "REPARTITION_BY_NUM" in plan(markdown.tables(bridge.load(spark, sf_dir, "documents")))


def test_a_delete_does_not_move_what_stays(spark, tmp_path, monkeypatch):
    """Rows are rebalanced where a change adds some, not where it only takes some away."""
    t = store.Table(spark, f"{tmp_path}/t", buckets=4).create(spark.range(100).select(F.col("id").alias("document_id")))
    hints, kind = [], type(t.read())
    own = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, *x: hints.append(x) or own(self, *x))
    t.delete(spark.createDataFrame([(3,), (50,)], "document_id long"), ["document_id"])
    assert not hints and sorted(r[0] for r in t.read().collect()) == [k for k in range(100) if k not in (3, 50)]


def test_places_lines_and_grids_in_one_shuffle(spark, sf_dir):
    """Cells are dealt by their table once, not again by place and by row."""
    assert not re.search(r"hashpartitioning\([^)]*\brow#", plan(QUERIES["src_09_tbl_09_10_blocks"](spark, sf_dir)))


def test_small_workbooks_fill_several_partitions(tmp_path):
    for k in range(4):
        with open(tmp_path / f"{k}.xlsx", "wb") as f:
            f.truncate(3 << 20)
    assert len(excel.Reader({"path": str(tmp_path)}).partitions()) == 2


def test_likenesses_one_pair_at_a_time():
    """Cells of a batch aren't Python's all at once."""
    a, b = (pa.array([[["x", "y"]], [["p"]]] * n, pa.list_(pa.list_(pa.string()))) for n in (2, 2))
    assert metrics.likenesses(a, b) == [1.0] * 4


def test_parts_are_dealt_over_tasks(spark, sf_dir):
    """A small file's rows are several tasks' work."""
    assert values.parts(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
