"""Queries over workbooks that Spark has written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridgauge.plans.registry import folder, query
from gridgauge.sources import bridge, excel


def cell(kind: str, value):
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))


@query("""with p as (select *, row_number() over (partition by p_brand, p_partkey // 20000, p_size % 3 order by p_partkey) - 1 as i from part)
  select replace(p_brand, '#', '_') || '_' || p_partkey // 20000 as workbook, 'Table_' || (p_size % 3 + 1) as sheet, i as row, 's:' || p_name || ',n:' || p_partkey || ',b:' || (p_size > 20) || case when p_partkey % 4 = 0 then '' else ',s:<&"' || p_type end as cells from p""", None)
def src_15_snk_05_workbooks(spark, sf_dir):
    """A workbook for each brand and 20,000 parts with a sheet for each kind of size, written and read back."""
    at = folder(spark)
    p = bridge.load(spark, sf_dir, "part").withColumn("sheet_index", F.col("p_size") % 3).withColumn("workbook", F.concat_ws("_", "p_brand", F.floor(F.col("p_partkey") / 20_000)))
    p = p.withColumn("row", F.row_number().over(Window.partitionBy("workbook", "sheet_index").orderBy("p_partkey")) - 1)
    note = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('<&"'), "p_type"))
    cells = F.array(cell("s", F.col("p_name")), cell("n", F.col("p_partkey")), cell("b", F.col("p_size") > 20), cell("s", note))
    excel.write(p.select("workbook", F.concat(F.lit("Table_"), (F.col("sheet_index") + 1).cast("string")).alias("sheet"), "sheet_index", "row", cells.alias("cells")), at)
    back = excel.read(spark, at)
    said = F.array_join(F.transform("cells", lambda c: F.concat(c["kind"], F.lit(":"), c["value"])), ",")
    return back.select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("workbook"), "sheet", F.col("row").cast("long").alias("row"), said.alias("cells"))


@query("""select o_orderkey // 500 as workbook, o_orderkey % 4 as sheet, o_orderkey % 500 as row, c as col, cast(o_orderdate as date) as date
  from orders, (select unnest([0, 2]) as c) where o_orderkey % 4 < 3 and o_custkey % 5 <> 0""", None)
def src_21_dates(spark, sf_dir):
    """Dates of the first three of four sheets: in texts, and as numbers that a format makes dates."""
    at = folder(spark)
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    cells = F.array(cell("s", F.concat(F.lit("Paid on "), F.date_format(d, "MM/dd/yyyy"))), cell("n", F.floor("o_totalprice")), cell("d", F.date_format(d, "yyyy-MM-dd")))
    none = F.array(cell("s", F.lit("no date")))
    rows = bridge.load(spark, sf_dir, "orders").select(F.floor(k / 500).cast("string").alias("workbook"), (k % 4).cast("string").alias("sheet"), (k % 4).alias("sheet_index"), (k % 500).alias("row"), F.when(F.col("o_custkey") % 5 != 0, cells).otherwise(none).alias("cells"))
    # A workbook whose first rows lack a sheet has fewer sheets before it: every sheet gets a row behind the others.
    marks = rows.select("workbook").distinct().select("workbook", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("workbook", F.col("i").cast("string").alias("sheet"), F.col("i").cast("long").alias("sheet_index"), F.lit(1000).cast("long").alias("row"), none.alias("cells"))
    excel.write(rows.unionByName(marks), at)
    got = excel.dated(excel.read(spark, at, 3))
    return got.select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).cast("long").alias("workbook"), F.col("sheet").cast("long").alias("sheet"), F.col("row").cast("long").alias("row"), "col", "date")
