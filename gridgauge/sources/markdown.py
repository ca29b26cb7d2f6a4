"""SRC-16: pipe tables in Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.functions import text


def tables(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, table_index, line, headers, rows) of all tables with a row.

    A run of lines with a pipe is a table; its first line is the header, whose blank cells go; separator lines
    and empty rows go.  What stands before the first and after the last pipe of a line is no cell.  Only lines
    with a pipe leave the scan; runs are found by position less rank.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line")).select("id", "pos", text.strip(F.col("line")).alias("line"))
    # As many tasks as the session's shuffles have: lines are short and alike, so that sizes in bytes say little of the work on them.
    piped = lines.where(F.col("line").contains("|")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    runs = piped.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    got = runs.groupBy("id", "run").agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    cells = lambda x: F.transform(F.slice(F.split(x, r"\|"), 2, F.greatest(F.size(F.split(x, r"\|")) - 2, F.lit(0))), text.strip)
    body = F.filter(F.slice("lines", 2, F.size("lines")), lambda x: ~x["line"].rlike(r"^\|---|^\| ---|^[|\-: ]*$"))
    rows = F.filter(F.transform(body, lambda x: cells(x["line"])), lambda r: F.exists(r, lambda c: c != ""))
    heads = F.filter(cells(F.get("lines", 0)["line"]), lambda c: c != "")
    got = got.select("id", "at", heads.alias("headers"), rows.alias("rows")).where(F.size("rows") > 0)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    return got.select(F.col("id").alias(id_col), nth.alias("table_index"), F.col("at").alias("line"), "headers", "rows")


SQL = """md_line as (select doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as pos, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(13)) as line from documents),
md_run as (select *, pos - row_number() over (partition by doc_id order by pos) as run from md_line where contains(line, '|')),
md_cell as (select doc_id, run, pos, min(pos) over (partition by doc_id, run) as first_pos, line, list_transform(string_split(line, '|')[2:-2], lambda x: trim(x)) as cells from md_run),
md_row as (select doc_id, first_pos, pos, cells from md_cell where pos > first_pos and not regexp_matches(line, '^\\|---|^\\| ---|^[|\\-: ]*$') and list_sum(list_transform(cells, lambda x: length(x))) > 0),
md_table as (select h.doc_id, h.first_pos, list_filter(h.cells, lambda x: x <> '') as headers, r.rows, row_number() over (partition by h.doc_id order by h.first_pos) - 1 as table_index
  from md_cell h join (select doc_id, first_pos, list(cells order by pos) as rows from md_row group by all) r on r.doc_id = h.doc_id and r.first_pos = h.first_pos where h.pos = h.first_pos)"""
