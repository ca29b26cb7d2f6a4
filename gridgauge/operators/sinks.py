"""SNK-01 to SNK-08: writes that a folder or table receives in parallel, a part for each task."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.sources.excel import place


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-01 to SNK-04, SNK-06: with header, null and empty as nothing, quotes doubled."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-06."""
    df.write.mode(mode).json(path)


def files(df: DataFrame, name: Column, content: Column, path: str) -> int:
    """A file in the shared folder ``path`` for each row; returns how many.  Tasks write under a hidden name and move the whole file, so one that is done again leaves no half."""

    def write(batches):
        fs, root = place(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for said, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hidden = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    out.write(data)
                fs.move(hidden, f"{root}/{said}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = df.select(name.cast("string").alias("name"), F.coalesce(content.cast("binary"), F.lit(b"")).alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def run_rows(runs: DataFrame) -> DataFrame:
    """SNK-08: of runs (document_id, tool_name, processing_time_ms, cost_usd, tables, failure_reason, is_transient_failure) one row for each table; time and cost stand on the first.  A run without tables has one row."""
    t = runs.select("*", F.posexplode_outer(F.when(F.size("tables") > 0, F.col("tables"))).alias("pos", "t"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return t.select("document_id", "tool_name", F.coalesce("pos", F.lit(0)).alias("table_index"), "t.headers", F.coalesce("t.rows", tb.no_rows()).alias("rows"), F.when(first, F.col("processing_time_ms")).otherwise(0).alias("processing_time_ms"), F.when(first, F.col("cost_usd")).otherwise(0.0).alias("cost_usd"), "failure_reason", "is_transient_failure")


def as_csv_text(headers, rows):
    """SNK-05: a table as one CSV text."""
    q = lambda x: F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = lambda r: F.array_join(F.transform(r, lambda x: q(F.coalesce(x, F.lit("")))), ",")
    return F.array_join(F.transform(F.concat(F.array(headers), rows), line), "\n")
