"""Files that tasks write: whole, hidden until moved, the same when done again."""

import os

from pyspark.sql import functions as F

from gridgauge.operators import sinks
from gridgauge.sources import payloads


def test_files_of_all_rows(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(200).repartition(7).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("said"))
    name = F.concat(F.col("id").cast("string"), F.lit(".pdf"))
    for _ in range(2):  # done again, nothing changes
        assert sinks.files(df, name, F.col("said"), at) == 200
        got = {os.path.basename(r.path): bytes(r.content) for r in payloads.pdf_files(spark, at).collect()}
        assert got == {f"{k}.pdf": b"x" * k for k in range(200) if k % 3}  # the source leaves empty files out
    assert sorted(os.listdir(at)) == sorted(f"{k}.pdf" for k in range(200))
    assert os.path.getsize(f"{at}/3.pdf") == 0  # null is empty


def test_files_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id long, said string")
    assert sinks.files(df, F.col("id"), F.col("said"), str(tmp_path / "none")) == 0
