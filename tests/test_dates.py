"""Each of the reference's date patterns on a line of its own."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridgauge.functions import dates

LINES = [
    ("on 12/31/2024 paid", "12/31/2024"), ("on 12-31-24 paid", "12-31-24"), ("on 2024-12-31 paid", "2024-12-31"), ("on December 31, 2024 paid", "December 31, 2024"),
    ("on Dec. 31, 2024 paid", "Dec. 31, 2024"), ("on 31/12/2024 paid", "31/12/2024"), ("on 12 / 31 / 2024 paid", "12 / 31 / 2024"), ("on December 31 2024 paid", "December 31 2024"),
    ("on Dec 31 2024 paid", "Dec 31 2024"), ("on 31 December 2024 paid", "31 December 2024"), ("on 31 Dec. 2024 paid", "31 Dec. 2024"), ("Date12/31/2024Total", "12/31/2024"),
    ("paidDecember31,2024Total", "December31,2024"), ("paidDec31,2024Total", "Dec31,2024"), ("StatementDate12/31/2024", "12/31/2024"), ("StatementDate31-12-2024", "31-12-2024"),
    ("PaymentDate31/12/2024", "31/12/2024"), ("PaymentDate12-31-2024", "12-31-2024"), ("Total10012/31/2024", "12/31/2024"), ("paidDec.31,2024Total", "Dec.31,2024"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(LINES, "line string, want string")
    return {r.line: r for r in df.select("line", dates.find(F.col("line")).alias("dates"), dates.parse(F.col("want")).alias("day")).collect()}


@pytest.mark.parametrize(("line", "want"), LINES)
def test_find(found, line, want):
    assert want in found[line].dates and found[line].day == datetime.date(2024, 12, 31)
