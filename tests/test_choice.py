"""Choices among candidates and the tool registry."""

import pytest
from pyspark.sql import functions as F

from gridgauge.operators import choice


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs))


def test_values(spark):
    assert [tuple(x) for x in one(spark, choice.typed_values(F.lit("on 03/15/2025 paid $5.00, 12% of $5.00 and 7")))] == [("03/15/2025", "date"), ("$5.00", "currency"), ("12%", "percentage"), ("7", "number")]
    assert one(spark, choice.value_priority(arr("x", "$5", "7", "y"), arr("^x$"), arr("7"))) == ["x", "7", "$5", "y"]
    assert one(spark, choice.column_score(F.lit("$5.00"), F.lit("currency"), F.lit(r"^\$"), arr("$7.00"))) == 100


def test_headers(spark):
    assert one(spark, choice.header_score(arr("Premium date", None, "x"))) == 3.0
    t = spark.createDataFrame([(1, 0, ["12", "$5"], [["a"]]), (1, 1, ["Premium", "Group"], [["a"]]), (1, 2, ["Premium", "Group "], [["a"]])], "doc long, table_index int, headers array<string>, rows array<array<string>>")
    assert choice.best_header_table(t, ["doc"]).first().headers == ["Premium", "Group"]
    assert "no rows" in one(spark, choice.structure_faults(arr("a"), F.array().cast("array<array<string>>")))


def test_enhance(spark):
    rows = [[f"item{k}", "(5.00)", "x"] for k in range(6)] + [["Total for group", "", ""]]
    t = spark.createDataFrame([(1, ["a", "b", "c"], rows), (2, ["a"], [])], "doc long, headers array<string>, rows array<array<string>>")
    got = {r.doc: r.rows for r in choice.enhance(t, ["doc"]).collect()}
    assert got[1] == [[f"item{k}", "-$5.00", "x"] for k in range(6)] and got[2] == []


def test_tools(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def read(content):
        if content == b"bad":
            raise ConnectionError("Connection refused")
        return '{"tables":[{"headers":["h"],"rows":[["c"]]}]}'

    with pytest.raises(ValueError):
        choice.register("nope", read)
    choice.register("docling", read)
    from gridgauge.operators import policy
    from gridgauge.sources import payloads

    got = choice.run_all(payloads.pdf_files(spark, str(tmp_path)))
    rows = {r.path[-5:]: r for r in got.withColumn("why", policy.failure_of_exception(F.col("kind"), F.col("error"), F.lit(None).cast("string"))).collect()}
    assert rows["a.pdf"].error is None and rows["b.pdf"].why == "server_down"
    assert payloads.normalise(got.where("error is null")).first().rows == [["c"]]
    choice.CONNECTORS.clear()
    with pytest.raises(ValueError):
        choice.run_all(got)


def test_setting(spark):
    assert choice.setting(spark, "summary_threshold", 0.75) == 0.75
