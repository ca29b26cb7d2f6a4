"""Payloads of tools: JSON of several shapes, cloud block graphs, pages, files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text

TABLE = "struct<headers:array<string>,header:array<string>,rows:array<array<string>>,data:array<array<string>>,page_number:int,table_index:int>"
PAYLOAD = f"struct<tables:array<{TABLE}>,success:boolean,error:string,usage:struct<input_tokens:string,output_tokens:string>>"


def normalise(raw: DataFrame, payload: str = "raw_output") -> DataFrame:
    """TBL-01: one row for each table of a payload, an object with ``tables`` or a bare list; ``header`` and ``data`` are other names.

    Numbers and booleans in cells stay the text they are in the JSON.  Tables that are no objects go.
    """
    as_object = F.when(F.ltrim(F.col(payload)).startswith("["), F.concat(F.lit('{"tables":'), F.col(payload), F.lit("}"))).otherwise(F.col(payload))
    said = raw.withColumn("said", F.from_json(as_object, PAYLOAD))
    t = said.select(*raw.columns, F.posexplode("said.tables").alias("place", "t")).where("t is not null")
    filled = lambda a, b: F.when(F.size(a) > 0, a).otherwise(F.coalesce(b, a))
    return t.select(*[c for c in raw.columns if c != payload], F.coalesce("t.table_index", "place").alias("table_index"), "t.page_number", filled(F.col("t.headers"), F.col("t.header")).alias("headers"), filled(F.col("t.rows"), F.col("t.data")).alias("rows"))


def outcome(raw: DataFrame, payload: str = "raw_output") -> DataFrame:
    """POL-05, POL-07, MTH-08 for each payload: failure reason, whether transient, token counts."""
    from gridgauge.operators import cost, policy

    success, error = F.get_json_object(payload, "$.success"), F.get_json_object(payload, "$.error")
    failed = success == "false"
    reason = F.when(failed, policy.failure_of_text(F.coalesce(error, F.lit("extraction returned success=False"))))
    return raw.withColumns({"failure_reason": reason, "is_transient_failure": policy.transient(reason), "input_tokens": cost.tokens_of(F.col(payload), "input_tokens"), "output_tokens": cost.tokens_of(F.col(payload), "output_tokens")})


def json_text(c: Column) -> Column:
    """TBL-02: any value as JSON text."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def arbitrate(structured: Column, markdown: Column) -> Column:
    """SRC-14: tables of the structured answer, unless it has fewer rows than those of the text."""
    n = lambda t: F.aggregate(F.coalesce(t, F.array().cast(markdown_type)), F.lit(0), lambda acc, x: acc + F.size(x["rows"]))
    markdown_type = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    return F.when((n(structured) > 0) & (n(structured) >= n(markdown)), structured).otherwise(markdown)


def best_strategy(tables: DataFrame, by: list[str]) -> DataFrame:
    """SRC-08: of a page's strategies (rank, tables) that with the most tables that aren't empty; ties go to the first."""
    filled = F.size(F.filter("tables", lambda t: F.size(t["rows"]) > 0))
    return tables.groupBy(*by).agg(F.max_by("tables", F.struct(filled, -F.col("rank"))).alias("tables"))


def from_layout(df: DataFrame, layout: str) -> DataFrame:
    """SRC-20: rows of a layout's header and body as texts, blocks of a cell joined by blanks."""
    cell = "struct<blocks:array<struct<textBlock:struct<text:string>>>>"
    rows = f"array<struct<cells:array<{cell}>>>"
    said = F.from_json(layout, f"struct<headerRows:{rows},bodyRows:{rows}>")
    texts = lambda r: F.transform(F.coalesce(r, F.array().cast(rows)), lambda x: F.transform(x["cells"], lambda c: text.strip(F.array_join(F.transform(c["blocks"], lambda b: b["textBlock"]["text"]), " "))))
    return df.withColumn("said", said).select(*df.columns, texts(F.col("said.headerRows")).alias("header_rows"), texts(F.col("said.bodyRows")).alias("rows"))


def blocks_to_tables(blocks: DataFrame, by: list[str]) -> DataFrame:
    """SRC-09, TBL-09, TBL-10: tables of a block graph (by, id, type, children, row, col, row_span, col_span, is_header, confidence, text, selected).

    Tables join their cells and cells their words by block id.  A cell's text is its words, ``[X]`` for a chosen
    box.  The header is the first row of which half the filled cells are headers, else the first filled row;
    empty columns at the end go; confidence is the mean of those above zero.  Cells without a place are left out.
    """
    kids = blocks.select(*by, F.col("id").alias("parent"), "type", F.posexplode("children").alias("nth", "id"))
    words = blocks.where(F.col("type").isin("WORD", "SELECTION_ELEMENT")).select(*by, "id", F.when(F.col("type") == "WORD", F.col("text")).when(F.col("selected"), F.lit("[X]")).alias("w"))
    texts = kids.where(F.col("type").isin("CELL", "MERGED_CELL")).join(words, [*by, "id"]).where("w is not null").groupBy(*by, F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"]), " ").alias("text"))
    cells = blocks.where(F.col("type").isin("CELL", "MERGED_CELL")).drop("text", "type", "children").join(texts, [*by, "id"], "left")
    own = kids.where("type = 'TABLE'").select(*by, F.col("parent").alias("table"), "nth", "id").join(cells, [*by, "id"])
    own = own.repartition(*by, "table")  # the three groupings that follow need no other shuffle
    place = own.groupBy(*by, "table", "row", "col").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("t")))), lambda x: text.strip(x["t"])), lambda t: t != ""), " ").alias("t"),
        F.bool_or("is_header").alias("h"), F.min_by("confidence", "nth").alias("conf"),
    )
    none = F.struct(F.lit("").alias("t"), F.lit(False).alias("h"))
    line = F.transform(F.sequence(F.lit(1), F.col("last")), lambda c: F.coalesce(F.try_element_at("own", c), none))
    lines = place.where("row >= 1 and col >= 1").groupBy(*by, "table", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("t", F.coalesce("h", F.lit(False)).alias("h"))))).alias("own"), F.max("col").alias("last"), F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("conf"), F.count_if(F.col("conf") > 0).alias("sure"))
    lines = lines.select(*by, "table", F.struct("row", line.alias("line")).alias("line"), "conf", "sure")
    grid = lines.groupBy(*by, "table").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]).alias("rows"), F.round(F.coalesce(F.try_divide(F.sum("conf"), F.sum("sure")), F.lit(0.0)), 2).alias("confidence"))
    full = lambda r: F.size(F.filter(r, lambda x: x["t"] != ""))
    heads = lambda r: F.size(F.filter(r, lambda x: (x["t"] != "") & x["h"]))
    places = lambda p: F.array_min(F.filter(F.transform("rows", lambda r, i: F.when(p(r), i)), lambda i: i.isNotNull()))
    grid = grid.withColumn("head", F.coalesce(places(lambda r: (full(r) > 0) & (heads(r) >= F.greatest(F.lit(1.0), full(r) * 0.5))), places(lambda r: full(r) > 0))).where("head is not null")
    width = F.array_max(F.flatten(F.transform("rows", lambda r: F.transform(r, lambda x, i: F.when(x["t"] != "", i + 1).otherwise(0)))))
    grid = grid.withColumn("w", width)
    cut = lambda r: tb.to_width(F.transform(r, lambda x: x["t"]), F.col("w"))
    body = F.filter(F.transform(F.slice("rows", F.col("head") + 2, F.size("rows")), cut), lambda r: F.exists(r, lambda x: x != ""))
    return grid.select(*by, "table", cut(F.get("rows", F.col("head"))).alias("headers"), body.alias("rows"), "confidence").where(F.size("rows") > 0)


def answers_in_order(answers: DataFrame, by: list[str]) -> DataFrame:
    """SRC-09: the answers of a paged service in the order of their tokens: (by, place, whole, payload).

    ``answers`` has by, ``token`` (what was asked with; null or empty for the first), ``next_token`` (null or empty in the
    last) and ``payload``.  Answers that no chain from the first comes to go; of repeated ones that with the greater
    next token stays.  ``whole`` says whether the chain ends; it doesn't if an answer is missing or a token comes again.
    A chain is followed in one row of tokens, without their payloads.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    each = answers.groupBy(*by, none("token").alias("token")).agg(F.max(F.struct(none("next_token").alias("next"), "payload")).alias("said"))
    links = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("token", "said.next"))).alias("links"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit("").alias("at"), F.lit(True).alias("sound"), F.lit(False).alias("done"))

    def step(acc, _):
        to = F.try_element_at("links", acc["at"])
        more = F.coalesce(to != "", F.lit(False))
        lost = to.isNull() | more & (F.array_contains(acc["seen"], to) | (to == acc["at"]))
        seen = F.when(to.isNull(), acc["seen"]).otherwise(F.concat(acc["seen"], F.array(acc["at"])))
        on = F.struct(seen.alias("seen"), F.coalesce(to, F.lit("")).alias("at"), F.coalesce(~lost, F.lit(False)).alias("sound"), (F.coalesce(lost, F.lit(True)) | ~more).alias("done"))
        return F.when(acc["done"], acc).otherwise(on)

    chain = links.withColumn("chain", F.aggregate(F.sequence(F.lit(1), F.size("links")), start, step))
    chain = chain.select(*by, (F.col("chain.sound") & F.col("chain.done")).alias("whole"), F.posexplode("chain.seen").alias("place", "token"))
    return chain.join(each, [*by, "token"]).select(*by, "place", "whole", "said.payload")


BLOCK = "struct<Id:string,BlockType:string,Relationships:array<struct<Type:string,Ids:array<string>>>,RowIndex:int,ColumnIndex:int,RowSpan:int,ColumnSpan:int,EntityTypes:array<string>,Confidence:double,Text:string,SelectionStatus:string>"


def blocks_of(answers: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """SRC-09: the block graph of a service's answers as ``blocks_to_tables`` takes it; a damaged answer has no blocks."""
    b = answers.select(*by, F.explode(F.from_json(payload, f"struct<Blocks:array<{BLOCK}>>")["Blocks"]).alias("b"))
    kids = F.flatten(F.transform(F.filter("b.Relationships", lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"]))
    return b.select(
        *by, F.col("b.Id").alias("id"), F.col("b.BlockType").alias("type"), F.coalesce(kids, tb.no_cells()).alias("children"), F.col("b.RowIndex").alias("row"), F.col("b.ColumnIndex").alias("col"),
        F.coalesce("b.RowSpan", F.lit(1)).alias("row_span"), F.coalesce("b.ColumnSpan", F.lit(1)).alias("col_span"), F.coalesce(F.array_contains("b.EntityTypes", "COLUMN_HEADER"), F.lit(False)).alias("is_header"),
        F.col("b.Confidence").alias("confidence"), F.col("b.Text").alias("text"), (F.col("b.SelectionStatus") == "SELECTED").alias("selected"),
    )


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: raw files with path, time and length.  Files without a byte, which are no PDFs, are left out by Spark's source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def profile_pages(pages: DataFrame, by: str = "document_id") -> DataFrame:
    """SRC-07: pages, and whether more than half of them have over 50 characters of text."""
    full = (F.length(text.strip(F.coalesce("text", F.lit("")))) > 50).cast("int")
    return pages.groupBy(by).agg(F.count("*").cast("int").alias("page_count"), (F.sum(full) > 0.5 * F.count("*")).alias("is_digital"))


def excel_regions(cells: DataFrame, by: list[str]) -> DataFrame:
    """TBL-21: blocks of rows with two or more filled cells, without a gap: first and last row, first and last column."""
    rows = cells.where(~tb.blank(F.col("value"))).groupBy(*by, "row").agg(F.count("*").alias("n"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("n >= 2")
    run = F.col("row") - F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    return rows.withColumn("run", run).groupBy(*by, "run").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("r1 > r0").drop("run")


def best_header_row(cells: DataFrame, by: list[str]) -> DataFrame:
    """TBL-22: of a region's first five rows that with the largest share of words; ties go to the first."""
    word = (text.data_type(F.col("value")) == "text") & ~tb.blank(F.col("value"))
    first = cells.withColumn("nth", F.dense_rank().over(Window.partitionBy(*by).orderBy("row"))).where("nth <= 5")
    rows = first.groupBy(*by, "row").agg(F.avg(word.cast("double")).alias("score"))
    return rows.groupBy(*by).agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("header_row"))


def repair_json(raw: str | None) -> str | None:
    """TBL-26, TBL-27: JSON text from an answer: without fences and trailing commas, cut after the last whole element and closed; null if there is none."""
    import re

    if not raw:
        return None
    s = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw.strip()).strip()
    starts = [k for k in (s.find("{"), s.find("[")) if k >= 0]
    if not starts:
        return None
    s = re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], s[min(starts) :])  # a comma inside a string stays
    stack, quoted, escaped, ends = [], False, False, []
    for k, c in enumerate(s):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
            continue
        if c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            ends.append((k + 1, "".join(reversed(stack))))
            if not stack:
                break
    for at, close in reversed(ends):
        try:
            return json.dumps(json.loads(s[:at] + close), ensure_ascii=False)
        except ValueError:
            continue
    return None


def repaired(df: DataFrame, column: str) -> DataFrame:
    """TBL-27: as ``repair_json``, in Arrow batches; texts that are JSON already skip it."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(repair_json)

    fine = F.try_parse_json(F.col(column)).isNotNull()
    return df.where(fine).unionByName(df.where(~fine | F.col(column).isNull()).withColumn(column, fix(column)))
