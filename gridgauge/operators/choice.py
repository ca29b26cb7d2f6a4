"""Scores, rankings and choices among candidates: pages, headers, texts, values, columns; and the registry of tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.functions import tables as tb
from gridgauge.functions import text
from gridgauge.operators import sequences


def document_results(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """PRJ-03: scored rows with the bodies of their tables."""
    return rows.join(tables.select("document_id", "tool_name", "table_index", "headers", "rows"), ["document_id", "tool_name", "table_index"], "left")


def by_tier(rows: DataFrame) -> DataFrame:
    """SRT-02: by tier as text, tool and table."""
    return rows.orderBy("complexity_tier", "tool_name", "table_index")


def as_text(rows: DataFrame, column: str, down: bool = False) -> DataFrame:
    """SRT-05: by a column as text, null as empty text; rows of equal texts by their other columns, from left to right.

    So the order is one and the same each time, and rows of one text, which may be most of all, are cut into ranges for
    several tasks.
    """
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    others = [F.col(o) for o, t in rows.dtypes if o != column and "map<" not in t and t != "variant"]
    return rows.orderBy(c.desc() if down else c.asc(), *others)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """SRT-11: one page of a sorted result."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def content_pages(pages: DataFrame, by: str, k: int) -> DataFrame:
    """SRT-07: up to ``k`` pages of each document by content score, the first page favoured; scores of 0 and below only for the first page, below -20 never."""
    n = F.count("*").over(Window.partitionBy(by))
    p = pages.withColumn("score", text.page_score(F.col("text"), F.col("page"), n))
    p = p.where((F.col("score") > 0) | (F.col("page") == 0) & (F.col("score") > -20))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "page"))
    return p.withColumn("rank", rank).where(F.col("rank") <= k)


# Words by weight.
KEYWORDS = {15: ("commission", "commission statement"), 8: ("premium", "policy", "group"), 5: ("total", "date", "agent")}


def keyword_pages(pages: DataFrame, by: str, k: int) -> DataFrame:
    """SRT-12: the ``k`` pages with the best keyword score: 15, 8 and 5 a word, a point for each gap of columns up to 10, 8 less for an empty page."""
    said = F.lower(F.coalesce("text", F.lit("")))
    score = F.least(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S {3,}\S")), F.lit(10)) + F.when(text.strip(said) == "", -8).otherwise(0)
    for weight, words in KEYWORDS.items():
        for w in words:
            score = score + F.when(said.contains(w), weight).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "page"))
    return pages.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k)


def value_priority(values: Column, patterns: Column, samples: Column) -> Column:
    """SRT-14: values by priority, 100 for a pattern, 80 for a sample, else by type; those of equal priority keep their order."""
    def priority(v):
        kind = text.data_type(v)
        own = F.when(kind == "date", 60).when(kind == "currency", 50).when(kind == "percentage", 40).when(kind == "number", 30).otherwise(10)
        return F.when(F.exists(patterns, lambda p: F.regexp_like(v, p)), 100).when(F.array_contains(samples, v), 80).otherwise(own)

    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-priority(v)).alias("p"), i.alias("i"), v.alias("v"))))
    return F.transform(ranked, lambda x: x["v"])


def best_text(candidates: DataFrame, by: list[str]) -> DataFrame:
    """SRT-15: the text with the highest score, kept within 0 and 1; ties go to the first."""
    return candidates.groupBy(*by).agg(F.max_by("text", F.struct(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), -F.col("nth"))).alias("text"))


def fuse(candidates: DataFrame, by: list[str], alike: float = 0.8) -> DataFrame:
    """TBL-38: texts that are alike form a group; of each group the best one, with the group's size."""
    groups = sequences.leaders(candidates, by, "nth", "text", alike)
    order = F.struct(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), -F.col("nth"))
    return groups.groupBy(*by, "leader").agg(F.max_by("text", order).alias("text"), F.count("*").alias("n"))


def typed_values(c: Column) -> Column:
    """SET-08: (value, type) of a text's values in order, each once."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d{1,4}[/-]\d{1,2}[/-]\d{1,4}|\$\s?[\d,]+(?:\.\d+)?|-?[\d,]+(?:\.\d+)?\s?%|\b\d[\d,]*(?:\.\d+)?\b"), 0)
    return F.array_distinct(F.transform(found, lambda v: F.struct(v.alias("value"), text.data_type(v).alias("type"))))


def column_score(value: Column, kind: Column, pattern: Column, samples: Column) -> Column:
    """STR-19: how well a value fits a column: type 30 (text 5), pattern 50, sample 40, like format 20; above 15 it is accepted."""
    v = text.strip(F.coalesce(value, F.lit("")))
    same = text.data_type(v) == kind
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, r"\d", "9"), "[A-Za-z]", "a")
    return F.when(same & (kind != "text"), 30).when(same, 5).otherwise(0) + F.when(F.regexp_like(v, pattern), 50).otherwise(0) + F.when(F.array_contains(samples, v), 40).otherwise(0) + F.when(F.exists(samples, lambda s: shape(s) == shape(v)), 20).otherwise(0)


def teds_by_characters(pred: Column, truth: Column, size: int = 1) -> Column:
    """MTH-11: 1 less the character distance over a list length of ``size``; with 1, as elsewhere, mostly far below zero.  Not for use in reports."""
    return 1 - F.levenshtein(pred, truth) / F.lit(size)


def retry_seconds(attempt: Column) -> Column:
    """MTH-18: 2 to the power of the attempt, 60 at most."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(60.0))


def excel_confidence(headers: Column, rows: Column) -> Column:
    """MTH-22: struct of confidence (.3 density, .2 headers, .2 rows, .3 business words) and quality (.4 density, .3 even rows, .3 headers)."""
    dense = tb.completeness(headers, rows)
    named = F.when(F.size(headers) > 0, F.size(F.filter(headers, lambda h: ~tb.blank(h))) / F.size(headers)).otherwise(0.0)
    trade = F.exists(headers, lambda h: F.lower(F.coalesce(h, F.lit(""))).rlike("commission|premium|policy|amount|date|name|group"))
    even = F.when(~tb.ragged(headers, rows), 1.0).otherwise(0.0)
    conf = 0.3 * dense + 0.2 * named + F.when(F.size(rows) >= 3, 0.2).otherwise(0.1) + F.when(trade, 0.3).otherwise(0.0)
    return F.struct(F.round(F.least(conf, F.lit(1.0)), 6).alias("confidence"), F.round(0.4 * dense + 0.3 * even + 0.3 * named, 6).alias("quality"))


def table_similarity(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """TBL-19: .3 headers, .2 width, .25 kinds of columns, .15 density, .1 length of rows; each within 0 and 1."""
    (h1, r1), (h2, r2) = a, b
    ratio = lambda x, y: F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(1.0))
    kinds = lambda h, r: tb.column_types(h, r)
    same = F.filter(F.zip_with(kinds(h1, r1), kinds(h2, r2), lambda x, y: x == y), lambda e: e)
    length = lambda r: F.coalesce(F.try_divide(F.aggregate(F.flatten(r), F.lit(0), lambda acc, x: acc + F.length(F.coalesce(x, F.lit("")))), F.size(F.flatten(r))), F.lit(0.0))
    return (
        0.3 * text.jaccard(text.headers(h1), text.headers(h2)) + 0.2 * ratio(F.size(h1), F.size(h2)) + 0.25 * F.coalesce(F.try_divide(F.size(same), F.greatest(F.size(h1), F.size(h2))), F.lit(1.0))
        + 0.15 * (1 - F.abs(tb.completeness(h1, r1) - tb.completeness(h2, r2))) + 0.1 * ratio(length(r1), length(r2))
    )


def structure_faults(headers: Column, rows: Column) -> Column:
    """TBL-31: what is wrong with a table's structure."""
    return F.array_compact(F.array(
        F.when(F.size(headers) == 0, "no headers"), F.when(F.size(rows) == 0, "no rows"), F.when(tb.ragged(headers, rows), "ragged"),
        F.when(F.size(F.array_distinct(text.headers(headers))) < F.size(headers), "repeated headers"), F.when(tb.completeness(headers, rows) < 0.1, "nearly empty"),
    ))


# Weights of header words of financial tables.
HEADER_WEIGHTS = {"commission": 3.0, "premium": 3.0, "amount": 2.0, "policy": 2.0, "group": 1.5, "company": 1.5, "client": 1.5, "date": 1.0, "period": 1.0, "rate": 1.0, "agent": 1.0, "total": 0.5}


def header_score(headers: Column) -> Column:
    """TBL-32: summed weights of the words in the headers, each header by its heaviest word."""
    weights = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in HEADER_WEIGHTS.items()])
    of = lambda h: F.coalesce(F.array_max(F.transform(F.filter(weights, lambda x: F.contains(F.lower(F.coalesce(h, F.lit(""))), x["w"])), lambda x: x["v"])), F.lit(0.0))
    return F.aggregate(headers, F.lit(0.0), lambda acc, h: acc + of(h))


def is_financial(headers: Column, rows: Column) -> Column:
    """TBL-32: accepted with a header score of 2, or with amounts in a third of the cells."""
    cells = F.flatten(rows)
    money = F.size(F.filter(cells, lambda x: text.data_type(x).isin("currency", "percentage")))
    return (header_score(headers) >= 2) | ((F.size(cells) > 0) & (money * 3 >= F.size(cells)))


def best_header_table(tables: DataFrame, by: list[str]) -> DataFrame:
    """TBL-39: of a group's tables the headers with the best score: columns, 2 or 3 for a trade word, 10 less if they look like data; ties go to the first."""
    word = lambda h: F.lower(F.coalesce(h, F.lit("")))
    bonus = F.aggregate("headers", F.lit(0), lambda acc, h: acc + F.when(word(h).rlike("commission|premium"), 3).when(word(h).rlike("policy|group|date|amount|name"), 2).otherwise(0))
    score = F.size("headers") + bonus - F.when(text.headers_look_like_data(F.col("headers")), 10).otherwise(0)
    return tables.groupBy(*by).agg(F.max_by("headers", F.struct(score, -F.col("table_index"))).alias("headers"))


def enhance(tables: DataFrame, by: list[str]) -> DataFrame:
    """TBL-37: accounting negatives in every cell, then summary rows taken out; rows stay in order."""
    t = tables.withColumn("rows", tb.fix_brackets(F.col("rows")))
    rows = t.select(*by, F.posexplode("rows").alias("i", "cells"))
    kept = sequences.drop_summary_rows(rows, by, "i", "cells").where(~F.col("removed"))
    kept = kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cells"))), lambda x: x["cells"]).alias("rows"))
    return t.drop("rows").join(kept, by, "left").withColumn("rows", F.coalesce("rows", tb.no_rows()))


# --- tools ----------------------------------------------------------------------------------------------------------

#: UDF-01, SRC-10 to SRC-13: tool id to what reads one file's bytes and gives its payload as JSON text.  None is built in: a user registers those at hand.
CONNECTORS: dict[str, Callable[[bytes], str]] = {}


def register(tool: str, read: Callable[[bytes], str]) -> None:
    dims.check_tools([tool])
    CONNECTORS[tool] = read


def run_tool(files: DataFrame, tool: str) -> DataFrame:
    """UDF-04: (path, tool_name, raw_output, error, kind, processing_time_ms) of each file of a ``binaryFile`` frame; an error is a row."""
    read = CONNECTORS[tool]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                t = time.perf_counter()
                try:
                    got, error, kind = read(bytes(content)), None, None
                except Exception as e:  # becomes a row that POL-06 classifies
                    got, error, kind = None, str(e), type(e).__name__
                out.append((path, tool, got, error, kind, int((time.perf_counter() - t) * 1000)))
            yield pd.DataFrame(out, columns=["path", "tool_name", "raw_output", "error", "kind", "processing_time_ms"])

    return files.select("path", "content").mapInPandas(run, "path string, tool_name string, raw_output string, error string, kind string, processing_time_ms long")


def run_all(files: DataFrame, tools: list[str] | str = "all") -> DataFrame:
    """UDF-05: the union over tools that have a connector."""
    own = [t for t in dims.check_tools(tools) if t in CONNECTORS]
    if not own:
        raise ValueError("no connector is registered")
    return reduce(DataFrame.unionByName, [run_tool(files, t) for t in own])


def best_pairs(a: Column, b: Column, likeness: Callable[[Column, Column], Column]) -> Column:
    """UDF-02: for each element of ``a`` the likeness of the best one of ``b``, under any likeness given as a function of columns."""
    return F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: likeness(x, y))))


def setting(spark, name: str, default: float) -> float:
    """UDF-03: a threshold from the session, ``gridgauge.<name>``, or its default."""
    return float(spark.conf.get(f"gridgauge.{name}", str(default)))
