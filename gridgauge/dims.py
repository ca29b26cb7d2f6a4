"""The fixed dimensions: tools, tiers, metrics, reliability states and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tool ids in their canonical order, with generation and label.
TOOLS = ("pymupdf", "docling", "aws_textract", "google_docai", "gpt5", "claude_sonnet", "mistral")
GENERATIONS = {"pymupdf": "rule", "docling": "cv", "aws_textract": "cv", "google_docai": "cv", "gpt5": "llm", "claude_sonnet": "llm", "mistral": "llm"}
LABELS = {"pymupdf": "PyMuPDF", "docling": "Docling", "aws_textract": "AWS Textract", "google_docai": "Google DocAI", "gpt5": "GPT-5 Vision", "claude_sonnet": "Claude Sonnet", "mistral": "Mistral AI"}
OPEN_SOURCE = ("pymupdf", "docling")
TIERS = ("low", "medium", "high", "unconfirmed")
METRICS = ("f1_score", "precision", "recall", "teds_score", "grits_top", "grits_con", "grits_loc")
RELIABILITY = ("success", "partial", "missing_f1", "complete_failure", "unevaluated")

# USD for each page, and for each million tokens in and out; tokens of a page if unknown.
PAGE_PRICE = {"pymupdf": 0.0, "docling": 0.0, "aws_textract": 0.015, "google_docai": 0.01, "gpt5": 0.0, "claude_sonnet": 0.0, "mistral": 0.002}
TOKEN_PRICE = {"gpt5": (2.0, 8.0), "claude_sonnet": (3.0, 15.0), "mistral": (2.0, 6.0)}
TOKENS_PER_PAGE = (1500, 2000)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def generation(tool: Column) -> Column:
    """PRJ-04: the tool's generation; an unknown tool counts as llm."""
    return F.coalesce(_lookup(GENERATIONS, tool), F.lit("llm"))


def label(tool: Column) -> Column:
    """PRJ-05: the display label, or the id itself."""
    return F.coalesce(_lookup(LABELS, tool), tool)


def tool_rank(tool: Column) -> Column:
    """PRJ-06: place in the canonical order; unknown tools come first with -1."""
    return (F.array_position(F.array(*map(F.lit, TOOLS)), tool) - 1).cast("int")


def tool_dim(spark: SparkSession) -> DataFrame:
    """PRJ-07: seven rows; the one side here that is always small enough to broadcast."""
    return spark.createDataFrame([(k, t, GENERATIONS[t], LABELS[t], t in OPEN_SOURCE) for k, t in enumerate(TOOLS)], "tool_rank int, tool_name string, generation string, label string, open_source boolean")


def price_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, PAGE_PRICE[t], *(p / 1e6 for p in TOKEN_PRICE[t])) if t in TOKEN_PRICE else (t, PAGE_PRICE[t], None, None) for t in TOOLS]
    return spark.createDataFrame(rows, "tool_name string, page_price double, in_price double, out_price double")


def check_tools(tools: list[str] | str) -> list[str]:
    """FLT-15: ``all`` stands for every tool; unknown ids are an error."""
    if tools == "all" or tools == ["all"]:
        return list(TOOLS)
    if unknown := [t for t in tools if t not in TOOLS]:
        raise ValueError(f"unknown tools: {', '.join(unknown)}")
    return list(tools)


def check_tier(tier: str | None) -> str | None:
    """FLT-14: one of the four tiers, or none."""
    if tier is not None and tier not in TIERS:
        raise ValueError(f"unknown tier: {tier}")
    return tier
