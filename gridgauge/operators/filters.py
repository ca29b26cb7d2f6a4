"""FLT: predicates over slots, folded into one condition that Catalyst can push and split."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge import dims
from gridgauge.operators import policy


@dataclass(frozen=True)
class SlotFilter:
    """Empty lists, empty texts and ``all`` set no condition."""

    tools: tuple[str, ...] = ()
    generations: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    search: str = ""
    carrier: str = "all"
    source: str = "all"  # open_source or commercial
    cost: tuple[float | None, float | None] = (None, None)
    time_ms: tuple[float | None, float | None] = (None, None)
    pages: tuple[int | None, int | None] = (None, None)
    scan: str = "all"  # digital, scanned or unknown
    status: str = "all"  # a reliability state, failures or transient
    more: tuple[Column, ...] = field(default=())

    def conditions(self) -> list[Column]:
        out = list(self.more)
        if self.tools:  # FLT-02
            out.append(F.col("tool_name").isin(*self.tools))
        if self.generations:
            out.append(F.col("generation").isin(*self.generations))
        if self.tiers:
            out.append(F.col("tier").isin(*[t.lower() for t in self.tiers]))
        if q := self.search.strip().lower():  # FLT-03
            out.append(F.lower("filename").contains(q) | F.lower(F.col("document_id").cast("string")).contains(q))
        if self.carrier not in ("", "all"):  # FLT-04
            out.append(F.col("carrier") == self.carrier)
        if self.source == "open_source":  # FLT-05
            out.append(F.col("tool_name").isin(*dims.OPEN_SOURCE))
        elif self.source == "commercial":
            out.append(~F.col("tool_name").isin(*dims.OPEN_SOURCE))
        for name, (low, high) in (("cost_per_page", self.cost), ("processing_time_ms", self.time_ms), ("page_count", self.pages)):  # FLT-06: null fails
            if low is not None:
                out.append(F.col(name) >= low)
            if high is not None:
                out.append(F.col(name) <= high)
        if self.scan != "all":  # FLT-07
            out.append({"digital": F.col("is_digital") == True, "scanned": F.col("is_digital") == False, "unknown": F.col("is_digital").isNull()}[self.scan])  # noqa: E712
        if self.status == "failures":  # FLT-08
            out.append((F.col("reliability") == "complete_failure") | F.col("is_transient_failure"))
        elif self.status == "transient":
            out.append(F.col("is_transient_failure"))
        elif self.status != "all":
            out.append(F.col("reliability") == self.status)
        return out

    def apply(self, slots: DataFrame) -> DataFrame:
        """FLT-01, FLT-09."""
        own = self.conditions()
        return slots.where(reduce(lambda a, b: a & b, own)) if own else slots


def with_scores(slots: DataFrame) -> DataFrame:
    """FLT-10."""
    return slots.where("scored_tables > 0")


def contributing(slots: DataFrame, metric: str, how: str) -> DataFrame:
    """FLT-11: rows that give a value under the policy."""
    return slots.where(policy.metric_value(metric, how).isNotNull())


def lasting(rows: DataFrame) -> DataFrame:
    """FLT-12: without transient failures."""
    return rows.where(~F.col("is_transient_failure"))


def by_document(rows: DataFrame, documents: DataFrame, tier: str = "all", scan: str = "all") -> DataFrame:
    """FLT-13: by the document's tier and scan kind; rows of unknown documents stay."""
    docs = documents.select("document_id", policy.tier(F.col("complexity_tier")).alias("d_tier"), F.col("is_digital").alias("d_digital"), F.lit(True).alias("known"))
    fits = F.lit(True)
    if tier != "all":
        fits &= F.col("d_tier") == dims.check_tier(tier)
    if scan != "all":
        fits &= {"digital": F.col("d_digital") == True, "scanned": F.col("d_digital") == False, "unknown": F.col("d_digital").isNull()}[scan]  # noqa: E712
    return rows.join(docs, "document_id", "left").where(F.col("known").isNull() | fits).drop("d_tier", "d_digital", "known")


def of_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """FLT-16: rows whose document is in ``ids``; a semi-join, so a repeated id can't repeat rows."""
    return rows.join(ids.select("document_id"), "document_id", "left_semi")


def of_company(rows: DataFrame, admin: bool, company_id: str | None) -> DataFrame:
    """FLT-18: an administrator sees all; a user without a company sees rows without one."""
    return rows if admin else rows.where(F.col("company_id").eqNullSafe(F.lit(company_id)))


def active(rows: DataFrame, only: bool = True) -> DataFrame:
    """FLT-19."""
    return rows.where("is_active = 1") if only else rows
