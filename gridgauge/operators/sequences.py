"""WIN-05 to WIN-26: operators over rows in order.

Rows of one table, page or document are ordered by an index column; every window is partitioned by the
columns in ``by``.  Where the next step depends on a running state that no window frame expresses (a
running mean, a group's leader), Spark sorts the rows and a small state goes on from block to block of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text


def carry_forward(rows: DataFrame, by: list[str], order: str, value: Column, name: str = "company") -> DataFrame:
    """WIN-05: the last value that isn't null, of this row or one before; empty text before the first."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, True).over(upto), F.lit("")))


def with_company_column(rows: DataFrame, by: list[str], order: str, cells: str, name: str = "company", keep_headers: bool = False) -> DataFrame:
    """WIN-05 and TBL-30: rows with their company as first cell; with ``keep_headers`` (WIN-06) company rows stay as they are, and rows before the first."""
    found = F.get(text.companies(F.concat_ws(" ", cells)), 0)
    got = carry_forward(rows.withColumn("found", found), by, order, F.col("found"), name)
    joined = F.concat(F.array(name), F.col(cells))
    return got.withColumn(cells, F.when(F.col("found").isNotNull() | (F.col(name) == ""), F.col(cells)).otherwise(joined) if keep_headers else joined).drop("found")


def company_rows(rows: DataFrame, by: list[str], order: str, name: str = "company") -> DataFrame:
    """WIN-07: the row numbers of each company."""
    return rows.where(F.col(name) != "").groupBy(*by, name).agg(F.array_sort(F.collect_list(order)).alias("rows"))


def clusters_by_gap(rows: DataFrame, by: list[str], at: str, most: float | Column, name: str = "cluster") -> DataFrame:
    """WIN-12: a new cluster where the step from the value before is ``most`` or more; numbered from 0."""
    order = Window.partitionBy(*by).orderBy(at)
    opens = F.coalesce((F.col(at) - F.lag(at).over(order)) >= most, F.lit(False))
    return rows.withColumn("opens", opens).withColumn(name, F.sum(F.col("opens").cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("opens")


def clusters_by_median_gap(rows: DataFrame, by: list[str], at: str, share: float = 0.5, least: float = 5.0, name: str = "cluster") -> DataFrame:
    """WIN-13: as WIN-12, the limit a share of the group's median step above zero, ``least`` at least."""
    order = Window.partitionBy(*by).orderBy(at)
    step = rows.withColumn("step", F.col(at) - F.lag(at).over(order))
    limit = step.where("step > 0").groupBy(*by).agg((F.median("step") * share).alias("limit"))
    got = rows.join(limit, by, "left").withColumn("limit", F.greatest(F.coalesce("limit", F.lit(least)), F.lit(least)))
    return clusters_by_gap(got, by, at, F.col("limit"), name).drop("limit")


def stepped(df: DataFrame, by: list[str], order: str, value: str, start: Callable[[], Callable[[object], int]], name: str) -> DataFrame:
    """``df`` with what a function from ``start`` says of each value of a group in order; each group gets a new function.

    Rows of a group lie together and sorted in one task, which reads them in Arrow blocks and holds one block and the function's
    state, however long the group is.
    """
    schema = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields] + [f"{name} int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for b in batches:
            out = []
            for k, v in zip(zip(*(b.column(c).to_pylist() for c in by)), b.column(value).to_pylist()):
                if step is None or k != key:
                    key, step = k, start()
                out.append(step(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, name])

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def clusters_by_running_mean(rows: DataFrame, by: list[str], at: str, most: float = 20.0, name: str = "cluster") -> DataFrame:
    """WIN-11: a value joins the open cluster while it is within ``most`` of that cluster's mean so far."""

    def start():
        total, n, k = 0.0, 0, -1

        def step(y) -> int:
            nonlocal total, n, k
            y = float("nan") if y is None else float(y)
            if n and abs(y - total / n) <= most:
                total, n = total + y, n + 1
            else:
                total, n, k = y, 1, k + 1
            return k

        return step

    return stepped(rows, by, at, at, start, name)


def leaders(rows: DataFrame, by: list[str], order: str, value: str, least: float = 0.8, name: str = "leader") -> DataFrame:
    """WIN-26: each text joins the first group whose first member shares ``least`` of their distinct characters, else opens one.

    The state is the leaders' sets of characters.
    """

    def start():
        heads: list[set] = []
        known: dict[frozenset, int] = {}  # texts of the same characters join the same group

        def step(v) -> int:
            s = frozenset((v or "").lower())
            k = known.get(s)
            if k is None:
                k = known[s] = next((k for k, h in enumerate(heads) if (len(s & h) / len(s | h) if s | h else 1.0) >= least), len(heads))
                if k == len(heads):
                    heads.append(s)
            return k

        return step

    return stepped(rows, by, order, value, start, name)


def similarity(a: list[str], b: list[str]) -> float:
    """Likeness of two headers: shared names over all names, half of it for the same width."""
    x, y = {h.strip().lower() for h in a} - {""}, {h.strip().lower() for h in b} - {""}
    return 0.5 * (len(x & y) / len(x | y) if x | y else 1.0) + 0.5 * (len(a) == len(b))


def sequences(tables: DataFrame, by: list[str], order: str, headers: str = "headers", alike: float = 0.4, loose: float = 0.25, name: str = "sequence") -> DataFrame:
    """WIN-17: page tables joined while they are like the sequence's first: ``alike``, or ``loose`` at the same width."""

    def start():
        head, k = None, -1

        def step(h) -> int:
            nonlocal head, k
            h = list(h or ())
            s = similarity(head, h) if head is not None else -1.0
            if not (s >= alike or s >= loose and len(head) == len(h)):
                head, k = h, k + 1
            return k

        return step

    return stepped(tables, by, order, headers, start, name)


def consolidate(tables: DataFrame, by: list[str]) -> DataFrame:
    """WIN-18, TBL-41: tables of the same header names in any order become one; a data-like header is a row, a repeated header row goes."""
    key = F.array_join(F.array_sort(text.headers(F.col("headers"))), "|")
    rows = F.when(text.headers_look_like_data(F.col("headers")), F.concat(F.array("headers"), F.col("rows"))).otherwise(F.filter("rows", lambda r: r != F.col("headers")))
    t = tables.select(*by, key.alias("header_key"), "table_index", F.col("headers").alias("heads"), rows.alias("own"))
    parts = F.array_sort(F.collect_list(F.struct("table_index", F.col("own").alias("rows"))))
    return t.groupBy(*by, "header_key").agg(F.min_by("heads", "table_index").alias("headers"), F.flatten(F.transform(parts, lambda p: p["rows"])).alias("rows"), F.min("table_index").alias("table_index"), F.count("*").alias("merged_from"))


def context(lines: DataFrame, by: list[str], order: str, line: str, around: int = 2) -> DataFrame:
    """WIN-20: each line with those around it."""
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-around, around)
    return lines.withColumn("context", F.array_join(F.collect_list(line).over(near), "\n"))


def pages(lines: DataFrame, by: list[str], order: str, breaks: Column) -> DataFrame:
    """WIN-21: page number from 0, a new page after each line that breaks."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("page", F.coalesce(F.sum(breaks.cast("int")).over(before), F.lit(0)))


def span(rows: DataFrame, by: list[str], order: str, overlap: Column, least: float = 0.3) -> DataFrame:
    """WIN-24: how many rows from the first on overlap more than ``least`` without a break."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("goes_on", F.min((overlap > least).cast("int")).over(upto)).groupBy(*by).agg(F.sum("goes_on").alias("span"))


def text_regions(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """WIN-25: runs of two or more lines, longer than ten characters, with a gap of three blanks: first line, last line, number."""
    own = lines.where(F.col(line).rlike(r"\S {3,}\S") & (F.length(text.strip(F.col(line))) > 10))
    run = F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return own.withColumn("run", run).groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where("n >= 2").drop("run")


def grown_region(cells: DataFrame, by: list[str], row: str = "r", col: str = "c", value: str = "v", density: float = 0.1) -> DataFrame:
    """WIN-22: from the first filled cell right and down while a column and a row stay denser than ``density`` (0 or more).

    Only counts of filled cells by column and by row are looked at, so that empty space costs nothing, however far a cell lies.
    """
    every = cells.select(*by, F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"), (F.trim(F.coalesce(F.col(value), F.lit(""))) != "").alias("full"))
    start = F.min(F.when(F.col("full"), F.struct("r", "c")))
    starts = every.groupBy(*by).agg(start.alias("start"), F.max("r").alias("most")).where("start is not null").select(*by, F.col("start.r").alias("r0"), F.col("start.c").alias("c0"), "most")
    full = every.where("full").join(starts, by).select(*by, "r0", "c0", "most", "r", "c").distinct()

    def grown(counts: DataFrame, at: str, first: str, name: str, keys: list[str]) -> DataFrame:
        """How far the dense places go on behind ``first`` without a gap."""
        line = Window.partitionBy(*keys).orderBy(at)
        dense = counts.where((F.col(at) > F.col(first)) & F.col("dense")).withColumn("nth", F.row_number().over(line))
        return dense.where(F.col(at) - F.col(first) == F.col("nth")).groupBy(*keys).agg(F.max(at).alias(name))

    columns = full.where("r >= r0").groupBy(*by, "c", "c0").agg((F.count("*") / F.first(F.col("most") - F.col("r0") + 1) > density).alias("dense"))
    wide = starts.join(grown(columns, "c", "c0", "c1", by), by, "left").withColumn("c1", F.coalesce("c1", "c0"))
    rows = full.drop("r0", "c0", "most").join(wide, by).where("c between c0 and c1").groupBy(*by, "r", "r0").agg((F.count("*") / F.first(F.col("c1") - F.col("c0") + 1) > density).alias("dense"))
    return wide.join(grown(rows, "r", "r0", "r1", by), by, "left").select(*by, "r0", "c0", F.coalesce("r1", "r0").alias("r1"), "c1")


# --- summary rows -------------------------------------------------------------------------------------------------

# What rows of totals say.
STRONG = (
    r"^total\s+for\s+group:?",
    r"^grand\s+total:?",
    r"^total\s+for\s+vendor:?",
    r"^summary:?",
    r"^sub\s*total:?",
    r"^net\s+total:?",
)
AGENT = (
    r"^writing\s+agent\s+number:?",
    r"^writing\s+agent\s+2\s+no:?",
    r"^writing\s+agent\s+name:?",
    r"^writing\s+agent\s+2\s+name:?",
)
WEAK = ("total", "sum", "subtotal", "aggregate", "overall", "combined", "consolidated")
TOTALS = ("total commission", "commission total", "net commission", "total for group", "group total", "total for vendor", "vendor total")
AGENT_KEYS = ("writing agent", "agent number", "agent name")


def summary_scores(rows: DataFrame, by: list[str], order: str, cells: str) -> DataFrame:
    """MTH-16, WIN-08, WIN-09: scores of each row by meaning, density, place and trade, and their weighted confidence."""
    said = F.lower(text.strip(F.concat_ws(" ", F.transform(cells, lambda x: F.coalesce(x, F.lit(""))))))
    weak = sum((F.when(said.contains(w), 1).otherwise(0) for w in WEAK), F.lit(0))
    semantic = F.when(said.rlike("|".join(STRONG)), 0.95).when(said.rlike("|".join(AGENT)), 0.85).when(weak >= 2, F.least(0.7 + weak * 0.1, F.lit(0.85))).when(weak == 1, 0.4).otherwise(0.1)
    business = F.when(said.rlike("|".join(TOTALS)), 0.9).when(said.rlike("|".join(AGENT_KEYS)), 0.8).otherwise(0.1)
    table, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    t = rows.withColumns({"said": said, "full": tb.filled(F.col(cells)), "digits": said.rlike(r"\d"), "cells_n": F.size(cells)})
    t = t.withColumns({"at": F.row_number().over(line) - 1, "n": F.count("*").over(table), "mean_full": F.avg(F.when(F.col("cells_n") > 0, F.col("full"))).over(table)})
    differs = lambda other: (F.col("cells_n") == 0) | (other("cells_n") == 0) | (F.abs(F.col("full") - other("full")) > 0.3) | (F.col("digits") != other("digits"))
    before, after = (lambda c: F.lag(c).over(line)), (lambda c: F.lead(c).over(line))
    apart = F.coalesce(differs(before) & differs(after), F.lit(False))
    position = F.when(F.col("at") == F.col("n") - 1, 0.7).when(F.col("at") > F.col("n") * 0.8, 0.5).when(F.col("at") > F.col("n") * 0.6, 0.3).when((F.col("at") > 0) & apart, 0.4).otherwise(0.2)
    density = F.when(F.col("mean_full").isNull(), 0.0).when(F.col("full") < F.col("mean_full") * 0.5, 0.8).when(F.col("full") < F.col("mean_full") * 0.7, 0.6).when(F.col("full") < F.col("mean_full") * 0.9, 0.3).otherwise(0.1)
    t = t.withColumns({"semantic": semantic, "business": business, "position": position, "density": density})
    total = 0.45 * F.col("semantic") + 0.35 * F.col("business") + 0.15 * F.col("density") + 0.05 * F.col("position")
    return t.withColumn("confidence", F.least(F.round(total, 9), F.lit(1.0))).drop("said", "full", "digits", "cells_n", "mean_full")


def drop_summary_rows(rows: DataFrame, by: list[str], order: str, cells: str, least: float = 0.75, agree: int = 2, most: float = 0.35) -> DataFrame:
    """WIN-10, TBL-28: adds ``removed``; the surest candidates up to the share ``most`` go, none if fewer than three rows would stay."""
    t = summary_scores(rows, by, order, cells)
    strong = sum((F.when(c, 1).otherwise(0) for c in (F.col("semantic") > 0.8, F.col("business") > 0.7, F.col("density") > 0.6, F.col("position") > 0.5)), F.lit(0))
    t = t.withColumn("candidate", (F.col("confidence") > least) & (strong >= agree) & (F.col("n") >= 3))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("candidate"), F.desc("confidence"), order))
    cap = F.greatest(F.lit(1), F.floor(F.col("n") * most))
    t = t.withColumn("chosen", F.col("candidate") & (rank <= cap))
    gone = F.sum(F.col("chosen").cast("int")).over(Window.partitionBy(*by))
    safe = (gone <= F.col("n") * most) & (F.col("n") - gone >= 3)
    return t.withColumn("removed", F.col("chosen") & safe).drop("candidate", "chosen", "at", "n")
