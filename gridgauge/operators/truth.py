"""Ground truth tables: merge, undo, edits, differences, and writes that replace rows.

Tables have document_id, table_index, headers, rows, notes, source, confirmed, correction_count and
``log``, an array of structs of which ``merge_undo`` entries hold what a merge took away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.operators.merge import reindex

UNDO = "struct<rows_before:array<array<string>>,removed_index:int,removed:struct<headers:array<string>,rows:array<array<string>>,notes:string,source:string,confirmed:boolean,correction_count:int>>"
LOG = f"array<struct<type:string,row:int,col:int,original:string,corrected:string,undo:{UNDO}>>"


def merge_tables(tables: DataFrame, orders: DataFrame) -> DataFrame:
    """TBL-04: for each order (document_id, primary, secondary) the second table's rows follow the first one's, at its width; the second goes, and indexes close up.

    The first table's log gets an entry to undo the merge.
    """
    o = orders.where("primary <> secondary")
    second = tables.join(o, "document_id").where("table_index = secondary").select("document_id", "primary", F.col("table_index").alias("removed_index"), F.struct("headers", "rows", "notes", "source", "confirmed", "correction_count").alias("removed"))
    t = tables.join(o.select("document_id", "primary", "secondary"), "document_id", "left").where("secondary is null or table_index <> secondary")
    t = t.join(second, ["document_id", "primary"], "left")
    hit = (F.col("table_index") == F.col("primary")) & F.col("removed").isNotNull() & (F.size("headers") > 0)
    entry = F.struct(F.lit("merge_undo").alias("type"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("corrected"), F.struct(F.col("rows").alias("rows_before"), "removed_index", "removed").alias("undo"))
    t = t.withColumns({
        "log": F.when(hit, F.concat("log", F.array(entry))).otherwise(F.col("log")), "correction_count": F.when(hit, F.col("correction_count") + 1).otherwise(F.col("correction_count")),
        "rows": F.when(hit, tb.append(F.col("headers"), F.col("rows"), F.col("removed.rows"))).otherwise(F.col("rows")),
    })
    return reindex(t.select(*tables.columns))


def last_undo(log: Column) -> Column:
    """TBL-06: the last merge entry, null without one."""
    return F.get(F.reverse(F.filter(log, lambda e: e["type"] == "merge_undo")), 0)


def without_last_undo(log: Column) -> Column:
    places = F.filter(F.transform(log, lambda e, i: F.when(e["type"] == "merge_undo", i)), lambda i: i.isNotNull())
    return F.filter(log, lambda e, i: F.coalesce(i != F.array_max(places), F.lit(True)))


def undo_merge(tables: DataFrame, orders: DataFrame) -> DataFrame:
    """TBL-05: for each order (document_id, survivor) the survivor's last merge is undone: its rows come back, the removed table returns to its place."""
    t = tables.join(orders.select("document_id", "survivor"), "document_id", "left")
    t = t.withColumn("undo", F.when(F.col("table_index") == F.col("survivor"), last_undo(F.col("log"))["undo"]))
    hit = F.col("undo").isNotNull()
    back = t.where(hit).select("document_id", F.col("undo.removed_index").alias("place"), "undo.removed.*").select("document_id", F.col("place").alias("table_index"), "headers", "rows", "notes", "source", "confirmed", "correction_count", F.array().cast(LOG).alias("log"))
    kept = t.withColumns({"rows": F.when(hit, F.col("undo.rows_before")).otherwise(F.col("rows")), "log": F.when(hit, without_last_undo(F.col("log"))).otherwise(F.col("log")), "correction_count": F.when(hit, F.greatest(F.col("correction_count") - 1, F.lit(0))).otherwise(F.col("correction_count"))}).select(*tables.columns)
    # A returned table stands before the one that now has its index.
    place = kept.withColumn("table_index", F.col("table_index") * 2 + 1).unionByName(back.withColumn("table_index", F.col("table_index") * 2).select(*tables.columns))
    return reindex(place)


def cells(tables: DataFrame) -> DataFrame:
    """(document_id, table_index, row, col, value): headers as row -1."""
    every = F.concat(F.array("headers"), F.col("rows"))
    return tables.select("document_id", "table_index", F.posexplode(every).alias("row", "cells")).select("document_id", "table_index", (F.col("row") - 1).alias("row"), F.posexplode("cells").alias("col", "value"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """JN-09, JN-10: cells that differ, by place; of a missing cell the value is empty.  Rows are padded to the header's width."""
    fit = lambda t: cells(t.withColumn("rows", tb.all_to_width(F.col("rows"), F.size("headers"))))
    keys = ["document_id", "table_index", "row", "col"]
    both = fit(before).withColumnRenamed("value", "original").join(fit(after).withColumnRenamed("value", "corrected"), keys, "full_outer")
    return both.where(~F.coalesce("original", F.lit("")).eqNullSafe(F.coalesce("corrected", F.lit("")))).select(*keys, F.coalesce("original", F.lit("")).alias("original"), F.coalesce("corrected", F.lit("")).alias("corrected"))


def seed(extraction: DataFrame) -> DataFrame:
    """TBL-36: unconfirmed truth from a run's tables that aren't empty, at the same index."""
    return extraction.where(F.size("rows") > 0).select("document_id", "table_index", "headers", "rows", F.lit(None).cast("string").alias("notes"), F.concat(F.lit("seed:"), "tool_name").alias("source"), F.lit(False).alias("confirmed"), F.lit(0).alias("correction_count"), F.array().cast(LOG).alias("log"))


# --- writes: each returns the whole new table, for the caller to write ---------------------------------------------


def insert_absent(tables: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """SNK-12: (the table with the rows whose key is new, the rows that were refused)."""
    return tables.unionByName(new.join(tables.select(*keys), keys, "left_anti")), new.join(tables.select(*keys), keys, "left_semi")


def replace(tables: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-10, SNK-11: all rows of the new rows' keys are replaced."""
    return tables.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_run(extraction: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-10: a run's tables are replaced; time, cost and payload of its first table stay."""
    keys = ["document_id", "tool_name"]
    kept = [c for c in ("processing_time_ms", "cost_usd", "raw_output") if c in extraction.columns]
    first = extraction.where("table_index = 0").groupBy(*keys).agg(*[F.first(c).alias(f"first_{c}") for c in kept])
    got = new.join(first, keys, "left")
    for c in kept:
        got = got.withColumn(c, F.when(F.col("table_index") == 0, F.col(f"first_{c}")).otherwise(F.lit(0) if c != "raw_output" else F.lit(None)))
    return replace(extraction, got.select(*extraction.columns), keys)


def update(tables: DataFrame, changes: DataFrame, keys: list[str], nullable: tuple[str, ...] = ()) -> DataFrame:
    """SNK-13, SNK-15: values that aren't null replace what is there; columns in ``nullable`` may also be set to null by a column ``set_<name>``."""
    own = [c for c in changes.columns if c not in keys and not c.startswith("set_")]
    c = changes.select(*keys, *[F.col(x).alias(f"new_{x}") for x in own], *[x for x in changes.columns if x.startswith("set_")])
    got = tables.join(c, keys, "left")
    for x in own:
        new = F.coalesce(f"new_{x}", x)
        got = got.withColumn(x, F.when(F.coalesce(F.col(f"set_{x}"), F.lit(False)), F.col(f"new_{x}")).otherwise(new) if x in nullable else new)
    return got.select(*tables.columns)


def delete(tables: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-14: without the rows of the given keys; other indexes stay."""
    return tables.join(gone.select(*keys), keys, "left_anti")


def delete_documents(documents: DataFrame, truth: DataFrame, extraction: DataFrame, score: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """SNK-09: documents with their truth, runs and scores."""
    ids = gone.select("document_id")
    runs = extraction.join(ids, "document_id", "left_semi").select("extraction_result_id")
    drop = lambda t: t.join(ids, "document_id", "left_anti")
    return drop(documents), drop(truth), drop(extraction), score.join(runs, "extraction_result_id", "left_anti")
