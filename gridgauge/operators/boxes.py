"""Boxes on pages: overlap, matching, assignment, suppression.  Boxes are structs or columns x0, y0, x1, y1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.shared import written


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """MTH-10: shared area over joint area; of two empty boxes 0."""
    s = shared(a, b)
    return F.coalesce(F.try_divide(s, area(a) + area(b) - s), F.lit(0.0))


#: Side of a grid cell in which boxes meet; pairs of a page that are decided in one group; pairs of one group, about.
CELL, LARGE, TOGETHER = 200.0, 20_000, 50_000


def meeting(a: DataFrame, b: DataFrame, page: str, one: str, other: str) -> DataFrame:
    """Pairs of boxes that touch a cell of a coarse grid both, each in the first such cell only: page, ``one``, ``other`` and their boxes."""

    def celled(df: DataFrame, name: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / CELL).cast("int")
        rows, cols = F.explode(F.sequence(at("y0"), at("y1"))), F.sequence(at("x0"), at("x1")).alias("cols")
        return df.select(page, F.col("id").alias(f"{name}_id"), F.struct("x0", "y0", "x1", "y1").alias(name), cols, rows.alias("gy")).select(page, f"{name}_id", name, "gy", F.explode("cols").alias("gx"))

    pairs = celled(a, one).join(celled(b, other), [page, "gx", "gy"])
    first = lambda g, c: F.col(g) == F.floor(F.greatest(F.col(f"{one}.{c}"), F.col(f"{other}.{c}")) / CELL)
    return pairs.where(first("gx", "x0") & first("gy", "y0"))


def by_size(pairs: DataFrame, page: str) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of pages of at most ``LARGE`` pairs, pairs of larger pages, and how many groups the first make.

    A larger page has so many pairs that there are few of them for the table's size; they are broadcast only if there are
    fewer than 10,000.
    """
    sizes = written(pairs.groupBy(page).agg(F.count("*").alias("n")))
    total, n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > LARGE)).first()
    large = sizes.where(F.col("n") > LARGE).select(page)
    large = F.broadcast(large) if n < 10_000 else large
    return (pairs if not n else pairs.join(large, page, "left_anti")), (pairs.limit(0) if not n else pairs.join(large, page, "left_semi")), max(1, -(-total // TOGETHER))


def match(pred: DataFrame, truth: DataFrame, page: str = "page", least: float = 0.5) -> DataFrame:
    """JN-12: (page, pred, true, iou) of a one-to-one matching: pairs of a page from the most alike down, each box once.

    Only overlapping pairs leave the join.  Pages of up to ``LARGE`` pairs are decided in groups of many pages.  On larger ones
    a pair is taken once it is the best undecided one of both its boxes, round by round, which gives the same matching.
    """
    pairs = meeting(pred, truth, page, "pred", "true").select(page, F.col("pred_id").alias("pred"), F.col("true_id").alias("true"), iou(F.col("pred"), F.col("true")).alias("iou")).where(F.col("iou") >= least)
    pairs = written(pairs)
    small, large, groups = by_size(pairs, page)

    def greedy(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["iou", "pred", "true"], ascending=[False, True, True], kind="stable")
        used_p, used_t, keep = set(), set(), []
        for k, x, y in zip(p[page], p["pred"], p["true"]):
            keep.append((k, x) not in used_p and (k, y) not in used_t)
            if keep[-1]:
                used_p.add((k, x))
                used_t.add((k, y))
        return p[np.array(keep, bool)]

    out = small.groupBy(F.pmod(F.xxhash64(page), F.lit(groups))).applyInPandas(greedy, pairs.schema)
    order = F.struct((-F.col("iou")).alias("far"), "pred", "true")
    while not large.isEmpty():
        best = lambda c: F.min(order).over(Window.partitionBy(page, c))
        taken = written(large.select("*", best("pred").alias("a"), best("true").alias("b")).where(order.eqNullSafe(F.col("a")) & order.eqNullSafe(F.col("b"))).drop("a", "b"))
        out = out.unionByName(taken)
        large = written(large.join(taken.select(page, "pred"), [page, "pred"], "left_anti").join(taken.select(page, "true"), [page, "true"], "left_anti"))
    return out


def detection(pred: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """AGG-33: true and false positives, false negatives, precision, recall, F1 and mean IoU over all pages."""
    side = lambda df, p, t, m, iou: df.select(F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(m).alias("m"), iou.alias("iou"))
    none = F.lit(None).cast("double")
    every = side(pred, 1, 0, 0, none).unionByName(side(truth, 0, 1, 0, none)).unionByName(side(matched, 0, 0, 1, F.col("iou")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = every.agg(total("p").alias("n_pred"), total("t").alias("n_true"), total("m").alias("tp"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return got.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("n_pred")).alias("precision"), ratio(F.col("tp"), F.col("n_true")).alias("recall"), ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_true")).alias("f1"), "mean_iou")


def structure(matched: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """AGG-34: over matched pairs the share with equal rows, with equal columns, with both."""
    side = lambda df, name: df.select(F.col("id").alias(name), F.col("rows").alias(f"{name}_rows"), F.col("cols").alias(f"{name}_cols"))
    got = matched.join(side(pred, "pred"), "pred").join(side(truth, "true"), "true")
    rows, cols = F.col("pred_rows") == F.col("true_rows"), F.col("pred_cols") == F.col("true_cols")
    share = lambda c: F.avg(c.cast("double"))
    return got.agg(share(rows).alias("rows"), share(cols).alias("cols"), share(rows & cols).alias("structure"))


def cell_match(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """JN-13, MTH-12: cells of the same place, and the share of true and predicted places whose cells are equal."""
    both = pred.withColumnRenamed("value", "p").join(truth.withColumnRenamed("value", "t"), [*keys, "row", "col"], "full_outer")
    return both.groupBy(*keys).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("shared"), F.count_if(F.col("p") == F.col("t")).alias("equal"), F.count("*").alias("places")).withColumn("match", F.col("equal") / F.col("places"))


def inside(points: DataFrame, areas: DataFrame, page: str = "page") -> DataFrame:
    """JN-14: points with the boxes of their page that hold them; points and boxes meet in grid cells."""
    at = lambda c: F.floor(F.col(c) / CELL).cast("int")
    p = points.select(page, F.col("id").alias("point"), "x", "y", at("x").alias("gx"), at("y").alias("gy"))
    a = areas.select(page, F.col("id").alias("area"), "x0", "y0", "x1", "y1", F.explode(F.sequence(at("x0"), at("x1"))).alias("gx")).select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("gy"))
    return p.join(a, [page, "gx", "gy"]).where("x between x0 and x1 and y between y0 and y1").select(page, "point", "area")


def best_band(cells: DataFrame, bands: DataFrame, page: str, low: str, high: str, name: str) -> DataFrame:
    """JN-16 (y) and JN-17 (x): the band that covers the largest share of each cell's extent; ties go to the first, no overlap to band 0."""
    b = bands.select(page, F.struct(F.col("band"), F.col("low"), F.col("high")).alias("b")).groupBy(page).agg(F.array_sort(F.collect_list("b")).alias("bands"))
    share = lambda x: F.greatest(F.least(F.col(high), x["high"]) - F.greatest(F.col(low), x["low"]), F.lit(0.0)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
    best = F.array_max(F.transform("bands", lambda x: F.struct(share(x).alias("share"), (-x["band"]).alias("band"))))
    return cells.join(b, page, "left").withColumn(name, F.when(best["share"] > 0, -best["band"]).otherwise(0)).drop("bands")


def suppress(regions: DataFrame, page: str = "page", most: float = 0.5) -> DataFrame:
    """SRT-10: regions from the largest down, kept unless a kept one covers more than ``most`` of the smaller of the two.

    Regions that cover each other so meet in grid cells.  On pages of up to ``LARGE`` such pairs the order is followed in groups of
    many pages; on larger ones a region is kept once all before it that it meets are decided and none of them is kept.
    """
    both = meeting(regions, regions, page, "a", "b").where("a_id <> b_id")
    area_of = lambda c: F.greatest(area(F.col(c)), F.lit(1e-9))
    both = both.where(shared(F.col("a"), F.col("b")) / F.least(area_of("a"), area_of("b")) > most)
    before = (area_of("a") > area_of("b")) | ((area_of("a") == area_of("b")) & (F.col("a_id") < F.col("b_id")))
    # ``first`` comes before ``then``.
    pairs = written(both.where(before).select(page, F.col("a_id").alias("first"), F.col("b_id").alias("then"), area_of("b").alias("size")))
    small, large, groups = by_size(pairs, page)

    def decide(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["size", "then"], ascending=[False, True], kind="stable")
        gone: set = set()
        for k, x, y in zip(p[page], p["first"], p["then"]):
            if (k, x) not in gone:
                gone.add((k, y))
        keys = [(k, y) for k, y in zip(p[page], p["then"])]
        return p[np.array([x in gone for x in keys], bool)][[page, "then"]].drop_duplicates()

    kinds = dict(pairs.dtypes)
    schema = f"`{page}` {kinds[page]}, then {kinds['then']}"
    gone = small.groupBy(F.pmod(F.xxhash64(page), F.lit(groups))).applyInPandas(decide, schema)
    while not large.isEmpty():
        # Regions that nothing undecided comes before stay, those that they meet go.
        stay = large.select(page, F.col("first").alias("id")).distinct().join(large.select(page, F.col("then").alias("id")), [page, "id"], "left_anti")
        lost = written(large.join(stay.withColumnRenamed("id", "first"), [page, "first"], "left_semi").select(page, "then").distinct())
        gone = gone.unionByName(lost)
        left = large.join(lost, [page, "then"], "left_anti").join(lost.withColumnRenamed("then", "first"), [page, "first"], "left_anti")
        large = written(left)
    return regions.join(gone.withColumnRenamed("then", "id"), [page, "id"], "left_anti").select(*regions.columns)
