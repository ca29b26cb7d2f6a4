"""Longest-processing-time sharding of groups that must stay together.

Groups are rows of equal text.  Sorted by size, the largest first, each goes to the least-loaded shard,
which a heap gives.  Groups of one size are interchangeable, so the driver needs no more than how many
groups have each size: it hands out a size's groups all at once, filling the shards to a common level and
passing the rest through the heap, and says how many of them each shard gets.  The result is that of the
heap with one entry a group.  With total bytes ``T`` there are at most ``sqrt(2 T)`` sizes, as different sizes
add up: that bounds what the driver holds.  Law: ``bytes``.

Cases: null text has no bytes and counts as the empty text; very long texts count whole; repeated rows are
one group; ties go by size, then digest of the text, then the lowest shard number; rows without an id are
sharded like others; other columns, whatever their names, are never read; an empty table gives an empty
result; shards may stay empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.llm.common import drop_written, written

#: Rows that share one numbering task, about; a group of more than this share of all rows is found by broadcast.
NUMBERED, HOT = 100_000, 1 / 1000


def deal(load: list[int], size: int, groups: int) -> tuple[list[int], list[int]]:
    """Hand ``groups`` groups of ``size`` to the least-loaded shard each: how many each shard gets before the heap, and the shards of the last ones in order.

    ``load`` is updated.  The shards before the heap are filled to one level, which the next groups would reach in any order.
    """
    counts = [0] * len(load)
    if groups > 2 * len(load):
        low, high = min(load), max(load) + size * (groups + 1)
        at = np.array(load, object)
        below = lambda level: sum(max(0, -(-(level - x) // size)) for x in at)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if below(middle) <= groups else (low, middle)
        counts = [max(0, -(-(low - x) // size)) for x in load]
        for k, n in enumerate(counts):
            load[k] += n * size
    heap = [(x, k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    order = []
    for _ in range(groups - sum(counts)):
        x, k = heap[0]
        order.append(k)
        load[k] = x + size
        heapq.heapreplace(heap, (x + size, k))
    return counts, order


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int] | None, list[int]]]:
    """For each (size, groups), the largest first: (size, cumulative counts before the heap or null, shards of the groups after them)."""
    load, out = [0] * shards, []
    for size, groups in sorted(sizes, reverse=True):
        counts, order = deal(load, size, groups)
        out.append((size, np.cumsum(counts).tolist() if any(counts) else None, order))
    return out


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``id_col``, ``size`` (UTF-8 bytes plus ``overhead``), ``text_crc32``, ``shard`` and ``slot``, gapless from 0 in each shard.

    Texts are read once and never shuffled: rows travel as digests.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows, _ = written(df.select(F.col(id_col).alias("id"), (F.length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.unhex(F.md5(raw)).alias("key")))
    groups, path = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("m"), F.sum("n").alias("n")).toArrow()
    n, most = sum(sizes.column("n").to_pylist()), max(sizes.column("m").to_pylist(), default=0)
    placed = schedule(list(zip(sizes.column("bytes").to_pylist(), sizes.column("m").to_pylist())), shards)
    cols = list(zip(*placed)) or [[]] * 3
    longs = pa.list_(pa.int64())
    classes = spark.createDataFrame(pa.table({"bytes": pa.array(cols[0], pa.int64()), "ends": pa.array(cols[1], longs), "order": pa.array(cols[2], longs)}))
    ranked = numbered(groups, ["bytes"], max(1, -(-most // NUMBERED)), ["key"], "rank")
    filled = F.coalesce(F.element_at("ends", -1), F.lit(0))
    to = F.when(F.col("rank") < filled, F.size(F.filter("ends", lambda x: x <= F.col("rank")))).otherwise(F.try_element_at("order", (F.col("rank") - filled + 1).cast("int"))).cast("int")
    found, found_path = written(ranked.join(classes, "bytes").select("key", "n", to.alias("shard")))
    drop_written(spark, path)
    # Rows find their group's shard by digest; the few groups with a large share of all rows, fewer than 1 / HOT, meet them by broadcast.
    hot = F.col("n") > max(int(n * HOT), 200)
    often = F.broadcast(found.where(hot).select("key", F.col("shard").alias("hot_shard")))
    rows = rows.join(often, "key", "left")
    rest = rows.where("hot_shard is null").join(found.where(~hot).select("key", "shard"), "key").select("id", "size", "crc", "shard")
    dealt = rows.where("hot_shard is not null").select("id", "size", "crc", F.col("hot_shard").alias("shard")).unionByName(rest)
    dealt = numbered(dealt, ["shard"], max(1, -(-n // (shards * NUMBERED))), ["id", "crc", "size"], "slot")
    return dealt.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def numbered(df: DataFrame, by: list[str], blocks: int, order: list[str], name: str) -> DataFrame:
    """``name``: a gapless number from 0 among the rows of equal ``by``.  Rows are numbered in ``blocks`` by the hash of ``order``; a block starts after the ones before."""
    df = df.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    nth = F.row_number().over(Window.partitionBy(*by, "block").orderBy(*order)) - 1
    if blocks == 1:
        return df.withColumn(name, nth.cast("long"))
    counts = df.groupBy(*by, "block").agg(F.count("*").alias("in_block"))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("start"))
    return df.withColumn("nth", nth).join(starts, [*by, "block"]).withColumn(name, F.col("start") + F.col("nth"))
