"""Scores of pairs of tables too large for one call, against plain Python."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridgauge.operators import metrics

PAIR = "k long, pred_headers array<string>, pred_rows array<array<string>>, true_headers array<string>, true_rows array<array<string>>"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def summed(a, b):
    def jaccard(x, y):
        x, y = Counter(x), Counter(y)
        every = sum((x | y).values())
        return sum((x & y).values()) / every if every else 1.0

    return sum(max(jaccard(x, y) for y in b) for x in a) if b else 0.0


def test_edits_like_a_matrix():
    rng = random.Random(3)
    for n in range(1500):
        kinds = rng.choice((1, 2, 3, 9))
        a = [rng.randrange(kinds) for _ in range(rng.randrange(30))]
        b = [x if rng.random() < 0.9 else rng.randrange(kinds) for x in a if rng.random() < 0.9] if n % 2 else [rng.randrange(kinds) for _ in range(rng.randrange(30))]
        assert metrics.edits(np.array(a, np.int64), np.array(b, np.int64)) == edit(a, b), (a, b)


def test_edits_of_repeats_longer_than_a_stride():
    one = np.zeros(3 * metrics.STRIDE, np.int64)
    other = one.copy()
    other[[5, metrics.STRIDE, 2 * metrics.STRIDE + 1]] = 1
    assert metrics.edits(one, one) == 0 and metrics.edits(one, other) == 3 and metrics.edits(one, one[:-7]) == 7 and metrics.edits(one[:0], one) == len(one)


def test_edits_of_near_equal_tables_take_time_by_length():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 5000, 1_000_000)
    other = np.delete(tokens, rng.choice(len(tokens), 60, replace=False))
    other[rng.choice(len(other), 40, replace=False)] = 5001
    start = time.perf_counter()
    assert 60 <= metrics.edits(tokens, other) <= 100
    assert time.perf_counter() - start < 5  # the whole matrix has 10^12 places


def test_best_lines_like_all_against_all(monkeypatch):
    rng = random.Random(4)
    for few in (0, 1, 64):
        monkeypatch.setattr(metrics, "FEW", few)
        for _ in range(150):
            table = lambda: [[rng.choice("aaabcdef") for _ in range(rng.randrange(7))] for _ in range(rng.randrange(9))]
            a, b = table(), table()
            assert abs(metrics.likeness(a, b) - summed(a, b)) < 1e-9, (a, b)


def test_blocks_give_what_one_call_gives(spark, monkeypatch):
    rng = random.Random(6)
    table = lambda: ([rng.choice("ab") for _ in range(rng.randrange(3))], [[rng.choice("aabc") for _ in range(rng.randrange(5))] for _ in range(rng.randrange(12))])
    rows = [(k, *table(), *table()) for k in range(60)] + [(60, [], [[]], [], [[]]), (61, [], [], [], []), (62, [], [["a"] * 9], [], []), (None, *table(), ["a"], [["b", "c"]] * 9)]
    df = spark.createDataFrame(rows, PAIR)
    whole = {r.k: r for r in metrics.grits(df, ["k"]).collect()}
    monkeypatch.setattr(metrics, "BLOCK", 4)
    parts = {r.k: r for r in metrics.grits(df, ["k"]).collect()}
    assert whole.keys() == parts.keys() and len(whole) == len(rows)
    for k, r in whole.items():
        assert all(abs(r[m] - parts[k][m]) < 1e-9 for m in ("grits_top", "grits_con", "grits_loc")), k


def test_one_large_pair_spreads_over_tasks(spark):
    """One pair of 100,000 rows of ten cells, of which every hundredth differs in a cell and every thousandth in all."""
    n = F.col("id")
    cells = lambda changed: F.array(*[F.when(n % 1000 == 0, F.concat(F.lit(changed), n.cast("string"))).otherwise(F.concat(F.lit(f"c{j} "), (n % (50 + j)).cast("string"))) for j in range(8)], F.concat(F.lit("r"), n.cast("string")), F.when(n % 100 == 1, changed).otherwise("same"))
    rows = spark.range(0, 100_000, 1, 8).groupBy().agg(F.collect_list(cells("x")).alias("pred_rows"), F.collect_list(cells("y")).alias("true_rows"))
    heads = F.array(*[F.lit(f"h{j}") for j in range(10)])
    pair = rows.select(F.lit(1).cast("long").alias("k"), heads.alias("pred_headers"), "pred_rows", heads.alias("true_headers"), "true_rows")
    sides = pair.select("k", metrics.grid(F.col("pred_headers"), F.col("pred_rows")).alias("a"), metrics.grid(F.col("true_headers"), F.col("true_rows")).alias("b"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spread = metrics.spread(metrics.blocks(sides, ["k"]), ["k"]).select(F.spark_partition_id().alias("task"), F.size("a").alias("n")).collect()
        assert len({r.task for r in spread}) >= 4 and sum(r.n for r in spread) == 100_001
        got = metrics.grits(pair, ["k"]).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    every_thousandth, every_hundredth = 100, 1000
    # rows that differ wholly still share their number and "same" (2 of 18 cells); the others all but one cell (9 of 11)
    want = (100_001 - every_thousandth - every_hundredth + every_thousandth * 2 / 18 + every_hundredth * 9 / 11) / 100_001
    assert got.grits_top == 1.0 and abs(got.grits_con - want) < 1e-9 and 0.97 < got.grits_loc < 1.0
