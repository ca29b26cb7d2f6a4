"""Groups of any size spread over tasks: selection, box matching by rounds, regions of sparse sheets."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgauge.operators import boxes, rollup, sequences


@pytest.mark.parametrize("few", [True, False])
def test_selection(spark, few):
    rng = random.Random(1)
    groups = {"one": [5.0], "same": [2.0] * 40, "many": [rng.gauss(0, 1) for _ in range(3001)], "even": [float(rng.randrange(9)) for _ in range(500)], "two": [1.0, 2.0], "skew": [rng.paretovariate(0.3) for _ in range(800)] + [0.0] * 900}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in rollup.five_numbers(["g"], df, F.col("v"), few).collect()}
    middle = {r.g: r.median for r in rollup.medians(["g"], df, F.col("v"), few).collect()}
    assert got.keys() == groups.keys() == middle.keys()
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        at = lambda p: s[int(np.floor(p * (n - 1) + 0.5))]  # noqa: E731, B023
        assert tuple(got[g])[1:] == (s[0], at(0.25), at(0.5), at(0.75), s[-1], n) and middle[g] == statistics.median(vs)


def test_selection_sorts_pieces_only(spark):
    """No window sorts a whole group: the only ones by value are by piece."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = rollup.five_numbers(["g"], df, F.col("v"))._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Window [" in line and "v#" in line.split("], [")[-1]]
    assert by_value and all("piece" in line for line in by_value)


def some_boxes(rng, n, pages, wide):
    return [(rng.randrange(pages), k, x := rng.randrange(wide), y := rng.randrange(wide), x + rng.choice((30, 40, 60)), y + rng.choice((30, 45))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(p, k, float(a), float(b), float(c), float(d)) for p, k, a, b, c, d in rows], "page long, id long, x0 double, y0 double, x1 double, y1 double")


def over(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def size(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def test_match_and_suppress(spark, monkeypatch):
    """One page that holds most boxes and some small ones; in groups, by rounds, and one box after the other."""
    rng = random.Random(7)
    pred, true = (some_boxes(rng, 250, 1, 500) + [(1 + k % 5, 1000 + k, *b[2:]) for k, b in enumerate(some_boxes(rng, 60, 1, 200))] for _ in range(2))
    pairs = sorted((-(s := over(a, b)) / (size(a) + size(b) - s), a[1], b[1], a[0]) for a in pred for b in true if a[0] == b[0] and over(a, b) / (size(a) + size(b) - over(a, b)) >= 0.2)
    used, want = set(), []
    for far, x, y, page in pairs:
        if (0, page, x) not in used and (1, page, y) not in used:
            used |= {(0, page, x), (1, page, y)}
            want.append((page, x, y, round(-far, 9)))
    kept = []
    for r in sorted(pred, key=lambda r: (-size(r), r[1])):
        if all(k[0] != r[0] or over(r, k) / max(min(size(r), size(k)), 1e-9) <= 0.5 for k in kept):
            kept.append(r)
    for large in (boxes.LARGE, 20):
        monkeypatch.setattr(boxes, "LARGE", large)
        got = [(r.page, r.pred, r.true, round(r.iou, 9)) for r in boxes.match(frame(spark, pred), frame(spark, true), least=0.2).collect()]
        assert sorted(got) == sorted(want) and len(want) > 60
        assert sorted(r.id for r in boxes.suppress(frame(spark, pred)).collect()) == sorted(k[1] for k in kept)
    assert boxes.match(frame(spark, []), frame(spark, true)).count() == 0 and boxes.suppress(frame(spark, [])).count() == 0


def grown(cells, density):
    """As stated, over a dense grid."""
    full = {(r, c) for r, c, v in cells if v and v.strip()}
    if not full:
        return None
    rows, cols = max(r for r, _, _ in cells) + 1, max(c for _, c, _ in cells) + 1
    r0, c0 = min(full)
    c1 = c0
    while c1 + 1 < cols and sum((r, c1 + 1) in full for r in range(r0, rows)) / (rows - r0) > density:
        c1 += 1
    r1 = r0
    while r1 + 1 < rows and sum((r1 + 1, c) in full for c in range(c0, c1 + 1)) / (c1 - c0 + 1) > density:
        r1 += 1
    return r0, c0, r1, c1


def test_regions(spark):
    rng = random.Random(9)
    sheets = {k: [(rng.randrange(9), rng.randrange(7), rng.choice(("x", "x", " ", None))) for _ in range(rng.choice((1, 5, 30)))] for k in range(150)}
    df = spark.createDataFrame([(k, *c) for k, cells in sheets.items() for c in cells], "k long, r int, c int, v string")
    for density in (0.0, 0.1, 0.4):
        got = {r.k: tuple(r)[1:] for r in sequences.grown_region(df, ["k"], density=density).collect()}
        # A place that is said twice is full if either says so.
        assert got == {k: w for k, cells in sheets.items() if (w := grown(cells, density))}


def test_far_cell(spark):
    cells = [(1, r, c, "x") for r in range(3) for c in range(4)] + [(1, 1_048_575, 16_383, "y")]
    got = sequences.grown_region(spark.createDataFrame(cells, "k long, r int, c int, v string"), ["k"], density=0.0).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 2, 3)]


def test_state_goes_on_over_blocks(spark):
    """Groups longer than a block, null keys, and many groups in a block."""
    rng = random.Random(5)
    rows = [(g, k, rng.choice("abcd") * rng.randrange(1, 3) + rng.choice(("", "e")), float(y)) for g, n in (("a", 400), (None, 90), *((f"g{j}", 3) for j in range(60))) for k, y in enumerate(sorted(rng.sample(range(3 * n * 9), n)))]
    df = spark.createDataFrame(rows, "g string, k int, v string, y double").repartition(3)

    def plain(own, start, step):
        state, out = start(), []
        for r in own:
            out.append(step(state, r))
        return out

    def mean(state, r):
        if state and abs(r[3] - sum(state[-1]) / len(state[-1])) <= 20:
            state[-1].append(r[3])
        else:
            state.append([r[3]])
        return len(state) - 1

    def lead(state, r):
        s = set(r[2])
        k = next((k for k, h in enumerate(state) if len(s & h) / len(s | h) >= 0.8), len(state))
        if k == len(state):
            state.append(s)
        return k

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        clusters = {(r.g, r.k): r.cluster for r in sequences.clusters_by_running_mean(df, ["g"], "y").collect()}
        first = {(r.g, r.k): r.leader for r in sequences.leaders(df, ["g"], "k", "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        assert [clusters[g, r[1]] for r in own] == plain(own, list, mean) and [first[g, r[1]] for r in own] == plain(own, list, lead)
