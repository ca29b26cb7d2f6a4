"""MTH-01 to MTH-06: scores of predicted tables against true ones.

Pairs have key columns and the arrays ``pred_headers``, ``pred_rows``, ``true_headers``, ``true_rows``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text

#: Most tokens that are compared at once along a diagonal.
STRIDE = 4096
#: A diagonal that no edits have come to.
UNSEEN = -(1 << 40)
#: Cells of a block of lines; a pair with more than that goes to several tasks.
BLOCK = 200_000
#: Lines that are looked at one by one before all are counted.
FEW = 64


def normal(rows: Column) -> Column:
    return F.transform(F.coalesce(rows, tb.no_rows()), lambda r: F.transform(r, text.cell))


def cell_f1(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MTH-01, SET-01 to SET-03: true and false positives, false negatives, precision, recall, F1 over body cells as multisets.

    One shuffle by key and cell, map-side combined, then one by key; no join.  Pairs without a cell have zeros.
    """
    cells = lambda c, p, t: pairs.select(*keys, F.explode_outer(F.flatten(normal(F.col(c)))).alias("cell")).select(*keys, "cell", F.lit(p).alias("p"), F.lit(t).alias("t"))
    each = cells("pred_rows", 1, 0).unionByName(cells("true_rows", 0, 1)).groupBy(*keys, "cell").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    held = F.col("cell").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(held, c)), F.lit(0))
    got = each.groupBy(*keys).agg(count(F.least("p", "t")).alias("tp"), count(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("fp"), count(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"))


def tokens(headers: Column, rows: Column) -> Column:
    """MTH-03: tags and cell texts in order; empty texts give no token."""
    row = lambda r: F.concat(F.array(F.lit("<tr>")), F.flatten(F.transform(r, lambda x: F.filter(F.array(F.lit("<td>"), text.cell(x), F.lit("</td>")), lambda y: y != ""))), F.array(F.lit("</tr>")))
    heads = F.coalesce(headers, tb.no_cells())
    every = F.concat(F.when(F.size(heads) > 0, F.array(heads)).otherwise(tb.no_rows()), F.coalesce(rows, tb.no_rows()))
    return F.concat(F.array(F.lit("<table>")), F.flatten(F.transform(every, row)), F.array(F.lit("</table>")))


def reach(a: np.ndarray, b: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How far equal tokens carry each place ``i`` of ``a`` along diagonal ``k`` (``i`` less the place in ``b``).

    ``a`` and ``b`` end in ``STRIDE`` tokens that equal none of the other's.
    """
    i = i.copy()
    live = np.flatnonzero(a[i] == b[i - k])
    width = 8
    while live.size:
        width = int(min(2 * width, STRIDE, max(16, STRIDE * 256 // live.size)))
        x, y = sliding_window_view(a, width)[i[live]], sliding_window_view(b, width)[i[live] - k[live]]
        same = x == y
        whole = same.all(1)
        i[live] += np.where(whole, width, same.argmin(1))
        live = live[whole]
    return i


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two sequences of token numbers, by the furthest place that each diagonal reaches with 0, 1, 2.. edits.

    Only diagonals within the number of edits, and near enough to the end for the bound so far, are looked at: time goes by the
    length and the square of the distance, memory by the length.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    x, y = np.concatenate((a, np.full(STRIDE, -1))), np.concatenate((b, np.full(STRIDE, -2)))
    zero, last = m + 1, n - m  # places of diagonal 0 and of the end's
    far = np.full(n + m + 3, UNSEEN)
    far[zero : zero + 1] = reach(x, y, np.zeros(1, np.int64), np.zeros(1, np.int64))
    done, most = 0, max(n, m)
    while far[zero + last] < n:
        done += 1
        room = most - done
        k = np.arange(max(-done, -m, last - room), min(done, n, last + room) + 1)
        at = k + zero
        i = np.maximum(np.maximum(far[at], far[at - 1]) + 1, far[at + 1])
        i = np.minimum(i, np.minimum(n, m + k))
        far[at] = np.where(i < 0, UNSEEN, reach(x, y, np.maximum(i, np.maximum(k, 0)), k))
    return done


def distances(a: pa.Array, b: pa.Array) -> list[int]:
    """Edit distance of each list of ``a`` to that of ``b``, tokens numbered once for all of them."""
    ends = [np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))) for x in (a, b)]
    codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    x, y = codes[: ends[0][-1]], codes[ends[0][-1] :]
    return [edits(x[ends[0][r] : ends[0][r + 1]], y[ends[1][r] : ends[1][r + 1]]) for r in range(len(a))]


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of tokens."""
    return distances(*(pa.array([x], pa.list_(pa.string())) for x in (a, b)))[0]


def teds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MTH-02: 1 less the token edit distance over the longer sequence's length; in Arrow batches, without a shuffle."""
    t = pairs.select(*keys, tokens(F.col("pred_headers"), F.col("pred_rows")).alias("a"), tokens(F.col("true_headers"), F.col("true_rows")).alias("b"))
    kinds = dict(t.dtypes)

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            longest = pc.max_element_wise(a.value_lengths(), b.value_lengths())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(distances(a, b), pa.int32()), longest], names=[*keys, "distance", "longest"])

    got = t.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "distance int, longest int"]))
    return got.withColumn("teds_score", 1 - F.col("distance") / F.col("longest"))


def grid(headers: Column, rows: Column) -> Column:
    heads = F.transform(F.coalesce(headers, tb.no_cells()), text.cell)
    return F.concat(F.when(F.size(heads) > 0, F.array(heads)).otherwise(tb.no_rows()), normal(rows))


def columns_of(g: Column) -> Column:
    """Columns of a grid; rows that are too short have no cell in a column."""
    return F.transform(tb.numbers_to(F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0))), lambda i: F.transform(F.filter(g, lambda r: F.size(r) > i), lambda r: F.get(r, i)))


def multiset(line: list[str]) -> frozenset:
    """Cells of a line, each with how many of its like came before it: sets that share what the multisets share."""
    seen: Counter = Counter()
    out = []
    for cell in line:
        out.append((cell, seen[cell]))
        seen[cell] += 1
    return frozenset(out)


class Shelf:
    """Distinct lines of a table with the places of each cell, for the best likeness of any other line."""

    def __init__(self, lines: list[list[str]]):
        self.lines = list(dict.fromkeys(map(multiset, lines)))
        self.known = dict.fromkeys(self.lines, 1.0)
        self.sizes = np.array([len(x) for x in self.lines])
        places: dict = {}
        for j, line in enumerate(self.lines):
            for e in line:
                places.setdefault(e, []).append(j)
        self.places = {e: np.array(at) for e, at in places.items()}

    def best(self, line: list[str]) -> float:
        own = multiset(line)
        if own not in self.known:
            self.known[own] = self.search(own)
        return self.known[own]

    def search(self, own: frozenset) -> float:
        """Cells from rare to common: a line first met at a cell shares no more than what is left, and one that is much longer or shorter no more than its length allows."""
        cells = sorted((e for e in own if e in self.places), key=lambda e: len(self.places[e]))
        best, met = 0.0, set()
        for left, e in zip(range(len(cells), 0, -1), cells):
            if best >= left / len(own):
                return best
            if len(self.places[e]) > FEW:
                break
            for j in self.places[e]:
                size = len(self.lines[j])
                if j not in met and min(size, len(own)) / max(size, len(own)) > best:
                    shared = len(own & self.lines[j])
                    best = max(best, shared / (len(own) + size - shared))
                met.add(j)
        else:
            return best
        shared = np.zeros(len(self.lines), np.int64)
        for e in cells:
            shared[self.places[e]] += 1
        return max(best, float((shared / (len(own) + self.sizes - shared)).max()))


def likeness(a: list[list[str]], b: list[list[str]]) -> float:
    """Sum over the lines of ``a`` of the best likeness to any of ``b``, shared cells over all cells as multisets; without lines in ``b`` 0.  Not symmetric."""
    if not b:
        return 0.0
    shelf = Shelf(b)
    return sum((shelf.best(line) for line in a), 0.0)


def likenesses(a: pa.Array, b: pa.Array) -> list[float]:
    """``likeness`` of each pair; only one pair's cells are Python's at a time, however many a batch has."""
    return [likeness(a[k].as_py(), b[k].as_py()) for k in range(len(a))]


def blocks(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of about ``BLOCK`` cells of the lines ``a``, each with all of ``b``: (keys, part, later, a, b); ``later`` where there are several."""
    parts = F.greatest(F.lit(1), F.least(F.size("a"), F.ceil(F.size(F.flatten("a")) / BLOCK).cast("int")))
    each = sides.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = lambda p: F.floor(p * F.size("a") / F.col("parts")).cast("int")
    own = F.when(F.col("parts") > 1, F.slice("a", first(F.col("part")) + 1, first(F.col("part") + 1) - first(F.col("part")))).otherwise(F.col("a"))
    return each.select(*keys, "part", (F.col("parts") > 1).alias("later"), own.alias("a"), "b")


def spread(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks to as many tasks as the session's shuffles have, also those of one pair."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "part")


def totals(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``total`` likeness of the blocks of each pair: (keys, total) rows to be added up.

    A pair of one block is worked where it is, and only its figure moves; the blocks of larger ones are spread first.
    """
    parts = blocks(sides, keys)
    kinds = dict(parts.dtypes)
    lines = pa.list_(pa.list_(pa.string()))
    own = [*keys, "part", "later"]

    def work(now: bool):
        def run(batches):
            for batch in batches:
                due = pc.equal(batch.column("later"), now)
                for b, fresh in ((batch.filter(due), True), (batch.filter(pc.invert(due)), False)):
                    if b.num_rows:
                        said = pa.array(likenesses(b.column("a"), b.column("b")), pa.float64()) if fresh else b.column("total")
                        kept = [b.column(k) for k in (keys if now else own)]
                        moved = [] if now else [pa.nulls(b.num_rows, lines) if fresh else b.column(c).cast(lines) for c in ("a", "b")]
                        yield pa.RecordBatch.from_arrays([*kept, *moved, said], names=[*(keys if now else [*own, "a", "b"]), "total"])

        return run

    schema = lambda names: ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", total double"
    first = parts.withColumn("total", F.lit(None).cast("double")).mapInArrow(work(False), schema([*own, "a", "b"]))
    return spread(first, keys).mapInArrow(work(True), schema(keys))


def grits(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MTH-04 to MTH-06: likeness of shape, of rows and of columns; tables of more than ``BLOCK`` cells go to several tasks.  Keys tell pairs apart."""
    t = pairs.select(*keys, grid(F.col("pred_headers"), F.col("pred_rows")).alias("p"), grid(F.col("true_headers"), F.col("true_rows")).alias("t"))
    t = t.withColumns({"pc": columns_of(F.col("p")), "tc": columns_of(F.col("t"))}).withColumns({f"n_{c}": F.size(c) for c in ("p", "t", "pc", "tc")})
    ratio = lambda a, b: F.when(F.greatest(F.size(a), F.size(b)) > 0, F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))).otherwise(1.0)
    none, one = (F.size("p") == 0) & (F.size("t") == 0), (F.size("p") == 0) | (F.size("t") == 0)
    t = t.withColumn("grits_top", F.when(none, 1.0).when(one, 0.0).otherwise(ratio("p", "t") * ratio("pc", "tc")))
    of = [*keys, "grits_top", "n_p", "n_t", "n_pc", "n_tc"]
    sides = F.inline(F.array(*[F.struct(F.lit(name).alias("side"), F.col(a).alias("a"), F.col(b).alias("b")) for name, a, b in (("con", "p", "t"), ("loc", "pc", "tc"))]))
    got = totals(t.select(*of, sides), [*of, "side"]).groupBy(*of).agg(*[F.sum(F.when(F.col("side") == s, F.col("total"))).alias(s) for s in ("con", "loc")])
    mean = lambda total, n, m: F.when((F.col(n) > 0) & (F.col(m) > 0), F.try_divide(total, F.col(n))).otherwise((F.col(n) + F.col(m) == 0).cast("double"))
    return got.select(*keys, "grits_top", mean(F.col("con"), "n_p", "n_t").alias("grits_con"), mean(F.col("loc"), "n_pc", "n_tc").alias("grits_loc"))


def scores(pairs: DataFrame, keys: list[str], zero: Column | None = None) -> DataFrame:
    """All seven metrics; where ``zero`` holds (POL-10) they are all 0."""
    got = cell_f1(pairs, keys).join(teds(pairs, keys), keys).join(grits(pairs, keys), keys)
    names = ("precision", "recall", "f1_score", "teds_score", "grits_top", "grits_con", "grits_loc")
    if zero is None:
        return got.select(*keys, *names)
    flags = pairs.select(*keys, F.coalesce(zero, F.lit(False)).alias("zero"))
    return got.join(flags, keys).select(*keys, *[F.when(F.col("zero"), 0.0).otherwise(F.col(m)).alias(m) for m in names])
