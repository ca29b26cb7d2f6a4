"""Runs of repeated words: stretches that keep a smallest period and can't be extended.

Every run holds a Lyndon word as long as its period that is the longest Lyndon word at its place, under one of the
two orders of words.  For each order, a stack is scanned from right to left: the longest Lyndon word at a place ends
where the next smaller suffix starts.  Suffixes are compared, and repeated words extended to both sides, by the
longest common extension, which a binary search over rolling hashes finds and a comparison of the words themselves
confirms; what is confirmed for a distance isn't compared again.  Hashes wrap at 64 bits: where they agree on what
differs, the words decide.

A run of three periods holds each of its words three times.  So words that a text (then: a stretch of it) holds less
often part it, and stretches shorter than the shortest run are left out; this loses no run.

Cases: null text is empty and has no runs; repeated rows come out alike; rows without an id are kept; of runs as
strong as each other all are returned, by start, then period; other columns, whatever their names, are never read;
an empty table gives an empty result; texts are read whole, and memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: How often stretches are parted by their rare words before they are searched, so that the parting's time is bounded.
PARTINGS = 8
BASE = 0x9E3779B97F4A7C15 | 1
WRAP = (1 << 64) - 1

Run = tuple[int, int, int]


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate((out, out * np.uint64(pow(BASE, len(out), 1 << 64))))
    return out[: n + 1]


class Extensions:
    """Longest common extensions of the suffixes and prefixes of ``words``, exact."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.power = powers(self.n)
        hashes = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[:-1], dtype=np.uint64)))
        self.as_array, self.hashes, self.factor = hashes, hashes.tolist(), self.power.tolist()
        #: By distance: where the words are known to agree, and to differ right behind.
        self.known: dict[int, tuple[int, int]] = {}

    def agree(self, i: int, j: int, n: int) -> bool:
        h = self.hashes
        return ((h[i + n] - h[i]) * self.factor[j - i] - h[j + n] + h[j]) & WRAP == 0

    def right(self, i: int, j: int) -> int:
        """Words from ``i`` that agree with those from ``j > i``."""
        apart = j - i
        low, high = self.known.get(apart, (-1, -1))
        if low <= i <= high:
            return high - i
        n = self.search(lambda n: self.agree(i, j, n), self.n - j)
        # Confirm up to where the distance is known already.
        upto = low - i if low > i and low - i <= n else n
        differ = np.flatnonzero(self.words[i : i + upto] != self.words[j : j + upto])
        if len(differ):
            n = int(differ[0])
        elif upto < n or upto == low - i:
            n = high - i
        self.known[apart] = (i, i + n)
        return n

    def left(self, i: int, j: int) -> int:
        """Words before ``i`` that agree with those before ``j > i``."""
        n = self.search(lambda n: self.agree(i - n, j - n, n), i)
        differ = np.flatnonzero(self.words[i - n : i] != self.words[j - n : j])
        return n - 1 - int(differ[-1]) if len(differ) else n

    @staticmethod
    def search(agree, most: int) -> int:
        """The greatest n up to ``most`` at which hashes agree: doubling, then halving."""
        low, high = 0, 1
        while high <= most and agree(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if agree(mid):
                low = mid
            else:
                high = mid
        return low


def next_smaller(values: list[int], ext: Extensions) -> list[int]:
    """For each suffix the start of the next one that is smaller; the end is smaller than all."""
    n = len(values)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, values[i]
        while j < n:
            other = values[j]
            if own == other:
                same = ext.right(i, j)
                if j + same == n or values[i + same] > values[j + same]:
                    break
            elif own > other:
                break
            j = after[j]
        after[i] = j
    return after


def stretch_runs(words: np.ndarray, least: int, times: int) -> list[Run]:
    """Runs inside a stretch."""
    n, ext, found = len(words), Extensions(words), {}
    for values in (words.tolist(), (-words).tolist()):
        period = np.array(next_smaller(values, ext), np.int64) - np.arange(n)
        at = np.arange(n)
        # The first Lyndon word of a run of three periods and more is followed by its copy.
        fits = at + 2 * period <= n
        at, period = at[fits], period[fits]
        h, power = ext.as_array, ext.power
        same = (h[at + period] - h[at]) * power[period] == h[at + 2 * period] - h[at + period]
        last: dict[int, int] = {}
        for i, p in zip(at[same].tolist(), period[same].tolist()):
            if i + 2 * p <= last.get(p, 0):
                continue  # inside the run of this period that was found last
            stop = i + p + ext.right(i, i + p)
            start = i - ext.left(i, i + p)
            if stop - start >= 2 * p:
                last[p] = stop
                if stop - start >= max(least, times * p):
                    found[start, p] = stop - start
    return [(start, length, p) for (start, p), length in found.items()]


def runs(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run of at least ``least`` words and ``times`` (3 or more) periods, by start, then period."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    stretches, found = [(0, len(w), 0)], []
    while stretches:
        a, b, depth = stretches.pop()
        _, same, count = np.unique(w[a:b], return_inverse=True, return_counts=True)
        often = count[same] >= times
        if depth == PARTINGS or often.all():
            found += [(a + start, length, p) for start, length, p in stretch_runs(w[a:b], least, times)]
            continue
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], often.astype(np.int8), [0]))))
        longer = cuts[1::2] - cuts[::2] >= least
        stretches += [(a + x, a + y, depth + 1) for x, y in zip(cuts[::2][longer].tolist(), cuts[1::2][longer].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], found: Sequence[Run]) -> bytes:
    """The words without those that a run holds after its first period, parted by blanks."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, p in found:
        depth[start + p] += 1
        depth[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``id_col``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text with each run's first period only."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    kind = dict(df.dtypes)[id_col]
    of_run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            said, texts = [], []
            for text in b.column("text").to_pylist():
                words = text.encode().split()  # at ASCII white space only
                found = runs(words, least, times)
                said.append([{"start": a, "length": n, "period": p} for a, n, p in found])
                texts.append(collapsed(words, found))
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(said, of_run), pa.array(texts, pa.string())], names=[id_col, "runs", "collapsed"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run of the greatest length by period, compared exactly; ties: the smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    return F.array_sort(found, order)[0]


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = F.when(F.size("runs") > 0, strongest(F.col("runs")))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli")
    return rows.select(id_col, "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def with_planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 10) -> DataFrame:
    """Columns ``id_col`` and ``text_col``; one in ``one_in`` texts, by the id's CRC, repeats a stretch of its words to its end.

    Words are parted by ASCII white space; a text that is changed has them parted by one blank.  Rows without an id stay as they are.
    """
    hashed = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = with_text(df, text_col, (id_col, "id")).select("id", "text", (hashed % one_in == 0).alias("changed"), F.floor(hashed / one_in).alias("g"))
    words = F.array_remove(F.split(F.when(F.col("changed"), F.col("text")), "[\\x20\\x09-\\x0D]+"), "")
    rows = rows.select("id", "text", "g", words.alias("w")).select("id", "text", "g", "w", F.size("w").cast("long").alias("n"))
    start = F.col("g") % F.col("n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, start).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = (F.col("n") - F.col("a")).cast("int")
    copies = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), rest)), " ")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNull(), F.col("text")).otherwise(made).alias(text_col))
