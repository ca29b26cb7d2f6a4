"""SimHash near-duplicates with a vantage-point tree.

Fingerprints are made in one pass over the texts.  Distinct fingerprints are dealt into shards by the
upper levels of a vantage-point tree: each node holds a fingerprint ``v`` and a distance ``m``; items
within ``m`` of ``v`` go one way, the others the other way.  By the triangle bound two items within
``r`` of each other can part at a node only if the inner one lies at ``m + 1 - r`` or more, so just those
are sent along as visitors to the outer side, and visitors follow each branch that the bound leaves
open.  Inside a shard the tree goes on down to small leaves, which are compared exactly.  There each node measures all 64
bits and sends visitors; a branch ends early once all in it are linked, so a mass of near-equal fingerprints isn't
compared pair by pair.

A node of the upper levels may measure distance on all 64 bits (radius ``r``) or on a part of them.  Fingerprints are cut into
``r + c`` blocks; two within ``r`` of each other agree in at least ``c`` of them, so one tree for each choice of
``c`` blocks, with radius 0 on those, finds every pair.  Such a node sends no visitors, so the rows that are
shuffled are as many as there are choices, whatever the number of shards: 5 for each fingerprint with one
block, 15 with two.  ``c`` grows with the number of fingerprints (``choices``); the result doesn't depend on
it.  A shard that would hold too many is split further by the hash of its blocks, as linked ones agree in
them.  Linked fingerprints join inside a shard first; what is left between shards is closed by alternating
star contraction, each round a written table.

Cases: null text is empty; a text without words has fingerprint zero and links like any other; repeated
ids and rows are kept, an id's smallest reachable id is its component; rows without an id are kept, alone in
their component if no id is reachable; other columns, whatever their names, are never read; an empty table
gives an empty result; texts are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.llm.common import drop_written, per_batch, with_text, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FULL = 0xFFFFFFFFFFFFFFFF
#: Fingerprints that the upper tree is fitted to, at most; fingerprints of one shard, about; shards of one tree, at least.
SAMPLE, SHARD, LEAST_SHARDS = 16_384, 65_536, 8
LEAF = 256
#: An odd factor that spreads the bits of a fingerprint.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of one fingerprint from which it is hot: a thousandth of all, and this many.
HOT, HOT_ROWS = 1000, 200


def choices(n: int, radius: int) -> list[int]:
    """Masks of ``c`` of ``radius + c`` blocks of 64 bits, all choices; ``c`` is the least whose blocks have values enough for shards of ``SHARD``."""
    c = 1
    while (1 << 64 * c // (radius + c)) * SHARD < n and c < 4:
        c += 1
    cuts = [64 * k // (radius + c) for k in range(radius + c + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, c)]


def fingerprint(text: str, words: int = 4, block: int = 1 << 16) -> int:
    """Majority bits over the hashes of all word shingles of ``text``; ``block`` bounds memory."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return 0
    data = b" ".join(parts)
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    k = max(1, len(parts) - words + 1)
    starts, ends = starts[:k].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return majority((b"".join([digest(data[a:b], 42) for a, b in zip(starts[at : at + block], ends[at : at + block])]) for at in range(0, k, block)), k)


def majority(blocks: Iterable[bytes], k: int) -> int:
    """Fingerprint of ``k`` hashes of 8 bytes, the highest first, that come in blocks: the bits that over half of them have."""
    total = np.zeros(64, np.int64)
    for raw in blocks:
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > k).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col`` and ``fp``: the fingerprint as a signed long."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, words) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=[id_col, "fp"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, fp long")


class Tree:
    """Upper levels of a vantage-point tree: for each inner node mask, radius, vantage point, distance and children; leaves are shards."""

    def __init__(self, sample: np.ndarray, part: int, radius: int, leaf: int, seed: int = 7):
        self.nodes: list[tuple] = []
        self.shards = 0
        self.rng = np.random.default_rng(seed)
        self.root = self.grow(sample, part, radius, max(leaf, 2))

    def grow(self, x: np.ndarray, part: int, radius: int, leaf: int) -> int:
        """Number of the node, or -1 - shard of a leaf."""
        best = None
        if len(x) > leaf:
            for mask, r in ((part, 0), (FULL, radius)):
                v = x[self.rng.integers(len(x))]
                d = np.bitwise_count((x ^ v) & np.uint64(mask)).astype(np.int64)
                m = int(np.median(d))
                if m == d.max():
                    m -= 1
                inner = int((d <= m).sum())
                if not 0 < inner < len(x):
                    continue
                sent = ((d <= m) & (d > m - r)).sum() / len(x) + abs(inner / len(x) - 0.5)
                if best is None or sent < best[0]:
                    best = (sent, mask, r, v, m, d)
        if best is None:
            self.shards += 1
            return -self.shards
        _, mask, r, v, m, d = best
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (np.uint64(mask), r, v, m, self.grow(x[d <= m], part, radius, leaf), self.grow(x[d > m], part, radius, leaf))
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, fingerprints at home there, visiting fingerprints)."""
        todo = [(self.root, x, x[:0])]
        while todo:
            at, home, visiting = todo.pop()
            if at < 0:
                yield -1 - at, home, visiting
                continue
            mask, r, v, m, near, far = self.nodes[at]
            d = np.bitwise_count((home ^ v) & mask)
            inner = d <= m
            near_v, far_v, sent = visitors(home, visiting, d, inner, mask, r, v, m)
            todo += [(near, home[inner], near_v), (far, home[~inner], np.concatenate((far_v, sent)))]


def visitors(home, visiting, d, inner, mask, r, v, m):
    e = np.bitwise_count((visiting ^ v) & mask).astype(np.int64)
    return visiting[e <= m + r], visiting[e > m - r], home[inner & (d.astype(np.int64) > m - r)]


class Links:
    """Union by smallest index, vectorised."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[i] = r
        return r

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(home: np.ndarray, visiting: np.ndarray, radius: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller fingerprint that it is linked to) for all that any link joins in this shard.

    Home items are compared with each other and with the visitors.  Each node measures all 64 bits, links what lies
    within ``radius`` of its vantage point to it, and ends the branch once all items at home there are linked and no
    visitor is left that isn't.
    """
    every = np.unique(np.concatenate((home, visiting)))
    links = Links(len(every))
    rng = np.random.default_rng(seed)
    todo = [(np.searchsorted(every, np.unique(home)), np.searchsorted(every, np.unique(visiting)))]
    while todo:
        h, w = todo.pop()
        if not len(h):
            continue
        h, w = unlinked(links, h, w)
        if len(h) > LEAF:
            at = h[rng.integers(len(h))]
            d, e = (np.bitwise_count(every[x] ^ every[at]) for x in (h, w))
            for x, to in ((h, d), (w, e)):
                near = x[to <= radius]
                links.join(near, np.full(len(near), at))
            m = int(np.median(d))
            m -= m == d.max()
            inner = d <= m
            todo += [(h[inner], w[e <= m + radius]), (h[~inner], np.concatenate((w[e > m - radius], h[inner & (d > m - radius)])))]
        elif len(h):
            compare(every, links, h, h, radius)
            compare(every, links, unlinked(links, h, w)[1], h, radius)
    root = links.roots(np.arange(len(every)))
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def unlinked(links, h, w) -> tuple[np.ndarray, np.ndarray]:
    """``h`` and ``w`` without what needs no comparison: if all of ``h`` are linked, visitors linked to them, and then ``h`` if none is left."""
    held = links.roots(h)
    if len(h) and (held == held[0]).all():
        w = w[links.roots(w) != held[0]]
        if not len(w):
            h = h[:0]
    return h, w


def compare(every, links, a, b, radius, block: int = 1 << 22) -> None:
    x = every[b]
    step = max(1, block // max(len(b), 1))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(every[part][:, None] ^ x[None, :]) <= radius)
        links.join(part[i], b[j])


def links_between(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, to): edges, to the smaller side, that join all distinct fingerprints of ``fps`` within ``radius`` and no others.

    The upper tree is fitted to about ``SAMPLE`` fingerprints, twice that at most, which the driver
    collects; every fingerprint is searched.
    """
    spark = fps.sparkSession
    n = fps.count()
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / max(n, 1))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in some.collect()], np.int64)).view(np.uint64)
    masks = choices(n, radius)
    leaf = len(sample) * min(SHARD / max(n, 1), 1 / LEAST_SHARDS)
    trees = [Tree(sample, part, radius, int(leaf)) for part in masks]
    splits = [max(1, int(n / (SHARD * tree.shards))) for tree in trees]
    bases = np.cumsum([0, *(tree.shards * split for tree, split in zip(trees, splits))]).tolist()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy().view(np.uint64)
            shards, fps_, visits = [], [], []
            for tree, part, split, base in zip(trees, masks, splits, bases):
                for shard, *both in tree.route(x):
                    for y, v in zip(both, (False, True)):
                        own = ((y & np.uint64(part)) * SPREAD >> np.uint64(33)) % np.uint64(split)
                        shards.append(base + shard * split + own.astype(np.int64))
                        fps_.append(y)
                        visits.append(np.full(len(y), v))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(np.concatenate(fps_).view(np.int64)), pa.array(np.concatenate(visits))], names=["shard", "fp", "visits"])

    def search(t):
        x, v = t.column("fp").to_numpy().view(np.uint64), t.column("visits").to_numpy()
        a, b = shard_links(x[~v], x[v], radius)
        return pa.table({"fp": a.view(np.int64), "to": b.view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "shard long, fp long, visits boolean").groupBy("shard").applyInArrow(search, "fp long, to long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of all nodes of ``edges``: the smallest reachable node, by alternating large and small stars.

    Each round is a written table; rounds go on until no edge changes.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = written(e)
    sign = lambda x: tuple(x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    said = sign(e)
    while said[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new, new_path = written(small)
        now = sign(new)
        drop_written(spark, path)
        e, path = new, new_path
        if now == said:
            break
        said = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest reachable id) of every row."""
    docs, _ = written(fingerprints(df, id_col, text_col, words))
    fps, fps_path = written(docs.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    found, found_path = written(links_between(fps, radius))
    joined = components(found, "fp", "to")
    # Only fingerprints that some link joins need their component's smallest id; the others have their own.
    linked = fps.join(joined, fps.fp == joined.node).select("fp", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component"))
    own = linked.join(of_root, "root").select("fp", "component")
    final, _ = written(fps.join(own, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id")))
    drop_written(df.sparkSession, fps_path, found_path)
    return with_component(docs, final).select(id_col, "fp", "component_id")


def with_component(docs: DataFrame, final: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the component of their fingerprint.

    Fingerprints of more than ``1 / HOT`` of all rows, fewer than ``HOT``, are broadcast, so no task gets all
    rows of one; the others meet in a join by fingerprint.
    """
    total = final.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(total // HOT, HOT_ROWS)
    often = final.where(hot).select("fp", "component_id", F.lit(True).alias("often"))
    docs = docs.join(F.broadcast(often), "fp", "left")
    few = docs.where("often is null").drop("often", "component_id").join(final.where(~hot).select("fp", "component_id"), "fp")
    return docs.where("often").drop("often").unionByName(few)


def digest(text_col: str):
    """Digest of a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_firsts(df: DataFrame, docs: DataFrame, links: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``df`` with one row of each component: of the smallest id, and of that id's texts there the one of the smallest digest.

    ``docs`` has id, ``digest`` and ``fp`` of each row, ``links`` (fp, to) edges.  All is decided on these; texts meet
    only the keys that go, in an anti-join.  Of rows of equal id and text the one of the smallest hash of all columns
    stays.  Rows without an id are kept as they are.
    """
    keys = docs.groupBy(F.col(id_col).alias("gridgauge_id"), F.col("digest").alias("gridgauge_digest")).agg(F.min("fp").alias("fp"), F.count("*").alias("rows"))
    keys, _ = written(keys)
    firsts = keys.groupBy("fp").agg(F.min(F.struct("gridgauge_id", "gridgauge_digest")).alias("first"))
    joined = components(links, "fp", "to")
    rooted = firsts.join(joined, firsts.fp == joined.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    on = ["gridgauge_id", "gridgauge_digest"]
    stays, _ = written(keys.join(stay.withColumn("stays", F.lit(True)), on, "left").select(*on, "rows", F.coalesce("stays", F.lit(False)).alias("stays")).where("not stays or rows > 1"))
    same = lambda d: (df[id_col] == d["gridgauge_id"]) & (digest(text_col) == d["gridgauge_digest"])
    kept = df.join(stays, same(stays), "left_anti")
    again = stays.where("stays").select(*on)
    if again.isEmpty():
        return kept
    one = F.min_by(F.struct(*df.columns), F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])).alias("one")
    return kept.unionByName(df.join(again, same(again), "left_semi").groupBy(F.col(id_col).alias("gridgauge_id"), digest(text_col).alias("gridgauge_digest")).agg(one).select("one.*"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Rows of ``df`` with one row of each component: of the smallest id, and of that id's texts there one.

    Rows without an id are kept as they are.
    """
    named = df.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), digest(text_col).alias("digest")).alias("key"), F.col(text_col).alias("text"))
    docs, _ = written(fingerprints(named, "key", "text", words).select(F.col("key.id").alias(id_col), "key.digest", "fp"))
    found, _ = written(links_between(docs.select("fp").distinct(), radius))
    return keep_firsts(df, docs, found, id_col, text_col)
