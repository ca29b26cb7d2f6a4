"""Near copies: SimHash finds them, the Jaccard similarity of word shingles decides.

Texts with the same set of shingles are one node.  Each set has a SimHash of its shingles, and operator 4's search by
vantage-point trees (``simhash.links_between``) finds the fingerprints at 4 or fewer differing bits.  The similarity of
each such set to the first one of its group is then computed from the whole sets; what passes is linked.

At the similarity 0.8 fingerprints differ in about 10 bits, out of that search's reach, so what SimHash leaves apart is
searched by bands of min-hashes: a pair at 0.8 shares one of 28 bands of 6 with a probability of 0.9998, and more similar
ones with a higher one.  Bands are searched twice.  First each set meets two of its bucket, unless SimHash has linked them:
the smallest one, and the most central one, that with the most others in all its buckets, which in a group of variants is
the text that they vary.  Then, in the buckets that still hold more than one component, all sets meet, in pairs of blocks,
through the shingles that they share.

Cases: null text is empty; texts without words are one set; shorter texts than a shingle are one shingle; of equal
ids and texts one row stays; rows without an id are kept; other columns are kept, whatever their names; an empty
table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text, written
from gridgauge.llm.simhash import LOWER, Links, components, digest, keep_firsts, links_between, majority

BANDS, BAND = 28, 6
#: Bits in which linked fingerprints differ at most.
RADIUS = 4
#: Sets of one bucket, and bytes of their shingles, that are compared with as many others in one group, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
RNG = np.random.default_rng(20)
FACTORS, MASKS = RNG.integers(0, 1 << 64, (2, BANDS * BAND, 1), np.uint64)
FACTORS |= np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; none if it has no words."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(data[a:b], 42) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist())], np.uint64))


def bands(x: np.ndarray, block: int = 1 << 11) -> list[int]:
    """A signed long for each band of the min-hashes of ``x``, seeded with the band's number; ``block`` bounds memory."""
    least = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(x), block):
        np.minimum(least, ((x[at : at + block] ^ MASKS) * FACTORS).min(axis=1), out=least)
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k * BAND * 8 : (k + 1) * BAND * 8], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def signed(x: np.ndarray) -> int:
    """Digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 7)).view(np.int64))


def fingerprint(x: np.ndarray, block: int = 1 << 16) -> int:
    """SimHash of a set of shingles, as a signed long; of none zero."""
    return int(np.uint64(majority((x[at : at + block].byteswap().tobytes() for at in range(0, len(x), block)), len(x))).view(np.int64))


def signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id_col``, ``digest`` of the text, ``fp`` and ``size`` of the set of shingles, its SimHash ``sim``, ``bands``."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, words) for x in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array(map(signed, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], names=[id_col, "digest", "fp", "size", "sim", "bands"])

        return f

    rows = with_text(df, text_col, (id_col, "id")).withColumn("digest", digest("text"))
    return per_batch(rows, make, f"`{id_col}` {kind}, digest long, fp long, size long, sim long, bands array<long>")


def sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``fp`` and ``held``, the sorted shingles, of the texts in ``wanted`` (``id``, ``digest``), each set once."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, words) for x in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(map(signed, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "held"])

        return f

    rows = with_text(df, text_col, (id_col, "id")).withColumn("digest", digest("text"))
    return per_batch(rows.join(wanted, ["id", "digest"], "left_semi").select("text"), make, "fp long, held binary").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (fp, to) whose similarity is at least ``least``."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            said = []
            for x, y in zip(b.column("held").to_pylist(), b.column("other").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                said.append(both >= least * (len(x) + len(y) - both))
            return b.select(["fp", "to"]).filter(pa.array(said, pa.bool_()))

        return f

    rows = pairs.join(sets, "fp").join(sets.select(F.col("fp").alias("to"), F.col("held").alias("other")), "to")
    return per_batch(rows.select("fp", "to", "held", "other"), make, "fp long, to long")


def by_simhash(sets: DataFrame) -> DataFrame:
    """(fp, to): each set with the first one of those that SimHash finds it with: equal fingerprints, or a chain of links of ``RADIUS`` bits."""
    sims, _ = written(sets.select("sim").distinct())
    found, _ = written(links_between(sims.withColumnRenamed("sim", "fp"), RADIUS))
    joined = components(found, "fp", "to")
    rooted = sets.select("fp", "sim").join(joined, F.col("sim") == joined.node, "left").select("fp", F.coalesce("root", "sim").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("fp").alias("to"), F.max("fp").alias("most")).where("to < most").select("root", "to")
    return rooted.join(firsts, "root").where("fp <> to").select("fp", "to")


def links(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(fp, to): edges that join all sets of shingles in ``docs`` that candidates of at least the similarity ``least`` link."""
    sets = docs.groupBy("fp").agg(F.min(F.struct(F.col(id_col).alias("id"), "digest")).alias("first"), F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    sets, _ = written(sets)
    near, _ = written(by_simhash(sets))
    keys = sets.select("fp", "size", F.explode("bands").alias("band"))
    of_bucket, _ = written(keys.groupBy("band").agg(F.min("fp").alias("to"), F.max("fp").alias("most"), F.count("*").alias("n")).where("to < most").drop("most"))
    met, _ = written(keys.join(of_bucket, "band"))
    often = met.groupBy("fp").agg(F.sum("n").alias("others"))
    central = met.where("n > 2").join(often, "fp").groupBy("band").agg(F.max_by("fp", F.struct("others", "fp")).alias("central"))
    shared, _ = written(met.drop("n").join(central, "band", "left"))
    meet = shared.select("fp").union(near.select("fp")).union(near.select("to")).distinct()
    wanted = sets.join(meet, "fp", "left_semi").select("first.*")
    held, _ = written(sets_of(df, wanted, id_col, text_col, words))
    ends = F.explode(F.array_distinct(F.array("to", F.coalesce("central", "to")))).alias("to")
    close, _ = written(verified(near, held, least))
    pairs = shared.select("fp", ends).where("fp <> to").distinct().join(close, ["fp", "to"], "left_anti")
    first, _ = written(close.union(verified(pairs, held, least)))
    joined = components(first, "fp", "to")
    rooted = shared.join(joined, shared.fp == joined.node, "left").select("band", "fp", "size", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size")).where("low < high")
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).alias("blocks"))
    rooted = rooted.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    dealt = rooted.select("band", "fp", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt, _ = written(dealt.select("band", "fp", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    rest = dealt.join(held, "fp").groupBy("band", "low", "high").applyInArrow(lambda t: compare(t, least), "fp long, to long")
    return first.union(rest)


def compare(t: pa.Table, least: float) -> pa.Table:
    """(fp, to): edges that join all rows of ``t`` whose sets have at least the similarity ``least`` and whose components (``root``) differ."""
    fps, sets = t.column("fp").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("held").to_pylist()]
    n = np.array(list(map(len, sets)), np.int64)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)[np.argsort(shingle, kind="stable")]
    ends = np.cumsum(np.bincount(shingle)).tolist()
    starts, at = [0, *ends[:-1]], [0, *np.cumsum(n).tolist()]
    links, edges = Links(len(n)), []
    _, first, same = np.unique(t.column("root").to_numpy(), return_index=True, return_inverse=True)
    links.join(np.arange(len(n)), first[same])
    for i in range(len(n)):
        mine = shingle[at[i] : at[i + 1]].tolist()
        both = np.bincount(np.concatenate([owner[starts[k] : ends[k]] for k in mine]), minlength=len(n)) if mine else np.zeros(len(n), np.int64)
        near = np.flatnonzero(both >= least * (n + n[i] - both))
        roots, k = np.unique(links.roots(near), return_index=True)
        near = near[k[roots != links.roots(np.array([i]))[0]]]
        edges += [(fps[i], fps[j]) for j in near]
        links.join(np.full(len(near), i), near)
    return pa.table({"fp": pa.array([a for a, _ in edges], pa.int64()), "to": pa.array([b for _, b in edges], pa.int64())})


def keep_apart(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``df`` with one document of each group of near copies: that of the smallest id.

    Texts are near copies if their sets of shingles have a Jaccard similarity of at least ``least``; groups are
    closed over links.  Rows without an id are kept as they are.
    """
    named = df.where(F.col(id_col).isNotNull())
    docs, _ = written(signatures(named, id_col, text_col, words))
    found, _ = written(links(named, docs, id_col, text_col, words, least))
    return keep_firsts(df, docs, found, id_col, text_col)
