"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are the presence of words and of word beginnings.  One weight vector serves all grades: the
probability of a grade above ``k`` is ``sigmoid(x . w - cut[k])`` with ordered cuts.  The labels say only
whether a text is toxic, so toxic training rows are graded 1, 2 or 3 by the weight of the features that
the sample itself associates with toxicity.  The expected severity is the sum of the probabilities.

The model is fitted to a bounded sample of labelled rows (``SAMPLE``); the driver collects hashed
features, no texts.  Every document is scored over its whole text.

Cases: null or empty text has no features and gets the base rate; very long texts are read whole; repeated
rows get equal grades; rows without a label or with a null one aren't trained on; an id labelled both ways
counts as toxic; without any usable label no row is toxic; of equally likely grades the lowest is said; an
empty table gives an empty result.  Columns other than id and text are never read, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import kept, per_batch, with_text, words

#: Labelled ids of the sample, at most; hashed features.
SAMPLE, HASHES = 10_000, 1 << 22
#: A feature is kept if its log odds speak for toxicity and if among all features none would be expected to be so
#: one-sided by chance; weights aren't negative, so that a long text's harmless words never outweigh what is toxic in it.
LEAST_ODDS = 2.0
BEGINNINGS = (4, 6)
GRADES = 4
MOST_WORDS = 150_000


def of_word(w: bytes) -> tuple[int, ...]:
    said = w.decode("utf-8", "replace")
    return tuple({zlib.crc32(x.encode()) % HASHES for x in (said, *(said[:n] + "~" for n in BEGINNINGS if len(said) >= n))})


class Features:
    """Feature numbers of a text; of each word they are worked out once.  ``only``: the features to keep, each with its place."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only, self.held = only, {}

    def __call__(self, text: str) -> set[int]:
        if len(self.held) > MOST_WORDS:
            self.held.clear()
        out: set[int] = set()
        for w in set(words(text)):
            f = self.held.get(w)
            if f is None:
                f = of_word(w)
                if self.only is not None:
                    f = tuple(self.only[x] for x in f if x in self.only)
                self.held[w] = f
            if f:
                out.update(f)
        return out


@dataclass(frozen=True)
class Model:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def above(self, x: np.ndarray) -> np.ndarray:
        """[row, k]: the probability of a grade above k."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - x[:, None], -50, 50)))


def prepared(model: Model) -> tuple[Features, np.ndarray]:
    return kept(("toxicity", model), lambda: (Features({f: k for k, f in enumerate(model.features)}), np.array(model.weights)))


def fit(features: np.ndarray, n: np.ndarray, toxic: np.ndarray, steps: int = 800, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """``features``: the rows' distinct feature numbers, one row after the other; ``n``: how many a row has; ``toxic``: its label."""
    if not toxic.any() or toxic.all():
        return Model((), (), tuple([20.0 if not toxic.any() else -20.0] * (GRADES - 1)))
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    features, col = np.unique(features, return_inverse=True)
    bad, good = np.bincount(col[toxic[row]], minlength=len(features)), np.bincount(col[~toxic[row]], minlength=len(features))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    base = toxic.mean()
    seen = bad + good
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = bad * np.log(bad / (seen * base)) + np.where(good > 0, good * np.log(good / (seen * (1 - base))), 0)
    gain = surprise * ((odds > LEAST_ODDS) & (bad > base * seen) & (surprise > np.log(len(features))))
    best = np.flatnonzero(gain > 0)
    place = np.full(len(features), -1)
    place[best] = np.arange(len(best))
    used = place[col] >= 0
    row, col = row[used], place[col[used]]
    # Grades of toxic rows: by how much they hold that speaks for toxicity.
    strong = odds[best] * (odds[best] > 4)
    evidence = np.bincount(row, strong[col], len(n))
    lines = np.quantile(evidence[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(lines, evidence, "left"), 0)
    w, cut, gap = odds[best].copy(), np.log((~toxic).sum() / toxic.sum()), np.zeros(GRADES - 2)
    moment, square = np.zeros(len(w) + 1 + len(gap)), np.zeros(len(w) + 1 + len(gap))
    for step in range(1, steps + 1):
        _, g = loss(w, cut, gap, row, col, grade, ridge)
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, cut, gap = np.maximum(w - move[: len(w)], 0), cut - move[len(w)], gap - move[len(w) + 1 :]
    cuts = np.concatenate(([cut], cut + np.cumsum(np.exp(gap))))
    return Model(tuple(features[best].tolist()), tuple(w.tolist()), tuple(cuts.tolist()))


def loss(w: np.ndarray, cut: float, gap: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades with its ridge, and its gradient by weights, first cut and logarithms of the gaps between cuts."""
    n = len(grade)
    cuts = np.concatenate(([cut], cut + np.cumsum(np.exp(gap))))
    x = np.bincount(row, w[col], n)
    p = 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -50, 50)))
    edges = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
    slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
    at = np.arange(n)
    own = np.maximum(edges[at, grade] - edges[at, grade + 1], 1e-9)
    gx = -(slope[at, grade] - slope[at, grade + 1]) / own / n
    g_cut = np.zeros(GRADES - 1)
    np.add.at(g_cut, np.maximum(grade - 1, 0), np.where(grade > 0, slope[at, grade] / own, 0) / n)
    np.add.at(g_cut, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -slope[at, grade + 1] / own, 0) / n)
    g = np.concatenate((np.bincount(col, gx[row], len(w)) + ridge * w, [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(gap)))
    return float(-np.log(own).mean() + ridge / 2 * (w @ w)), g


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled ids, those of the smallest hashes, with at most ``2 * sample`` rows in all.

    Of a repeated id one row counts, the one of the least features; an id with more rows than that isn't learnt from.
    """
    said = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    few = said.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = df.select(F.col(id_col).alias("id")).join(F.broadcast(few), "id").groupBy("id", "toxic").agg(F.count("*").alias("n")).where(F.col("n") <= 2 * sample).toArrow()
    order = sorted(zip(*(ids.column(c).to_pylist() for c in ("n", "id", "toxic"))))  # ids that repeat least come first
    fit_in = int(np.searchsorted(np.cumsum([n for n, *_ in order]), 2 * sample, "right"))
    kind = dict(df.dtypes)[id_col]
    chosen = df.sparkSession.createDataFrame([(i, t) for _, i, t in order[:fit_in]], f"id {kind}, toxic int")
    rows = with_text(df, text_col, (id_col, "id")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")

    def make():
        features = Features()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array([sorted(features(x)) for x in b.column("text").to_pylist()], pa.list_(pa.int32())), b.column("toxic")], names=["id", "features", "toxic"])

        return f

    got = per_batch(rows, make, f"id {kind}, features array<int>, toxic int").toArrow()
    ids, lists = got.column("id").to_pylist(), got.column("features").combine_chunks()
    ends = lists.offsets.to_numpy()
    values = lists.flatten().to_numpy()
    own = lambda k: values[ends[k] - ends[0] : ends[k + 1] - ends[0]]
    first: dict = {}
    for k, i in enumerate(ids):
        if i not in first or own(k).tolist() < own(first[i]).tolist():
            first[i] = k
    at = [first[i] for i in sorted(first)]
    if not at:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
    return fit(np.concatenate([own(k) for k in at]), np.array([len(own(k)) for k in at]), got.column("toxic").to_numpy().astype(bool)[at])


def grade(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``expected_severity`` (0 to 3), ``grade`` (the likeliest), ``p_toxic`` and ``toxic`` (1 if that is 0.5 or more)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]

    def make():
        features, w = prepared(sent.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([w[list(got)].sum() if (got := features(t)) else 0.0 for t in b.column("text").to_pylist()])
            p = sent.value.above(x)
            each = -np.diff(np.concatenate((np.ones((len(x), 1)), p, np.zeros((len(x), 1))), axis=1), axis=1)
            cols = [b.column("id"), pa.array(p.sum(1)), pa.array(each.argmax(1), pa.int32()), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "expected_severity", "grade", "p_toxic", "toxic"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, expected_severity double, grade int, p_toxic double, toxic int")


def keep_civil(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, whose text isn't toxic; in one pass without a shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        features, w = prepared(sent.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([w[list(got)].sum() if (got := features(t or "")) else 0.0 for t in b.column(text_col).to_pylist()])
            return b.filter(pa.array(sent.value.above(x)[:, 0] < 0.5))

        return f

    return per_batch(df, make, df.schema)
