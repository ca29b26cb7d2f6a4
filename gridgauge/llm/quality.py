"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled sample is web text as it comes.  With the
class prior ``p``, positives' risk ``P+`` and ``P-`` of being taken for 1 and for 0, and the unlabelled
risk ``U-``, the model minimises ``p P+ + max(0, U- - p P-)``, the non-negative unbiased risk, under the
logistic loss.  The prior is estimated from positives and unlabelled rows alone (``estimated_prior``).
Features describe a text's form: shares of character kinds, word lengths, repetition; each is cut at
quantiles, so that the linear model can bend.

Fitted to bounded samples (``POSITIVES``, ``UNLABELLED``); every document is scored over its whole text.

Cases: null or empty text has its own value of each feature and a score like any other, and very long ones
too; repeated rows get equal scores; an id labelled both ways isn't trusted; rows without an id aren't
learnt from; without positives or without rows to learn from all scores are 0.5; an empty table gives an
empty result.  Columns other than id and text are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text

#: Trusted ids and unlabelled rows of the samples, at most; quantile bins of a feature.
POSITIVES, UNLABELLED, BINS = 8000, 16_000, 10

KINDS = np.zeros(256, np.int64)
for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'-()", b"!?", b"|\t", b"#$%&*@^~_=+<>/\\{}[]`\""), 1):
    KINDS[list(chars)] = k
N_KINDS = 10


def features(text: str) -> list[float]:
    """The form of a whole text, as numbers that hardly depend on its length."""
    raw = text.encode()
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(KINDS, counts, N_KINDS) / n
    upper = sum(map(str.isupper, text)) / n if not text.isascii() else share[2]
    parts = text.split()
    m = max(len(parts), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(parts, parts[1:])) / m
    distinct = len(set(parts)) / m
    pairs = len(set(zip(parts, parts[1:]))) / max(m - 1, 1)
    return [
        np.log1p(len(parts)), len(text) / m, *share.tolist(), upper, repeats, distinct * m**0.15, pairs, len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1),
        sum(not x[-1].isalnum() for x in parts) / m, sum(x[0].isupper() for x in parts) / m, max(map(len, parts), default=0), len(np.flatnonzero(counts)),
    ]


@dataclass(frozen=True)
class Model:
    edges: tuple[tuple[float, ...], ...]
    weights: np.ndarray
    bias: float
    prior: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """[row, feature]: the place of the bin that holds the value."""
        at, out = 0, []
        for k, e in enumerate(self.edges):
            out.append(np.searchsorted(np.array(e), x[:, k], "right") + at)
            at += len(e) + 1
        return np.stack(out, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.columns(x)].sum(1) + self.bias, -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """The model of least risk; without a prior one that only tells positives from unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return Model((), np.zeros(0), 0.0, prior or 0.5)
    both = np.concatenate((positive, unlabelled))
    edges = tuple(tuple(np.unique(np.quantile(both[:, k], np.arange(1, BINS) / BINS)).tolist()) for k in range(both.shape[1]))
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), 0.0, prior)
    cp, cu = model.columns(positive), model.columns(unlabelled)
    w, b = np.zeros(len(model.weights)), 0.0
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, g = risk(w, b, cp, cu, prior, ridge) if prior is not None else apart(w, b, cp, cu, ridge)
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(edges, w, float(b), 0.5 if prior is None else prior)


def risk(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> tuple[float, np.ndarray]:
    """The risk with its ridge, and the step to take against: its gradient, or, where the negatives' risk fell below zero, the way back from there."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    zp, zu = w[positive].sum(1) + b, w[unlabelled].sum(1) + b
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, rest) + ridge / 2 * float(w @ w)
    if rest >= 0:
        gp, gu = prior * (sigmoid(zp) - 1) / len(zp) - prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    else:
        gp, gu = prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
    g = np.bincount(positive.ravel(), np.repeat(gp, positive.shape[1]), len(w)) + np.bincount(unlabelled.ravel(), np.repeat(gu, unlabelled.shape[1]), len(w)) + ridge * w
    return float(value), np.append(g, gp.sum() + gu.sum())


def apart(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of telling the two samples apart, each with half of the weight, and its gradient."""
    zp, zu = w[positive].sum(1) + b, w[unlabelled].sum(1) + b
    gp, gu = -0.5 / (1 + np.exp(np.clip(zp, -50, 50))) / len(zp), 0.5 / (1 + np.exp(-np.clip(zu, -50, 50))) / len(zu)
    g = np.bincount(positive.ravel(), np.repeat(gp, positive.shape[1]), len(w)) + np.bincount(unlabelled.ravel(), np.repeat(gu, unlabelled.shape[1]), len(w)) + ridge * w
    value = 0.5 * (np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean()) + ridge / 2 * float(w @ w)
    return float(value), np.append(g, gp.sum() + gu.sum())


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled sample, from the two samples alone.

    Each half of the rows is scored by a model that tells positives from unlabelled rows of the other half.  Above any
    score the unlabelled rows hold at least the prior's share of what the positives hold there, so the least ratio of
    the two tails, each with its deviation, bounds the prior from above, and tightly where negatives score low.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    sp, su = [], []
    for k in (0, 1):
        model = fit(positive[k::2], unlabelled[k::2], None, steps=200)
        sp.append(model.score(positive[1 - k :: 2]))
        su.append(model.score(unlabelled[1 - k :: 2]))
    sp, su = np.sort(np.concatenate(sp)), np.sort(np.concatenate(su))
    above_p = 1 - np.searchsorted(sp, sp, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    slack = (np.log(4 / 0.1) / 2) ** 0.5 * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows that aren't held out; the samples are the ids of the smallest hashes, and their texts are read in one pass.

    Of a repeated id one row counts, the one of the least features, so the driver gets at most ``positives + unlabelled`` rows.
    """
    own = ~F.coalesce(held_out("id"), F.lit(True))
    hashed = F.xxhash64("id")
    said = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(own & F.col("label").isNotNull())
    trusted = said.groupBy("id").agg(F.min("label").alias("least")).where("least = 1").select("id").orderBy(hashed, "id").limit(positives)
    docs = with_text(df, text_col, (id_col, "id")).where(own)
    cut = docs.select(hashed.alias("h")).distinct().orderBy("h").limit(unlabelled).agg(F.max("h")).first()[0]
    if cut is None:
        return fit(np.zeros((0, 0)), np.zeros((0, 0)), 0.5)
    rows = docs.join(F.broadcast(trusted.withColumn("positive", F.lit(True))), "id", "left").select("id", "text", F.coalesce("positive", F.lit(False)).alias("positive"), (hashed <= F.lit(cut)).alias("web"))
    some = with_features(rows.where("positive or web"), ("id", "positive", "web"))
    got = some.groupBy("id").agg(F.min(F.struct("features", "positive", "web")).alias("one")).select("id", "one.*").toArrow().sort_by([("id", "ascending")])
    x = np.array(got.column("features").to_pylist(), float).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 0))
    p, u = (np.array(got.column(c).to_pylist(), bool) for c in ("positive", "web"))
    mixed = np.random.default_rng(3).permutation(len(x))
    p, u, x = p[mixed], u[mixed], x[mixed]
    return fit(x[p], x[u], estimated_prior(x[p], x[u]))


def with_features(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    kinds = dict(rows.dtypes)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([features(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=[*keep, "features"])

    return per_batch(rows, lambda: f, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "features array<double>"]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, 0 to 1: the probability that the text is of quality; in one pass without a shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in b.column("text").to_pylist()], float)
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value.score(x))], names=[id_col, "score"])

    return per_batch(with_text(df, text_col, (id_col, "id")), lambda: f, f"`{id_col}` {kind}, score double")
