"""The fitted models: gradients against differences, the prior, bounds on what the driver gets, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgauge.llm import quality, toxicity

DOCS = "doc_id long, text string, label int, positive int"


def differences(f, x, h=1e-6):
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(len(x))])


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    row, col, grade = np.repeat(np.arange(30), 4), rng.integers(0, 7, 120), rng.integers(0, 4, 30)
    x = rng.normal(size=10)
    f = lambda x: toxicity.loss(x[:7], x[7], x[8:], row, col, grade, 0.01)
    assert np.allclose(f(x)[1], differences(lambda x: f(x)[0], x), atol=1e-5)


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_risk_gradient(prior):
    rng = np.random.default_rng(1)
    cp, cu = rng.integers(0, 9, (20, 3)), rng.integers(0, 9, (40, 3))
    x = rng.normal(size=10) * 0.3
    value, g = quality.risk(x[:9], x[9], cp, cu, prior, 0.01)
    assert np.allclose(g, differences(lambda x: quality.risk(x[:9], x[9], cp, cu, prior, 0.01)[0], x), atol=1e-5)
    # Written out from the definition.
    z = lambda c: x[:9][c].sum(1) + x[9]
    loss = lambda z, y: np.log1p(np.exp(-z * y)).mean()
    want = prior * loss(z(cp), 1) + max(0, loss(z(cu), -1) - prior * loss(z(cp), -1)) + 0.005 * (x[:9] ** 2).sum()
    assert abs(value - want) < 1e-9
    f = lambda x: quality.apart(x[:9], x[9], cp, cu, 0.01)
    assert np.allclose(f(x)[1], differences(lambda x: f(x)[0], x), atol=1e-5)


def test_risk_below_zero_steps_back():
    cp, cu = np.zeros((5, 1), int), np.ones((5, 1), int)
    w = np.array([3.0, -3.0])
    assert np.logaddexp(0, -3.0) - 0.9 * np.logaddexp(0, 3.0) < 0
    _, g = quality.risk(w, 0.0, cp, cu, 0.9, 0.0)
    assert g[0] > 0 and g[1] < 0  # down on positives, up on unlabelled rows: the negatives' risk rises again


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_prior(share):
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, (3000, 2))
    unlabelled = np.concatenate((rng.normal(2, 1, (int(4000 * share), 2)), rng.normal(-1, 1, (4000 - int(4000 * share), 2))))
    assert abs(quality.estimated_prior(positive, rng.permutation(unlabelled)) - share) < 0.06


@pytest.fixture(scope="module")
def small(spark):
    good, bad = "A calm sentence, with words of many kinds and a point. ", "xx 1 xx 1 $$ xx 1 "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 5), 0, 0) for i in range(120)] + [(None, good, 0, 0), (500, None, 0, 0), (501, "", 0, 0), (502, good * 20_000, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(120)] + [(0, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_odd(small):
    docs, labels = small
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 124 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    for d, l in ((docs.limit(0), labels), (docs.where(quality.held_out("doc_id")), labels), (docs, labels.limit(0)), (docs, labels.where("quality = 0")), (docs.limit(1), labels)):
        assert quality.train(d, l).score(np.zeros((2, 3))).tolist() == [0.5, 0.5] or d.count() == 1
    held = docs.where(quality.held_out("doc_id"))
    assert {r.score for r in quality.score(held, quality.train(held, labels)).collect()} == {0.5}


def test_bounded_samples(spark, small, monkeypatch):
    docs, labels = small
    many = docs.where("doc_id < 120").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("copy")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, *a, **k: seen.append(len(p) + len(u)) or fit(p, u, *a, **k))
    model = quality.train(many, labels.union(labels), positives=20, unlabelled=30)
    assert model.edges and max(seen) <= 50 and min(seen) > 0
    t = toxicity.train(many, labels.union(labels), sample=20)
    assert len(t.cuts) == 3


def test_toxicity_odd(small):
    docs, labels = small
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.where("toxic = 0"))):
        model = toxicity.train(d, l)
        assert {r.toxic for r in toxicity.grade(docs, model).collect()} == {0}
    assert toxicity.grade(docs.limit(0), toxicity.train(docs, labels)).count() == 0
    assert toxicity.keep_civil(docs, toxicity.train(docs, labels)).columns == docs.columns
