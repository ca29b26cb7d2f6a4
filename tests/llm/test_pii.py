"""Personal data: patterns against plain expressions, gradient, best paths against whole texts, held-out sentences."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from gridgauge.llm import pii, queries


@pytest.fixture(scope="module")
def model():
    return pii.fit(pii.made_sentences(1500, 11))


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns():
    rng = random.Random(2)
    texts = ["", "a@b.c@d.e", "a@b.c.d@e.f", "@a.b", "a@@b.c", "x@-.-", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "001.002.003.0004", "0000000000255.1.1.1", "4111 1111 1111 1111", "4111-1111 1111-1111 2", "+1 (499) 555-6503%%%", "+1+12345678901", "++49 30 123456 (", "4111111111111111@x.org", "é@b.c ü.a@b.ç.de", "１.2.3.4 1.2.3.４", "4111 1111"]
    texts += ["".join(rng.choice("0123456789" * 2 + ".@+-() ab_%") for _ in range(rng.randrange(120))) for _ in range(6000)]
    texts += ["".join(rng.choice(("4111111111111111", "378282246310005", " ", "-", ".", "@", "+1", "a", "255", "7", "x.org")) for _ in range(14)) for _ in range(6000)]
    found = 0
    for t in texts:
        assert pii.base_spans(t) == brute(t), t
        found += len(pii.base_spans(t))
    assert found > 5000


def test_long_texts_are_linear(model):
    t, words = time.time(), pii.Words(model)
    for text in ("a" * 2_000_000, "1" * 2_000_000, "+1" + "(" * 2_000_000, "@" * 500_000, "1.1" * 500_000, "a@" * 500_000, "1 " * 500_000, "Mr. Ann " * 100_000):
        pii.spans_of([text], words)
    assert time.time() - t < 60


def test_gradient():
    rng = np.random.default_rng(3)
    sentences = sorted(pii.made_sentences(12, 5), key=lambda s: len(s[0]))
    number = {f: k for k, f in enumerate(sorted({f for w, _ in sentences for x in w for f in pii.features_of(x)}))}
    kinds = {(): 0}
    group = pii.numbered(sentences, number, {t: k for k, t in enumerate(pii.TAGS)}, kinds)
    held = np.zeros((len(kinds), len(number)))
    for known, k in kinds.items():
        held[k, list(known)] = 1
    x = [rng.normal(0, 0.3, (3, len(number), len(pii.TAGS))), rng.normal(0, 0.3, (len(pii.TAGS),) * 2)]
    _, grads = pii.loss(*x, held, *group)
    for i in (0, 1):
        for _ in range(25):
            at = tuple(rng.integers(0, n) for n in x[i].shape)
            values = []
            for move in (1e-5, -1e-5):
                x[i][at] += move
                values.append(pii.loss(*x, held, *group)[0])
                x[i][at] -= move
            assert abs((values[0] - values[1]) / 2e-5 - grads[i][at]) < 1e-3


def slow_path(model, words):
    """Viterbi over a whole text, one word after the other."""
    at = {f: k for k, f in enumerate(model.features)}
    known = [[at[f] for f in pii.features_of(w) if f in at] for w in words]
    n, k = len(words), len(pii.TAGS)
    best, came = np.zeros(k), []
    for i in range(n):
        e = model.weights[0, known[i]].sum(0)
        e = e + (model.weights[1, known[i - 1]].sum(0) if i else 0) + (model.weights[2, known[i + 1]].sum(0) if i + 1 < n else 0)
        ways = (best[:, None] + model.moves) if i else model.moves[:1]
        came.append(ways.argmax(0))
        best = ways.max(0) + e
    tag = int((best + model.moves[:, 0]).argmax())
    out = [tag]
    for i in range(n - 1, 0, -1):
        tag = int(came[i][tag])
        out.append(tag)
    return out[::-1]


def test_best_paths(model, spark, sf_dir, monkeypatch):
    texts = [" ".join(w) for w, _ in pii.made_sentences(300, 77)] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["", "Mr.", " ".join(["12345 Mr. Ann"] * 300)]
    parts = [t.encode().split() for t in texts]
    for block in (pii.BLOCK, 7):
        monkeypatch.setattr(pii, "BLOCK", block)
        tags, at = pii.tags_of(pii.Words(model), parts), 1
        for w in parts:
            assert tags[at : at + len(w)].tolist() == (slow_path(model, [x.decode() for x in w]) if w else [])
            at += len(w) + 1
        assert at == len(tags)


def test_held_out_sentences(model):
    test = pii.made_sentences(600, 4242)
    tags, at, right, n = pii.tags_of(pii.Words(model), [[w.encode() for w in s] for s, _ in test]), 1, 0, 0
    for s, want in test:
        right += sum(pii.TAGS[k] == t for k, t in zip(tags[at : at + len(s)].tolist(), want))
        at, n = at + len(s) + 1, n + len(s)
    assert right / n > 0.98


def test_added_spans(model):
    words = pii.Words(model)
    said = lambda t: [(pii.KINDS[k], t[a:e]) for a, k, e in pii.spans_of([t], words)[0]]
    assert said("please call (415) 555-0123 now or write ann [at] home [dot] org, thanks") == [("tel", "(415) 555-0123"), ("mail", "ann [at] home [dot] org")]
    assert said("the card 4111111111111111 and 4111111111111112.") == [("card", "4111111111111111"), ("account", "4111111111111112")]
    assert ("name", "Anna Smith") in said("it was Dr. Anna Smith, who said") and said("Of Of Of the end. The End. Was here.") == []
    assert said("under the Apache License, Version 2.0.") == [] and said("token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"") == []


def test_query_rows(spark, tmp_path):
    rows = [(k, " ".join(w)) for k, (w, _) in enumerate(pii.made_sentences(200, 3))] + [(None, "a@b.org"), (None, None), (300, ""), (301, None), (302, "x a@b.org\x85 é@"), (303, "+49 30 1234567"), (303, "+49 30 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as id", "7 as spans", "8 as tags")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_personal_data"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, t in rows:
        base = brute(t or "")
        line = ",".join(f"{pii.BASE[k]}:{a}:{e}" for a, k, e in base)
        want.append((i, *[sum(k == j for _, k, _ in base) for j in range(4)], hashlib.sha256(line.encode()).hexdigest()))
    got = got.collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, want))
    texts = dict(r for r in rows if r[0] is not None)
    for r in got:
        spans = [(int(a), pii.KINDS.index(k), int(e)) for k, a, e in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 4] == brute((texts[r.doc_id] if r.doc_id is not None else None if r.spans == "" else "a@b.org") or "")
        added = [s for s in spans if s[1] >= 4]
        assert not any(a < f and b < e for a, _, e in added for b, k, f in spans if k < 4)
    assert pii.find_personal(df.limit(0), pii.fit([])).count() == 0
    assert pii.train(pii.labelled(spark).limit(0)).features == ()


def test_training_repeats(spark):
    """The same table gives the same model, however its rows are dealt."""
    table = pii.labelled(spark, 60)
    a, b = pii.train(table), pii.train(table.repartition(7))
    assert a.features == b.features and np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)
