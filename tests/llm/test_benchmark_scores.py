"""Benchmark search against a plain BM25 over all pairs of passage and item, which shares no code with it; rows that stay."""

import math
import pickle
import random
import re
import sys

from gridgauge.llm import decontaminate


def cut(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())


def halves(text):
    at = text.rfind("?") + 1 or max([m.end() for m in re.finditer(r"[.!]\s+(?=\S)", text)], default=len(text))
    return cut(text[:at]), cut(text[at:])


def ngrams(w, n):
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def brute(texts, items, threshold=0.5, verify=0.5):
    """{(document, item): (score, question share, answer share)} of the best passage."""
    parts = {i: halves(t) for i, t in items.items() if cut(t)}
    every = {i: q + a for i, (q, a) in parts.items()}
    if not every:
        return {}
    mean, count = sum(map(len, every.values())) / len(every), len(every)
    df = {}
    for w in every.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    weights = {}
    for i, w in every.items():
        raw = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * (f := w.count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)}
        weights[i] = {t: v / sum(raw.values()) for t, v in raw.items()}
    stride = max(64, max(map(len, every.values())))
    best = {}
    for d, text in texts.items():
        w = cut(text)
        for start in range(0, max(1, -(-len(w) // stride)) * stride, stride):
            part = w[start : start + 2 * stride]
            held, have = set(part), {}
            for i, (q, a) in parts.items():
                score = sum(v for t, v in weights[i].items() if t in held)
                if score < threshold:
                    continue
                shares = []
                for own in (q, a):
                    n = min(5, len(own))
                    g = ngrams(own, n)
                    have.setdefault(n, ngrams(part, n))
                    shares.append(len(g & have[n]) / len(g) if g else 1.0)
                if min(shares) >= verify:
                    best[d, i] = max(best.get((d, i), (0, 0, 0)), (score, *shares))
    return best


def test_scores(spark):
    rng = random.Random(21)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 900}"
    some = lambda n: " ".join(word() for _ in range(n))
    items = {k: f"{some(rng.randint(2, 20))}? {some(rng.randint(0, 9))}" for k in range(60)} | {60 + k: f"{some(9)}. {some(rng.randint(1, 30))}" for k in range(20)} | {80: items_text for items_text in ["É ü? ß.\x00 x"]} | {90: ""}
    texts = {k: some(rng.randint(0, 900)) for k in range(40)}
    for k in range(150):
        w = items[rng.randrange(81)].split()
        texts[100 + k] = " ".join([some(rng.randint(0, 300)), *(x if rng.random() < 0.93 else word() for x in w), some(rng.randint(0, 300))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(docs, bench).collect()}
    want = brute(texts, items)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


def test_rows_that_stay(spark):
    item = "what do seven grey herons carry over the wide river at first light? they carry small stones and reeds"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(5, item, "a"), (5, "an unrelated clean text of other words", "b"), (None, item, "c"), (7, "clean", "d"), (None, "clean without an id", "e"), (8, None, "f"), (8, "", "g"), (7, "clean", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert sorted(r.item_id for r in decontaminate.keep_clean(df, bench).collect()) == ["b", "d", "d", "e", "f", "g"]
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == 8


def test_parts_agree(spark, monkeypatch):
    rng = random.Random(2)
    some = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = {k: f"{some(12)}? {some(9)}" for k in range(120)}
    texts = {k: f"{some(300)} {items[k % 120]} {some(100)}" if k % 3 else some(400) for k in range(200)}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == whole >= {(k, k % 120) for k in range(200) if k % 3}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {k for k in range(0, 200, 3)}


def test_index_is_small():
    """An index takes a few times its items' text, pickled, and comes back whole."""
    rng = random.Random(3)
    items = [(k, " ".join(f"word{int(rng.paretovariate(0.4)) % 60_000}" for _ in range(60))) for k in range(3000)]
    df = {}
    for _, t in items:
        for w in set(cut(t)):
            df[w.encode()] = df.get(w.encode(), 0) + 1
    index = decontaminate.Index(items, df, len(items), 60.0, 0.5)
    raw = pickle.dumps(index)
    assert len(raw) < 8 * sum(len(t) for _, t in items)
    back = pickle.loads(raw)
    texts = [t for _, t in items[:50]]
    assert back.search(texts, 0.5) == index.search(texts, 0.5) and sys.getsizeof(raw) > 0
