"""Runs of words against brute force over all periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from gridgauge.llm import periodic, queries


def brute(words, least=24, times=3):
    out = []
    for p in range(1, len(words) // times + 1):
        k = 0
        while k + p < len(words):
            if words[k] != words[k + p]:
                k += 1
                continue
            start = k
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            length = k + p - start
            root = words[start : start + p]
            if length >= max(least, times * p) and not any(p % d == 0 and root == root[:d] * (p // d) for d in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(rng):
    n, letters = rng.choice((5, 30, 60, 150)), rng.choice((1, 2, 3, 9))
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        at, p = rng.randrange(len(w)), rng.randrange(1, 12)
        block = w[at : at + p]
        w[at:at] = block * rng.randrange(2, 12)
    return [b"%d" % x for x in w]


def test_brute_force():
    rng = random.Random(11)
    some = 0
    for _ in range(1500):
        w, least, times = made_words(rng), rng.choice((1, 6, 24)), rng.choice((3, 3, 4))
        got = periodic.runs(w, least, times)
        assert got == brute(w, least, times), (w, least, times)
        some += len(got)
    assert some > 1500


def test_hashes_that_agree(monkeypatch):
    """With hashes that hardly tell words apart the words themselves decide."""
    rng = random.Random(12)
    first = periodic.Extensions.__init__

    def weak(self, words):
        first(self, words)
        self.as_array = np.zeros(self.n + 1, np.uint64)
        self.hashes = [0] * (self.n + 1)

    monkeypatch.setattr(periodic.Extensions, "__init__", weak)
    for _ in range(300):
        w = made_words(rng)
        assert periodic.runs(w) == brute(w)


def test_strings_of_thue_and_fibonacci():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(12):
        a, b = b, b + a
    thue = [b"%d" % (bin(k).count("1") % 2) for k in range(1024)]
    for w in (b, thue, thue * 3, [b"x"] * 700):
        assert periodic.runs(w, 4) == brute(w, 4)


def test_long_text():
    rng = random.Random(4)
    block = [b"%d" % rng.randrange(50) for _ in range(20_000)]
    t = time.time()
    assert (0, 400_000, 20_000) in periodic.runs(block * 20)
    assert periodic.runs([b"a"] * 400_000) == [(0, 400_000, 1)] and time.time() - t < 60


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def want(doc_id, text):
    w = planted(doc_id, text)
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(x.decode() for x in made_words(rng))) for k in range(150)]
    rows += [(None, "a " * 40), (None, None), (200, ""), (201, None), (202, "\n \t"), (203, "a a a\x85b \x1c " * 30), (204, "é " * 24), (204, "é " * 24), (205, " x" * 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as id", "7 as runs", "8 as w", "9 as n")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(want(*r)) for r in rows)
    assert periodic.digests(periodic.find_runs(df.limit(0))).count() == 0


def test_given_documents(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000]
    got = {r.doc_id: tuple(r) for r in queries.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert all(got[r.doc_id] == want(r.doc_id, r.text) for r in rows) and any(x[1] for x in got.values())
