"""Fill-in-middle: against a plain reading of the rule, and across chunks."""

import hashlib
import random
import re

import numpy as np
import pytest
from oracle import connect, same

from gridgauge.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    parts = TOKEN.findall(text)
    assert "".join(parts) == text
    n = len(parts)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:lo]), "".join(parts[lo:hi]), "".join(parts[hi:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(5)
    out = ["", None, " ", "\n\n", "a", " a", "a ", "a<P>b", "<S", "S>", "<<M", "ß é 　x", "a\x00b \x1c c\x85", "x" * 10_000, " " * 10_000, "é " * 5000, "\U0001f600 " * 3000]
    out += ["".join(rng.choice(" \n\tab<>é \U0001f600PSM") for _ in range(rng.choice((3, 30, 4095, 4096, 4097, 9000)))) for _ in range(150)]
    return out + [("word " * 900_000) + "end"]


def test_brute_force(spark):
    rows = [(None if k % 29 == 28 else k, t) for k, t in enumerate(texts())] + [(3, "\n\n")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n", "'y' as output", "1 as id", "2 as one")
    made = infill.infill(df)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(i, t))) for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    back = made.select("doc_id", infill.restored(made.output, made.form).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)
    assert infill.infill(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_small_chunks(size, monkeypatch):
    """Every rank of every text lies where the tokens say, whatever the chunks."""
    monkeypatch.setattr(infill, "CHUNK", size)
    monkeypatch.setattr(infill, "AT_ONCE", 3)
    some = ["", " ", "ab  c\n", "é ü\t\U0001f600x", "", "  a", "zz"]
    raw = [x.encode() for x in some]
    chunks = infill.Chunks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, text in enumerate(some):
        tokens, at = TOKEN.findall(text), int(chunks.ends[k])
        assert chunks.n_tokens()[k] == len(tokens)
        for rank in range(len(tokens) + 1):
            before = "".join(tokens[:rank])
            assert chunks.place(k, rank) == (at + len(before.encode()), len(before))


def test_same_as_sql(spark, sf_dir):
    from gridgauge.llm import queries

    same(queries.queries()["op13_infill"](spark, sf_dir), queries.oracle_sql()["op13_infill"], connect(sf_dir))
