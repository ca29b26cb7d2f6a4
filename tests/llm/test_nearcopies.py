"""The pipeline's near-duplicate stage against brute-force similarity."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gridgauge.llm import nearcopies, simhash


def brute_set(text, words=5):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_kept(texts, least=0.8):
    sets = {i: brute_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i for i in ids if root(i) == i}


def test_near_copies_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept({r.doc_id: r.text for r in docs.collect()})


def test_near_copies_in_a_loose_group(spark, monkeypatch):
    """Variants are near copies of the base, not of each other; blocks are small."""
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    base = [f"w{k}" for k in range(200)]
    rows = [(100, " ".join(base))] + [(k, " ".join(base[: k * 9] + [f"x{k}"] + base[k * 9 + 1 : 190 - k] + [f"y{k}", f"z{k}"] + base[192 - k :])) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.keep_apart(df).collect()} == brute_kept(dict(rows))


def test_near_copies_odd(spark):
    rows = [(1, None), (2, ""), (3, "word " * 20_000), (4, "same text of a few words here"), (5, "same text of a few words here"), (5, "same text of a few words here"), (None, "no id"), (7, "\n\t  "), (8, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("id", F.lit(0))
    kept = nearcopies.keep_apart(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 8]
    assert nearcopies.keep_apart(df.limit(0)).count() == 0


def test_keep_one_repeated_id_of_different_texts(spark):
    """Id 1 has a copy of 0's text and a text of its own, which stays."""
    copied = "same text of a few words here"
    for own in ("another text that stands for itself", "a third one that is no copy of any", "words of a fourth text alone"):
        df = spark.createDataFrame([(0, copied), (1, copied), (1, own)], "doc_id long, text string")
        assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(0, copied), (1, own)]


def test_pipeline_odd(spark, tmp_path):
    """Nulls, repeated ids with equal and different texts, an empty table; nothing clean is lost and nothing is left behind."""
    rows = [(1, None, None), (2, "", "s"), (3, "clean words of a third text that stands alone", "s"), (3, "a fourth text with the same id but other words in it", "s"), (None, "no id here", "s"), (5, "clean words of a third text that stands alone", "t"), (3, "clean words of a third text that stands alone", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], schema)
    for name, d in (("some", df), ("none", df.limit(0))):
        sf = tmp_path / name
        d.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (900, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(sf)).collect()
        assert sorted((r.doc_id or 0) for r in got) == ([0, 1, 3, 3] if name == "some" else [])


def test_repeated_rows_that_differ_elsewhere(spark):
    df = spark.createDataFrame([(1, "same text of a few words here", s) for s in "abcab"], "doc_id long, text string, source string")
    want = simhash.keep_one(df).collect()
    assert len(want) == 1 and all(simhash.keep_one(df.orderBy(F.rand(k)).repartition(3)).collect() == want for k in range(3))


def test_scratch_tables_go(spark):
    import os

    from gridgauge.llm.common import scratch, shared_dir, written

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    with scratch(spark) as keep:
        written(spark.range(3))
        df, path = written(spark.range(4))
        keep(path)
    assert df.count() == 4 and len(set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before) == 1


def test_simhash_finds_near_copies(spark, monkeypatch):
    """Without bands, copies with a word more are found by their fingerprints alone; a far text within 4 bits isn't linked."""
    monkeypatch.setattr(nearcopies, "bands", lambda x: [nearcopies.signed(x)])
    base, other = ([f"{c}{k}" for k in range(400)] for c in "wv")
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(["first", *base])), (4, " ".join(other)), (5, " ".join([*other, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs, _ = nearcopies.written(nearcopies.signatures(df, "doc_id", "text", 5))
    found = {(r.fp, r.to) for r in nearcopies.by_simhash(docs.select("fp", "sim").distinct()).collect()}
    fps = {r.doc_id: r.fp for r in docs.collect()}
    assert {frozenset(p) for p in found} == {frozenset((fps[a], min(fps[i] for i in g))) for g in ((1, 2, 3), (4, 5)) for a in g if fps[a] != min(fps[i] for i in g)}
    assert {r.doc_id for r in nearcopies.keep_apart(df).collect()} == {1, 4}
    monkeypatch.setattr(nearcopies, "fingerprint", lambda x: 0)
    assert {r.doc_id for r in nearcopies.keep_apart(df.where("doc_id in (1, 4)")).collect()} == {1, 4}
