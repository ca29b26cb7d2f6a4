"""Every operator on empty tables, and beside columns whose names it uses itself."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridgauge.llm import bpe, decontaminate, html, media, nearcopies, quality, secrets, sharding, simhash, toolcalls, toxicity

#: Names that the operators use inside or return.
NAMES = "id text0 label positive web features fp digest bands to held key size crc shard slot block n media units payload spans kind after optional conv nth level json title item score toxic grade gridgauge_id gridgauge_html".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "same text of a few words here"), (2, None), (3, ""), (4, "same text of a few words here"), (None, "password=abcdefgh1 in a text"), (6, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "same text of a few words here")], "item_id long, text string")


def operators(spark, labels):
    """Name to operator on a table of documents."""
    return {
        "secrets": secrets.find_secrets, "redact": lambda d: secrets.redact(d, "text", "n"), "toxicity": lambda d: toxicity.grade(d, toxicity.train(d, labels)), "civil": lambda d: toxicity.keep_civil(d, toxicity.train(d, labels)),
        "simhash": simhash.near_duplicates, "keep_one": simhash.keep_one, "apart": nearcopies.keep_apart, "quality": lambda d: quality.score(d, quality.train(d, labels)), "shard": lambda d: sharding.shard(d, 3),
        "contaminated": lambda d: decontaminate.contaminated(d, bench(spark)), "clean": lambda d: decontaminate.keep_clean(d, bench(spark)), "media": lambda d: media.from_media(media.to_media(d)), "bpe": bpe.encode_decode,
    }


#: Rows of the result on ``docs``.
WANT = {"secrets": 6, "redact": 6, "toxicity": 6, "civil": None, "simhash": 6, "keep_one": 4, "apart": 4, "quality": 6, "shard": 6, "contaminated": 2, "clean": 4, "media": 6, "bpe": 6}


@pytest.mark.parametrize("name", sorted(WANT))
def test_empty_and_clashing(spark, docs, labels, name):
    f = operators(spark, labels)[name]
    d = docs.withColumn("n", F.length("text").cast("long")) if name == "redact" else docs
    assert f(d.limit(0)).count() == 0
    got = f(d)
    assert WANT[name] is None or got.count() == WANT[name]
    if name in ("redact", "civil", "keep_one", "apart", "clean"):
        assert got.columns == d.columns


def test_media_every_row(docs):
    want = sorted(hashlib.sha256(media.padded((r.text or "").encode())).hexdigest() for r in docs.collect())
    got = media.from_media(media.to_media(docs)).collect()
    assert sorted(r.payload_sha256 for r in got) == want and all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_sha256 for r in got)
    assert all(len(r.units) == -(-r.payload_bytes // media.UNIT) and all(u.random_access for u in r.units) for r in got)


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string").select("*", *[F.lit("x").alias(n) for n in ("text", "n_chars", *NAMES)])
    assert sorted(r.text for r in html.extract(pages).collect()) == ["", "a", "a"] and html.extract(pages.limit(0)).count() == 0
    talk = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(n) for n in NAMES])
    assert toolcalls.link(talk).count() == 2 and toolcalls.link(talk.limit(0)).count() == 0
