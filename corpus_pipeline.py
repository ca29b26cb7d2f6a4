"""Cleaning of a text corpus in five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.

Cases, in every stage: a null text counts as empty; equal rows, and equal ids with different texts, are decided row by
row (near copies: one row of an id and text stays); rows without an id are kept or go by their text like others, but
for near copies, which keeps them all; columns beside id and text pass through whatever their names, until the last
stage, which leaves them out; an empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridgauge.llm import bpe, decontaminate, nearcopies, secrets, toxicity
from gridgauge.llm.common import drop_written, scratch, table, written


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: SimHash finds them, the similarity of five-word shingles (0.8) decides."""
    return nearcopies.keep_apart(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; ``n_chars`` follows the text."""
    return secrets.redact(docs, "text", "n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of their decoding."""
    return bpe.encode_decode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", civil), ("simhash_near_dedup", distinct), ("benchmark_decontamination", uncontaminated), ("secret_scan", redacted), ("bpe", tokens)]

#: SQL has neither the fitted model nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn.  What a stage wrote on its way, and its input, are dropped once its output is complete."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs, path = written(stage(spark, docs, sf_dir))
            keep(path)
        if before:
            drop_written(spark, before)
        before = path
    return docs
