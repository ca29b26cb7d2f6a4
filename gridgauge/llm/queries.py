"""One query for each text operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgauge.llm import bpe, decontaminate, html, infill, media, periodic, pii, quality, secrets, sharding, simhash, toolcalls, toxicity
from gridgauge.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), "page_id", "html", ("url",)).select("page_id", "url", "text", "n_chars")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(quality.held_out("doc_id"), F.lit(False))  # a row without an id has no label to hold out
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.from_media(media.to_media(table(spark, sf_dir, "documents")), payload=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units")


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(table(spark, sf_dir, "conversations")).withColumn("json_sha256", F.sha2("json", 256)).drop("json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal(table(spark, sf_dir, "documents"), pii.train(pii.labelled(spark))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_planted(table(spark, sf_dir, "documents"))))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.infill(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_secret_scan, op3_toxicity, op4_simhash, op5_quality, op6_sharding, op7_decontamination, op8_media_columns, op9_tool_calls, op10_bpe, op11_personal_data, op12_periodic_runs, op13_infill)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.oracle(), "op9_tool_calls": toolcalls.oracle(), "op13_infill": infill.oracle()}
