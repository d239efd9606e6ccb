"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, langid, media, mixing, neardup, pii, quality, substrings, toxicity
from tidelog.llm.common import Scope, fold
from tidelog.llm.sampling import labelled_sample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_report(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose two turns hold marks of common templates."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_windows(rows.unionByName(marks)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scope():
        model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.component_table(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).drop("th")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media.read_features(media.read_headers(media.write_shards(docs)))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "sample_bits")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    with Scope():
        return toxicity.fit(labelled_sample(table(spark, sf_dir, "documents"), labels, "toxic", toxicity.SAMPLE_ROWS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}
    return {name: found[name] for name in sorted(found, key=lambda n: int(n[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    from tidelog.llm import oracles

    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
