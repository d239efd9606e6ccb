"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Every stage handles all rows of its input: null and empty texts, repeated rows, null ids and sources, and columns beyond those of
``documents``, whatever their names, which all stages but the last return as they are. An empty table gives an empty table. Each stage's
docstring says what becomes of such rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, mixing, neardup, pii, toxicity
from tidelog.llm.common import Scope, written
from tidelog.llm.sampling import labelled_sample

#: Documents whose sets of five-word shingles are so similar (in percent) are near-duplicates.
SIMILAR = 85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on labelled ones outside the held-out fold, finds toxic go.

    Null and empty texts have no hits and stay; equal texts go or stay together; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    with Scope():
        model = toxicity.fit(labelled_sample(docs, labels, "toxic", toxicity.SAMPLE_ROWS))
    scored = toxicity.score(docs, model, name="__toxicity")
    return scored.where("__toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the lowest id stays.

    Documents without words and those with a null id stay; rows of one id and one text are one document and stay or go together.
    """
    return neardup.drop_near_duplicates(docs, SIMILAR)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets and the terms that give them away are replaced in the texts; ``n_chars`` follows.

    No row goes. A null text stays null, with a null ``n_chars``; equal rows stay equal.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, which may be not at all, once, or up to three times.

    Rows of one id are taken alike; a null source is a source; a text without words counts nothing and is taken by its hash.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256): the training tokens, and the digest of the text that they decode to.

    One row per row; null and empty texts have no tokens.
    """
    encoded = bpe.encode_and_check(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", sanitise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: None: SQL can express neither the fitted lexicon nor the encoding; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. A stage's tables are deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scope() as before:
        for name, stage in STAGES:
            with Scope() as own:
                docs = own.keep(written(stage(spark, docs, sf_dir), name))
            before.drop(*[df for df, _ in before.paths.values() if df is not docs])
        return before.keep(docs)
