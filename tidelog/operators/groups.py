"""Atomic groups: chunks that become visible together or not at all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inspect(chunks: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(partition_id, transaction_id, state, chunk_count, record_count, payload_bytes, first_offset, last_offset, dense).

    ``outcomes``: (transaction_id, outcome) markers; groups without one are open. ``dense``: chunk sequences run from 0 without a gap.
    """
    summed = chunks.groupBy("partition_id", "transaction_id").agg(
        F.count("*").alias("chunk_count"),
        F.sum("record_count").alias("record_count"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
        ((F.min("chunk_sequence") == 0) & (F.max("chunk_sequence") + 1 == F.count("*"))).alias("dense"),
    )
    if outcomes is None:
        return summed.withColumn("state", F.lit("open"))
    return summed.join(outcomes, "transaction_id", "left").withColumn("state", F.coalesce("outcome", F.lit("open"))).drop("outcome")


def resolve(chunks: DataFrame, outcomes: DataFrame, open_as: str | None = None) -> DataFrame:
    """Chunks with ``status`` from the group's marker; open groups stay unresolved, or get ``open_as``."""
    status = F.coalesce("outcome", F.lit(open_as or "unresolved"))
    return chunks.join(outcomes, "transaction_id", "left").withColumn("status", F.when(F.col("transaction_id").isNull(), F.lit("committed")).otherwise(status)).drop("outcome")


def finish_blockers(chunks: DataFrame, outcome: str, min_isr: int) -> DataFrame:
    """(transaction_id, reason) of groups that cannot be committed or aborted: a chunk that is not unresolved is in flight, and a commit needs
    every chunk on ``min_isr`` replicas."""
    reason = F.when(F.col("status") != "unresolved", "ReplicaInFlight")
    if outcome == "committed":
        reason = reason.when(F.coalesce("durable_replicas", F.lit(0)) < min_isr, "DurabilityUnavailable")
    return chunks.withColumn("reason", reason).where("reason is not null").groupBy("transaction_id").agg(F.max("reason").alias("reason"))


def judge_chunk(known: list[tuple], chunk_sequence: int, chunk: tuple, finalized: bool) -> str:
    """The outcome of a chunk (record count, bytes, digest) of a group whose chunks so far are ``known``; an accepted one is added to them."""
    if finalized:
        return "finalized"
    if chunk_sequence > len(known):
        return "out_of_order"
    if chunk_sequence < len(known):
        return "duplicate" if known[chunk_sequence] == chunk else "chunk_mismatch"
    known.append(chunk)
    return "accepted"


CHUNK_COLUMNS = ("partition_id", "transaction_id", "chunk_sequence", "record_count", "payload_bytes", "digest", "finalized", "stored")


def chunk_outcomes(df: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """``df`` (the first six of CHUNK_COLUMNS, the arrival order and, if they are there, ``finalized``, whether the group has been decided, and
    ``stored`` for chunks that the log holds already) with ``outcome``: accepted, duplicate, chunk_mismatch, out_of_order, finalized or stored.

    Stored chunks come before others. A group's chunks form one sequence that one task reads in order, group after group; what is kept is
    one group's chunks without their payloads.
    """
    for name in ("finalized", "stored"):
        df = df if name in df.columns else df.withColumn(name, F.lit(False))
    names = df.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, []
        for frame in frames:
            found = []
            for partition, transaction, sequence, *chunk, finalized, stored in zip(*(frame[c].tolist() for c in CHUNK_COLUMNS), strict=True):
                if (partition, transaction) != at:
                    at, known = (partition, transaction), []
                if stored:
                    known.append(tuple(chunk))
                    found.append("stored")
                else:
                    found.append(judge_chunk(known, sequence, tuple(chunk), finalized))
            yield frame.assign(outcome=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ordered = df.repartition("partition_id", "transaction_id").sortWithinPartitions("partition_id", "transaction_id", F.desc("stored"), F.when(F.col("stored"), F.col("chunk_sequence")), arrival)
    return ordered.select(*names).mapInPandas(walk, f"{schema}, outcome string")
