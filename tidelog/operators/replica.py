"""What a follower answers to the batches that its leader sends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import BLOCK

#: What must be equal for two batches to be one.
IDENTITY = ("first_offset", "record_count", "payload_bytes", "digest")


def replica_outcomes(held: DataFrame, sent: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """``sent`` (partition_id, batch_id, the columns of IDENTITY, the arrival order) with ``outcome``, against the batches ``held`` (the same with status).

    A held batch sent again is a duplicate, in_flight while it is pending, retried if it was aborted, and corrupt where the two differ. A
    new batch must be exactly the next one in id and offset (reserved); any other is fenced. A copy of one reserved before is in flight.
    """
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}"))
    # an aborted batch keeps its place but not its payload
    place = (F.col("k.first_offset") == F.col("s.first_offset")) & (F.col("k.record_count") == F.col("s.record_count"))
    known = held.select("partition_id", "batch_id", *IDENTITY, "status").alias("k")
    joined = sent.alias("s").join(known, ["partition_id", "batch_id"], "left")
    verdict = F.when(F.col("k.status").isNull(), None).when((F.col("k.status") == "aborted") & place, "retried").when(~same, "corrupt").when(F.col("k.status") == "pending", "in_flight").otherwise("duplicate")
    rows = joined.select(*[F.col(f"s.{c}") if c not in ("partition_id", "batch_id") else F.col(c) for c in sent.columns], verdict.alias("outcome"))
    ends = held.groupBy("partition_id").agg((F.max("batch_id") + 1).alias("next_batch"), (F.max(F.col("first_offset") + F.col("record_count"))).alias("next_offset"))
    fresh = rows.where("outcome is null").drop("outcome").join(ends, "partition_id", "left").fillna(0, ["next_batch", "next_offset"])
    walked = _next_ones(fresh, arrival)
    reserved = walked.where("outcome = 'reserved'").select("partition_id", "batch_id", *IDENTITY).alias("k")
    again = walked.where("outcome = 'again'").alias("s").join(reserved, ["partition_id", "batch_id"])
    resolved = again.select(*[F.col(f"s.{c}") if c not in ("partition_id", "batch_id") else F.col(c) for c in sent.columns], F.when(same, "in_flight").otherwise("corrupt").alias("outcome"))
    return rows.where("outcome is not null").unionByName(walked.where("outcome <> 'again'").select(*sent.columns, "outcome")).unionByName(resolved)


def _next_ones(fresh: DataFrame, arrival: str) -> DataFrame:
    """Rows of unknown batches with ``outcome``: reserved, fenced, or again for one that was reserved before. One task reads a partition in order."""
    names = fresh.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, offset = object(), 0, 0
        for frame in frames:
            out = []
            for p, b, first, n, nb, no in zip(*(frame[c].tolist() for c in ("partition_id", "batch_id", "first_offset", "record_count", "next_batch", "next_offset")), strict=True):
                if p != at:
                    at, batch, offset = p, nb, no
                if (b, first) == (batch, offset):
                    batch, offset = batch + 1, offset + n
                    out.append("reserved")
                else:
                    out.append("again" if b < batch else "fenced")
            yield frame.assign(outcome=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema)
    return fresh.repartition("partition_id").sortWithinPartitions("partition_id", arrival).select(*names).mapInPandas(walk, f"{schema}, outcome string")


def replayed(batches: DataFrame, marks: DataFrame) -> DataFrame:
    """What a follower gets again after its leader has recovered: committed and unresolved batches up to the contiguous end, in ranges of offsets.

    ``stretch`` numbers blocks of offsets, so that partitions are replayed in order, a block at a time.
    """
    ends = marks.select("partition_id", "log_start", "contiguous_log_end")
    kept = batches.where(F.col("status").isin("committed", "unresolved")).join(ends, "partition_id")
    kept = kept.where((F.col("first_offset") >= F.col("log_start")) & (F.col("last_offset") < F.col("contiguous_log_end")))
    return kept.withColumn("stretch", F.floor(F.col("first_offset") / BLOCK).cast("long")).drop("log_start", "contiguous_log_end")
