"""What opening a log finds out: partitions, missing batches, journal order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import with_previous


def partitions(extents: DataFrame, keys: Sequence[str] = ("topic_id", "partition_id")) -> DataFrame:
    return extents.select(*keys).distinct().orderBy(*keys)


def missing_batches(extents: DataFrame, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """(keys, batch_id, first_offset, last_offset, record_count) of the batches that extents leave out: they are aborted.

    A gap of N batches and M records gives each M div N records, the first M mod N one more. The log starts at batch 0, offset 0.
    """
    linked = with_previous(extents, keys, "batch_id", ["batch_id", "last_offset"])
    gap = linked.select(*keys, F.coalesce("previous.batch_id", F.lit(-1)).alias("b"), F.coalesce("previous.last_offset", F.lit(-1)).alias("o"), (F.col("batch_id") - F.coalesce("previous.batch_id", F.lit(-1)) - 1).alias("n"), (F.col("first_offset") - F.coalesce("previous.last_offset", F.lit(-1)) - 1).alias("m")).where("n > 0")
    each = gap.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    base, extra = F.expr("m div n"), F.col("m") % F.col("n")
    count = base + (F.col("k") < extra).cast("long")
    first = F.col("o") + 1 + F.col("k") * base + F.least("k", extra)
    return each.select(*keys, (F.col("b") + 1 + F.col("k")).alias("batch_id"), first.alias("first_offset"), (first + count - 1).alias("last_offset"), count.alias("record_count"))


def duplicates(extents: DataFrame, keys: Sequence[str] = ("partition_id", "batch_id")) -> DataFrame:
    """Batch ids that occur more than once, which makes a log corrupt."""
    return extents.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def statuses(extents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Extents with ``status`` at recovery: plain ones are committed, chunks follow their group's marker or are unresolved."""
    joined = extents.join(outcomes, ["partition_id", "transaction_id"], "left")
    return joined.withColumn("status", F.when(F.col("transaction_id").isNull(), "committed").otherwise(F.coalesce("outcome", F.lit("unresolved")))).drop("outcome")


def journal_violations(journal: DataFrame) -> DataFrame:
    """Events that break the journal's order, with ``violation``: ring epochs must rise, log starts must not fall."""
    keys = ["topic_id", "partition_id"]
    rings = with_previous(journal.where("ring_epoch is not null"), keys, "event_no", ["ring_epoch"]).where(F.col("ring_epoch") <= F.col("previous.ring_epoch")).withColumn("violation", F.lit("ring_epoch"))
    starts = with_previous(journal.where("log_start is not null"), keys, "event_no", ["log_start"]).where(F.col("log_start") < F.col("previous.log_start")).withColumn("violation", F.lit("log_start"))
    return rings.select("event_no", *keys, "violation").unionByName(starts.select("event_no", *keys, "violation"))
