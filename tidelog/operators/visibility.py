"""Offset watermarks, replica progress, atomic groups' effect on batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import run_end

KEYS = ("partition_id",)
STATUSES = ("pending", "committed", "unresolved", "aborted")


def watermarks(batches: DataFrame, min_isr: int = 1, keys: Sequence[str] = KEYS, log_start: DataFrame | None = None) -> DataFrame:
    """(keys, log_start, allocated_end, contiguous_log_end, replicated_high_watermark, last_stable_offset).

    ``batches``: keys, first_offset, last_offset, status, durable_replicas. Each watermark is the end of the unbroken run of
    batches from ``log_start`` (keys, log_start; 0 where it is not given) before the first batch that blocks it.
    """
    keys = list(keys)
    pending, unresolved, aborted = (F.col("status") == s for s in ("pending", "unresolved", "aborted"))
    if log_start is None:
        starts = batches.select(*keys).distinct().withColumn("log_start", F.lit(0).cast("long"))
    else:
        starts = log_start.select(*keys, "log_start")
    retained = batches.join(starts, keys).where("first_offset >= log_start")
    blocked = lambda c: F.min(F.when(c, F.col("first_offset")))
    lacking = pending | (~aborted & (F.coalesce("durable_replicas", F.lit(0)) < min_isr))
    least = retained.groupBy(*keys).agg((F.max("last_offset") + 1).alias("end"), blocked(pending).alias("p"), blocked(pending | unresolved).alias("u"), blocked(lacking).alias("r"))
    runs = run_end(retained, keys, "first_offset", "last_offset", starts, "log_start")
    joined = starts.join(least, keys, "left").join(runs, keys)
    upto = lambda c: F.least("run_end", F.coalesce(c, "run_end"))
    return joined.select(*keys, "log_start", F.coalesce("end", "log_start").alias("allocated_end"), upto("p").alias("contiguous_log_end"), upto("r").alias("replicated_high_watermark"), upto("u").alias("last_stable_offset"))


def replica_progress(batches: DataFrame, reports: DataFrame, keys: Sequence[str] = ("partition_id", "batch_id")) -> DataFrame:
    """(keys, durable_replicas): the greatest count reported, for batches that are committed or unresolved."""
    best = reports.groupBy(*keys).agg(F.max("durable_replicas").alias("durable_replicas"))
    return batches.where(F.col("status").isin("committed", "unresolved")).select(*keys).join(best, list(keys)).select(*keys, "durable_replicas")


def transition(status: Column, to: str) -> Column:
    """The status after a move to ``to``; only pending batches move, and unresolved ones when their group is decided."""
    return F.when((status == "pending") | ((status == "unresolved") & F.lit(to in ("committed", "aborted"))), F.lit(to)).otherwise(status)
