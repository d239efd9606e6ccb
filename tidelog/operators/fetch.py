"""Reads of the log in three modes, with byte and count budgets, pages and bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import first_rows, within_budget
from tidelog.operators.reserve import segments

#: Each mode's statuses and the watermark below which a batch must end; None: no bound.
MODES = {
    "ordered": (("committed",), "last_stable_offset"),
    "replicated": (("committed",), "replicated_bound"),
    "as_available": (("committed",), None),
    "recovery": (("committed", "unresolved"), "contiguous_log_end"),
}


class OffsetOutOfRange(ValueError):
    """A read that starts before the log does."""


def check_request(max_bytes: int, limit: int) -> None:
    """A byte budget must be positive and within the configured limit."""
    if not 0 < max_bytes <= limit:
        raise ValueError(f"max_bytes must be between 1 and {limit}")


def check_start(marks: DataFrame, start: int) -> None:
    """Raises OffsetOutOfRange where a partition's log starts after ``start``."""
    late = marks.where(F.col("log_start") > start).select(F.max("log_start")).first()[0]
    if late is not None:
        raise OffsetOutOfRange(f"offset {start} is before the log start {late}")


def visible(batches: DataFrame, marks: DataFrame, mode: str = "ordered", start: int = 0, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """The batches that a read in ``mode`` from ``start`` can return; a batch that holds the start is returned whole."""
    statuses, bound = MODES[mode]
    found = batches.where((F.col("last_offset") >= start) & F.col("status").isin(*statuses))
    if bound is None:
        return found
    limits = marks.withColumn("replicated_bound", F.least("replicated_high_watermark", "last_stable_offset")).select(*keys, F.col(bound).alias("__bound"))
    return found.join(F.broadcast(limits), list(keys)).where(F.col("last_offset") < F.col("__bound")).drop("__bound")  # a row for each log partition


def fetch(batches: DataFrame, marks: DataFrame, mode: str = "ordered", start: int = 0, max_bytes: int = 1 << 20, max_batches: int | None = None, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """``visible`` within a byte budget and, if given, a number of batches; the first visible batch is always returned."""
    found = within_budget(visible(batches, marks, mode, start, keys), keys, "first_offset", "payload_bytes", max_bytes)
    return found if max_batches is None else first_rows(found, keys, "first_offset", max_batches)


def limited(batches: DataFrame, n: int, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    return first_rows(batches, keys, "first_offset", n)


def pages(batches: DataFrame, max_bytes: int) -> DataFrame:
    """(partition_id, page, first_offset, next_offset) of a reader that asks for ``max_bytes`` again and again."""
    cut = segments(batches, "partition_id", ["first_offset"], "payload_bytes", max_bytes, "page", ["first_offset", "last_offset"])
    return cut.groupBy("partition_id", "page").agg(F.min("first_offset").alias("first_offset"), (F.max("last_offset") + 1).alias("next_offset"))


def retained_bytes(batches: DataFrame, marks: DataFrame, start: int = 0, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """(keys, payload_bytes) of the ordered-visible batches from ``start``; 0 where there are none."""
    sums = visible(batches, marks, "ordered", start, keys).groupBy(*keys).agg(F.sum("payload_bytes").alias("payload_bytes"))
    return marks.select(*keys).join(sums, list(keys), "left").select(*keys, F.coalesce("payload_bytes", F.lit(0)).cast("long").alias("payload_bytes"))


def list_offsets(marks: DataFrame, timestamp: int, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """(keys, offset): -2 asks for the earliest offset, -1 for the latest replicated one; other timestamps are not supported."""
    if timestamp not in (-1, -2):
        raise ValueError("only timestamps -1 and -2 are supported")
    return marks.select(*keys, F.col("log_start" if timestamp == -2 else "replicated_high_watermark").alias("offset"))


def bounds(batches: DataFrame, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """(keys, first_offset, next_offset, dense): the retained half-open range, and whether it has no gap."""
    return batches.groupBy(*keys).agg(F.min("first_offset").alias("first_offset"), (F.max("last_offset") + 1).alias("next_offset"), F.sum("record_count").alias("n")).select(
        *keys, "first_offset", "next_offset", (F.col("next_offset") - F.col("first_offset") == F.col("n")).alias("dense")
    )


def dense_bounds(batches: DataFrame, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """``bounds`` of a log that must have no gap; a gap raises where the result is read."""
    gap = F.concat(F.lit("the retained sequence has a gap in "), F.to_json(F.struct(*keys)))
    found = bounds(batches, keys)
    return found.select(*keys, F.when(F.col("dense"), F.col("first_offset")).otherwise(F.raise_error(gap).cast("long")).alias("first_offset"), "next_offset")


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges of the order, each sorted by the task that reads it: one range after another they are in order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def merge_lanes(lanes: Sequence[DataFrame]) -> DataFrame:
    """Lane tables as one stream by (first_offset, lane) for each partition, in ranges of offsets."""
    merged = lanes[0]
    for lane in lanes[1:]:
        merged = merged.unionByName(lane)
    return in_ranges(merged, "partition_id", "first_offset", "lane")


def point_read(batches: DataFrame, partition_id: int, batch_id: int) -> DataFrame:
    return batches.where((F.col("partition_id") == partition_id) & (F.col("batch_id") == batch_id))


def catalog(batches: DataFrame) -> DataFrame:
    """All extents by topic partition and offset, in ranges of offsets."""
    return in_ranges(batches, "partition_id", "first_offset")
