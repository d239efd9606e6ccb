"""The record protocol's requests as DataFrames: who is answered with which error, and what the others read.

A request is a row per topic partition. ``leader`` says whether this broker leads the partition; null: it has no assignment. Errors are
the protocol's public names, null where there is none; the first rule that a request breaks decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.fetch import visible
from tidelog.operators.prefix import within_budget

UNKNOWN, NOT_LEADER, OUT_OF_RANGE = "UNKNOWN_TOPIC_OR_PARTITION", "NOT_LEADER_OR_FOLLOWER", "OFFSET_OUT_OF_RANGE"


def _led() -> Column:
    return F.coalesce(F.col("leader"), F.lit(False))


def produce_checks(requests: DataFrame) -> DataFrame:
    """Requests (partition_id, acks, transactional_id, leader, records_error, has_records) with ``durability``, ``error`` and ``answered``.

    ``records_error`` is what scanning the record batches found. A request for no acknowledgement is not answered.
    """
    durability = F.when(F.col("acks") == -1, "all_replicas").when(F.col("acks").isin(0, 1), "leader")
    error = (
        F.when(F.col("transactional_id").isNotNull(), "UNSUPPORTED_FOR_MESSAGE_FORMAT")
        .when(F.col("partition_id") < 0, UNKNOWN)
        .when(~_led(), NOT_LEADER)
        .when(durability.isNull(), "INVALID_REQUIRED_ACKS")
        .when(~F.col("has_records"), "INVALID_RECORD")
        .otherwise(F.upper("records_error"))
    )
    return requests.withColumns({"durability": durability, "error": error, "answered": F.col("acks") != 0})


def fetch_checks(requests: DataFrame, marks: DataFrame, max_fetch_bytes: int) -> DataFrame:
    """Requests (partition_id, fetch_offset, max_bytes, leader) with ``error``, the budget ``bytes`` and the watermarks that an answer carries.

    Both the high watermark and the last stable offset of an answer are the replicated end.
    """
    known = marks.select("partition_id", "log_start", F.col("replicated_high_watermark").alias("high_watermark"), F.lit(True).alias("__known"))
    joined = requests.join(known, "partition_id", "left")
    error = (
        F.when((F.col("partition_id") < 0) | (F.col("fetch_offset") < 0) | (F.col("max_bytes") <= 0), OUT_OF_RANGE)
        .when(~_led(), NOT_LEADER)
        .when(F.col("__known").isNull(), UNKNOWN)
        .when(F.col("fetch_offset") < F.col("log_start"), OUT_OF_RANGE)
    )
    shown = lambda c: F.when(F.col("error").isNull() | (F.col("error") == OUT_OF_RANGE) & (F.col("fetch_offset") >= 0) & (F.col("max_bytes") > 0), F.col(c))
    checked = joined.withColumn("error", error)
    return checked.withColumns({"bytes": F.least("max_bytes", F.lit(max_fetch_bytes)), "high_watermark": shown("high_watermark"), "log_start": shown("log_start")}).withColumn("last_stable_offset", F.col("high_watermark")).drop("__known")


def fetch(requests: DataFrame, batches: DataFrame, marks: DataFrame, max_fetch_bytes: int) -> DataFrame:
    """The batches that answer the requests without an error: replicated reads, each within its own byte budget."""
    good = fetch_checks(requests, marks, max_fetch_bytes).where("error is null").select("request_id", "partition_id", "fetch_offset", "bytes")
    seen = visible(batches, marks, "replicated").join(good, "partition_id").where("last_offset >= fetch_offset")
    return within_budget(seen, ["request_id", "partition_id", "bytes"], "first_offset", "payload_bytes", F.col("bytes"))


def list_offsets(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """Requests (partition_id, timestamp, leader) with ``offset`` (-1 with an error) and ``error``: -2 asks for the start, -1 for the replicated end."""
    joined = requests.join(marks.select("partition_id", "log_start", "replicated_high_watermark"), "partition_id", "left")
    error = (
        F.when(F.col("partition_id") < 0, UNKNOWN)
        .when(~_led(), NOT_LEADER)
        .when(F.col("log_start").isNull(), UNKNOWN)
        .when(~F.col("timestamp").isin(-1, -2), "UNSUPPORTED_VERSION")
    )
    offset = F.when(F.col("timestamp") == -2, F.col("log_start")).otherwise(F.col("replicated_high_watermark"))
    return joined.withColumn("error", error).withColumn("offset", F.when(F.col("error").isNull(), offset).otherwise(F.lit(-1).cast("long"))).drop("log_start", "replicated_high_watermark")


def metadata(names: DataFrame, partitions: DataFrame, assignments: DataFrame) -> DataFrame:
    """(name, topic_error, partition_id, leader, replicas, isr, error) for asked ``names`` (name, topic_id).

    A topic without partitions is unknown, as is a partition without an assignment; the replicas in sync are all replicas.
    """
    placed = partitions.join(assignments, ["topic_id", "partition_id"], "left")
    joined = names.join(placed, "topic_id", "left")
    lost = F.col("partition_id").isNotNull() & F.col("leader").isNull()
    return joined.select("name", F.when(F.col("partition_id").isNull(), UNKNOWN).alias("topic_error"), "partition_id", "leader", "replicas", F.col("replicas").alias("isr"), F.when(lost, UNKNOWN).alias("error"))


def create_topic_error(partitions: Column, replication_factor: Column, manual: Column, configured: Column, brokers: int, replicas: int = 1) -> Column:
    """INVALID_REQUEST for a topic that cannot be made as asked: no partitions, manual placement, settings, or another number of replicas than there are."""
    asked = replication_factor != -1
    wrong = (partitions <= 0) | manual | configured | (asked & ((replication_factor <= 0) | (replication_factor > brokers) | (replication_factor != replicas)))
    return F.when(wrong, "INVALID_REQUEST")
