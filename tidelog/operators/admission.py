"""Who may write and when: durability needs, assignments, lifecycle, bounded admission, retries, node identity, error status."""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.values import ERROR_STATUS
from tidelog.operators.prefix import running_max

#: The states of a node and where each may go. Fixed values.
LIFECYCLE = {
    "recovering": ("catching_up", "ready", "failed", "fenced"),
    "catching_up": ("ready", "failed", "fenced"),
    "ready": ("draining", "failed", "fenced"),
    "draining": ("stopped", "failed", "fenced"),
    "fenced": ("stopped",),
    "failed": ("stopped",),
    "stopped": (),
}


def required_followers(durability: Column, replication_factor: Column, min_isr: Column) -> Column:
    """Follower copies that an append waits for: none for leader and object, a quorum's rest, or all others."""
    return F.when(durability == "quorum", min_isr - 1).when(durability == "all_replicas", replication_factor - 1).otherwise(F.lit(0))


def acknowledged(batches: DataFrame, acks: DataFrame) -> DataFrame:
    """``batches`` (partition_id, batch_id, durability, replication_factor, min_isr) with ``durable_replicas`` and ``acknowledged``.

    An append on object storage counts when its pack is listed: ``object_durable``, if the column is there.
    """
    best = acks.groupBy("partition_id", "batch_id").agg(F.max("durable_replicas").alias("durable_replicas"))
    joined = batches.join(best, ["partition_id", "batch_id"], "left").withColumn("durable_replicas", F.coalesce("durable_replicas", F.lit(0)))
    needed = required_followers(F.col("durability"), F.col("replication_factor"), F.col("min_isr")) + 1
    stored = F.coalesce(F.col("object_durable"), F.lit(False)) if "object_durable" in batches.columns else F.lit(False)
    return joined.withColumn("acknowledged", F.when(F.col("durability") == "object", stored).otherwise(F.col("durable_replicas") >= needed))


def duplicate_follow_up(durability: str, copies: int, needed: int, offloaded: bool) -> str:
    """What a repeated append gets: the first receipt, more copies first, or an error while its pack is not offloaded."""
    if durability == "object":
        return "receipt" if offloaded else "ObjectDurabilityUnavailable"
    return "receipt" if copies >= needed else "replicate"


def duplicate_follow_ups(duplicates: DataFrame) -> DataFrame:
    """``duplicates`` (durability, durable_replicas, replication_factor, min_isr, object_durable, transport) with ``follow_up``.

    A repeated append gets its first receipt, more copies first (replicate), or an error: its pack is not offloaded, or copies are
    missing and nothing can make them.
    """
    needed = required_followers(F.col("durability"), F.col("replication_factor"), F.col("min_isr")) + 1
    pending = F.col("transport") & F.col("durability").isin("leader", "object") & (F.col("durable_replicas") < F.col("replication_factor"))
    follow_up = (
        F.when((F.col("durability") == "object") & ~F.col("object_durable"), "ObjectDurabilityUnavailable")
        .when((F.col("durable_replicas") >= needed) & ~pending, "receipt")
        .when(~F.col("transport"), "DurabilityUnavailable")
        .otherwise("replicate")
    )
    return duplicates.withColumn("follow_up", follow_up)


def placed(partitions: DataFrame, assignments: DataFrame, broker: int) -> DataFrame:
    """``partitions`` with leader, replicas, leader_epoch and ``role`` of a broker: leader, follower, none, or unassigned."""
    joined = partitions.join(assignments, ["topic_id", "partition_id"], "left")
    role = F.when(F.col("leader").isNull(), "unassigned").when(F.col("leader") == broker, "leader").when(F.array_contains("replicas", broker), "follower").otherwise("none")
    return joined.withColumn("role", role)


def observed_epochs(reports: DataFrame, order: str = "report_no", keys: tuple[str, ...] = ("partition_id",)) -> DataFrame:
    """Reported leader epochs in order, with ``current``, the epoch after each, and ``outcome``: an epoch behind the current one is Fenced."""
    before = running_max(reports, list(keys), order, "leader_epoch", "__before")
    outcome = F.when(F.col("leader_epoch") < F.col("__before"), "Fenced").otherwise("accepted")
    return before.withColumns({"outcome": outcome, "current": F.greatest("leader_epoch", "__before")}).drop("__before")


def hosted(partitions: DataFrame, assignments: DataFrame, broker: int, leaders_only: bool = False) -> DataFrame:
    """The partitions that a broker has a replica of, or leads."""
    mine = F.col("leader") == broker if leaders_only else F.array_contains("replicas", broker)
    return partitions.join(assignments.where(mine).select("topic_id", "partition_id"), ["topic_id", "partition_id"], "left_semi")


def fenced(requests: DataFrame, epochs: DataFrame) -> DataFrame:
    """``requests`` with ``outcome``: Fenced where their leader_epoch is older than the partition's; a null epoch is not checked."""
    joined = requests.join(epochs.select("topic_id", "partition_id", F.col("leader_epoch").alias("__now")), ["topic_id", "partition_id"], "left")
    return joined.withColumn("outcome", F.when(F.col("leader_epoch") < F.col("__now"), "Fenced").otherwise("accepted")).drop("__now")


def moved(state: str, to: str) -> str:
    if to not in LIFECYCLE[state]:
        raise ValueError(f"{state} does not go to {to}")
    return to


def retry_delay_ms(attempt: int, status: int, retry_after_s: float | None = None) -> float | None:
    """How long a client waits before it tries again; None: it does not."""
    if status not in (429, 503):
        return None
    return retry_after_s * 1000 if retry_after_s is not None else 10.0 * 2**attempt


def error_status(spark: SparkSession) -> DataFrame:
    """(kind, http, rpc, protocol) of engine errors."""
    return spark.createDataFrame([(k, *v) for k, v in ERROR_STATUS.items()], "kind string, http int, rpc string, protocol string")


@dataclass
class BoundedChannel:
    """A queue bounded in items and bytes. What was taken counts until it is released."""

    slots: int
    max_bytes: int
    items: list = field(default_factory=list)
    used_slots: int = 0
    used_bytes: int = 0
    open: bool = True

    def send(self, item: object, size: int) -> str:
        if not self.open:
            return "closed"
        if size > self.max_bytes:
            return "too_large"
        if self.used_slots >= self.slots or self.used_bytes + size > self.max_bytes:
            return "full"
        self.items.append((item, size))
        self.used_slots, self.used_bytes = self.used_slots + 1, self.used_bytes + size
        return "sent"

    def receive(self) -> tuple[object, int] | None:
        return self.items.pop(0) if self.items else None

    def release(self, size: int) -> None:
        self.used_slots, self.used_bytes = self.used_slots - 1, self.used_bytes - size


def next_identity(stored: bytes | None, broker: int) -> bytes:
    """A node's identity record at open: another broker's record is refused, its own goes on to the next incarnation."""
    incarnation = 0
    if stored is not None:
        body, check = stored[:-4], struct.unpack("<I", stored[-4:])[0]
        if zlib.crc32(body) != check:
            raise ValueError("corrupt identity")
        known = json.loads(body)
        if known["broker"] != broker:
            raise ValueError("another broker's data")
        incarnation = known["incarnation"]
    body = json.dumps({"broker": broker, "incarnation": incarnation + 1}).encode()
    return body + struct.pack("<I", zlib.crc32(body))
