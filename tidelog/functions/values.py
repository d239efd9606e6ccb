"""Names, ids and checks of request values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of durability that requests may use. Fixed values.
DURABILITY = {
    "leader": "leader",
    "async": "leader",
    "async_replicated": "leader",
    "async-replicated": "leader",
    "quorum": "quorum",
    "sync": "quorum",
    "sync_quorum": "quorum",
    "sync-quorum": "quorum",
    "all_replicas": "all_replicas",
    "all-replicas": "all_replicas",
    "all": "all_replicas",
    "object": "object",
}
FETCH_MODES = ("ordered", "replicated", "as_available")
U64_MAX, U128_MAX = str(2**64 - 1), str(2**128 - 1)
#: Engine errors and the status that HTTP, RPC and record-protocol callers get. Fixed values.
ERROR_STATUS = {
    "InvalidConfig": (400, "INVALID_ARGUMENT", "INVALID_REQUEST"),
    "UnknownPartition": (404, "NOT_FOUND", "UNKNOWN_TOPIC_OR_PARTITION"),
    "UnknownShard": (409, "NOT_FOUND", "UNKNOWN_TOPIC_OR_PARTITION"),
    "UnknownAtomicGroup": (409, "NOT_FOUND", "INVALID_REQUEST"),
    "TopicAlreadyExists": (409, "FAILED_PRECONDITION", "TOPIC_ALREADY_EXISTS"),
    "AdmissionLimited": (503, "UNAVAILABLE", "THROTTLING_QUOTA_EXCEEDED"),
    "ReplicaReorderLimited": (409, "UNAVAILABLE", "THROTTLING_QUOTA_EXCEEDED"),
    "ReplicaBufferLimited": (409, "UNAVAILABLE", "THROTTLING_QUOTA_EXCEEDED"),
    "ReplicaInFlight": (503, "UNAVAILABLE", "THROTTLING_QUOTA_EXCEEDED"),
    "WorkerStopped": (503, "UNAVAILABLE", "NOT_ENOUGH_REPLICAS"),
    "DurabilityUnavailable": (503, "UNAVAILABLE", "NOT_ENOUGH_REPLICAS_AFTER_APPEND"),
    "ObjectDurabilityUnavailable": (503, "UNAVAILABLE", "NOT_ENOUGH_REPLICAS"),
    "UnsupportedDurability": (409, "UNIMPLEMENTED", "UNSUPPORTED_VERSION"),
    "OffsetOutOfRange": (416, "OUT_OF_RANGE", "OFFSET_OUT_OF_RANGE"),
    "RetentionPinned": (409, "FAILED_PRECONDITION", "POLICY_VIOLATION"),
    "Fenced": (409, "FAILED_PRECONDITION", "NOT_LEADER_OR_FOLLOWER"),
    "StaleProducerEpoch": (409, "FAILED_PRECONDITION", "INVALID_PRODUCER_EPOCH"),
    "ProducerSequenceOutOfOrder": (409, "FAILED_PRECONDITION", "OUT_OF_ORDER_SEQUENCE_NUMBER"),
    "ProducerRequiresNewEpoch": (409, "FAILED_PRECONDITION", "OUT_OF_ORDER_SEQUENCE_NUMBER"),
    "DuplicateSequenceMismatch": (409, "FAILED_PRECONDITION", "OUT_OF_ORDER_SEQUENCE_NUMBER"),
    "AtomicGroupFinalized": (409, "FAILED_PRECONDITION", "INVALID_REQUEST"),
    "AtomicGroupSequenceOutOfOrder": (409, "FAILED_PRECONDITION", "INVALID_REQUEST"),
    "AtomicGroupChunkMismatch": (409, "FAILED_PRECONDITION", "INVALID_REQUEST"),
    "Sequencer": (409, "FAILED_PRECONDITION", "INVALID_REQUEST"),
    "CorruptState": (500, "INTERNAL", "UNKNOWN_SERVER_ERROR"),
    "Storage": (500, "INTERNAL", "UNKNOWN_SERVER_ERROR"),
}


def durability(name: Column) -> Column:
    """The durability that a spelling means; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in DURABILITY.items() for x in pair]), name)


def fetch_mode(name: Column) -> Column:
    return F.when(name.isin(*FETCH_MODES), name)


def unsigned(text: Column, bits: int = 128) -> Column:
    """The canonical decimal string of a strict unsigned number; null if it is none or does not fit."""
    limit = U64_MAX if bits == 64 else U128_MAX
    plain = F.regexp_replace(text, "^0+(?=.)", "")
    fits = (F.length(plain) < len(limit)) | ((F.length(plain) == len(limit)) & (plain <= limit))
    return F.when(F.rlike(text, F.lit("^[0-9]+$")) & fits, plain)


def numeric_order(text: Column) -> Column:
    """A sort key under which canonical decimal strings are in order of number."""
    return F.lpad(text, 39, "0")


def profile_valid(profile: Column) -> Column:
    return F.rlike(profile, F.lit("^[A-Za-z0-9._-]{1,128}$"))


def binding_valid() -> Column:
    """Over columns partitions, policy_generation, data_generation, mode, finalized_epoch_hash (hex), profile_id.

    Numbers are not zero; a later generation or an active-active topic has a hash, and no hash is all zeros; a profile is well named.
    """
    hashed = F.col("finalized_epoch_hash").isNotNull()
    numbers = (F.col("partitions") != 0) & (F.col("policy_generation") != 0) & (F.col("data_generation") != 0)
    needed = (F.col("data_generation") > 1) | (F.col("mode") == "active_active")
    zero = F.coalesce(F.rlike("finalized_epoch_hash", F.lit("^0+$")), F.lit(False))
    return numbers & ~zero & (~needed | hashed) & (F.col("profile_id").isNull() | profile_valid(F.col("profile_id")))


def producer_complete(*parts: Column) -> Column:
    """Whether producer parameters are all given or none is."""
    given = [p.isNotNull().cast("int") for p in parts]
    total = given[0]
    for g in given[1:]:
        total = total + g
    return (total == 0) | (total == len(parts))


def hex_bytes(text: Column) -> Column:
    """Bytes of a hexadecimal text in either case; null for odd lengths and other characters."""
    return F.when(F.rlike(text, F.lit("^([0-9A-Fa-f]{2})*$")), F.unhex(text))
