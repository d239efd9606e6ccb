"""Fixed schemas of the log's tables. 128-bit ids are canonical decimal strings; offsets, epochs and sequences are longs."""

from __future__ import annotations

from pyspark.sql import types as T


_ATOMS = {"int": T.IntegerType, "long": T.LongType, "bigint": T.LongType, "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType, "double": T.DoubleType}


def _split(spec: str) -> list[str]:
    """The parts between commas that are in no angle brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(spec):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(spec[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, spec[at:]]]


def _type(spec: str) -> T.DataType:
    if spec.startswith("array<"):
        return T.ArrayType(_type(spec[6:-1]))
    if spec.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), _type(k.strip())) for n, _, k in (p.partition(":") for p in _split(spec[7:-1]))])
    return _ATOMS[spec]()


def struct_of(spec: str) -> T.StructType:
    """A struct type from ``name type, ...``; unlike Spark's parser it needs no session, so workers can use it."""
    return T.StructType([T.StructField(n, _type(k.strip())) for n, _, k in (p.partition(" ") for p in _split(spec))])


PLACEMENT = "struct<virtual_lane_id:int,ring_epoch:bigint,leader_epoch:bigint,sequence:bigint>"
PRODUCER = "struct<producer_id:string,epoch:bigint,first_sequence:bigint,event_id:string>"
GROUP = "struct<transaction_id:string,chunk_sequence:bigint>"

TOPICS = struct_of("topic_id string, partitions int, shards array<int>, replication_factor int, min_in_sync_replicas int")
RINGS = struct_of("topic_id string, partition_id int, ring_epoch bigint, first_sequence bigint, shards array<int>")
JOURNAL = struct_of(
    "event_no bigint, kind string, topic_id string, partition_id bigint, ring_epoch bigint, shards array<bigint>, policy_generation bigint, "
    "expected_policy_generation bigint, replication_factor bigint, min_in_sync_replicas bigint, log_start bigint, transaction_id string"
)
REQUESTS = struct_of(f"request_id string, topic_id string, partition_id int, arrival_seq bigint, record_count int, payload binary, durability string, producer {PRODUCER}, atomic_group {GROUP}")
BATCHES = struct_of(
    f"topic_id string, partition_id int, batch_id bigint, first_offset bigint, last_offset bigint, record_count int, placement {PLACEMENT}, "
    f"producer {PRODUCER}, atomic_group {GROUP}, payload_digest binary, payload_bytes bigint, payload binary"
)
EXTENTS = struct_of(
    f"pack_sequence bigint, frame_offset bigint, topic_id string, partition_id bigint, batch_id string, first_offset bigint, last_offset bigint, record_count bigint, placement {PLACEMENT}, "
    f"producer {PRODUCER}, atomic_group {GROUP}, payload binary"
)
ACKS = struct_of("topic_id string, partition_id int, batch_id bigint, durable_replicas int")
MANIFEST = struct_of("pack_sequence bigint, object_key string, bytes bigint, checksum_algorithm string, checksum string, created_unix_ms bigint, extents array<struct<topic_id:string,partition_id:int,first_offset:bigint,last_offset:bigint,virtual_lane_id:int,ring_epoch:bigint,leader_epoch:bigint>>")
ASSIGNMENTS = struct_of("topic_id string, partition_id int, replicas array<int>, leader int, preferred_follower int, leader_epoch bigint, in_sync_replicas array<int>, min_in_sync_replicas int")
WATERMARKS = struct_of("topic_id string, partition_id int, log_start bigint, allocated_end bigint, contiguous_log_end bigint, replicated_high_watermark bigint, last_stable_offset bigint")
