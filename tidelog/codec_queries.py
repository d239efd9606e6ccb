"""Queries over codecs, files, the store and streams. SQL has no counterpart for the formats, but says which rows come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codecs, records
from tidelog.operators import reserve
from tidelog.operators.fetch import visible
from tidelog.plans import derived
from tidelog.schemas import struct_of
from tidelog.sources import files
from tidelog.store import Limits, LogStore
from tidelog.streaming import operators as streaming

FRAME_COLUMNS = ("request_id", "batch_id", "event_id", "transaction_id", "chunk_sequence", "first_offset", "last_offset", "record_count", "virtual_lane_id", "ring_epoch", "leader_epoch", "sequence", "payload")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one if the session has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        import tempfile

        shared = f"file://{tempfile.mkdtemp()}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored batches with placement, and groups for some."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("partition_id"), F.lit(1).cast("long").alias("record_count"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    placed = reserve.place(reserve.reserve(docs, ["partition_id"], "doc_id"), derived.RING)
    grouped = F.col("doc_id") % 5 == 0
    return placed.select(
        "doc_id", "partition_id", F.lit("1").alias("topic_id"), F.lit("7").alias("request_id"), F.col("batch_id").cast("string").alias("batch_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("event_id"),
        F.when(grouped, F.col("doc_id").cast("string")).alias("transaction_id"), F.when(grouped, F.lit(0).cast("long")).alias("chunk_sequence"), "first_offset", "last_offset", "record_count",
        F.col("lane").cast("long").alias("virtual_lane_id"), "ring_epoch", F.lit(1).cast("long").alias("leader_epoch"), "sequence", "payload",
    )


def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as fetch frames and back."""
    encoded = files.encode_column(_stored(spark, sf_dir), codecs.encode_frame, "frame", FRAME_COLUMNS, ["doc_id"])
    rows = files.decode_frames(encoded, "frame", ["doc_id"])
    return rows.select("doc_id", "batch_id", "first_offset", "last_offset", "transaction_id", F.sha2("payload", 256).alias("payload_sha256"))


def extent_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as stored extents, whose checksums are verified on the way back."""
    columns = ("topic_id", "partition_id", *FRAME_COLUMNS[1:2], "transaction_id", "chunk_sequence", "first_offset", "last_offset", "record_count", "virtual_lane_id", "ring_epoch", "leader_epoch", "sequence", "payload")
    encoded = files.encode_column(_stored(spark, sf_dir), codecs.encode_extent, "extent", columns, ["doc_id"])
    decoded = files._exploded(encoded, "extent", ["doc_id"], _EXTENT_ROWS, lambda data: [(x["batch_id"], x["first_offset"], x["payload"]) for _, x in codecs.scan_extents(data)])
    return decoded.select("doc_id", "batch_id", "first_offset", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"))


def cursor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of every nation: encoded, and decoded again."""
    n = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("topic_id"), (F.col("n_nationkey") % 4).cast("long").alias("partition_id"), F.lit(1).cast("long").alias("data_generation"), F.lit("active_passive").alias("mode"), (F.col("n_nationkey") * 1000).cast("long").alias("next_offset"))
    encoded = files.encode_column(n, codecs.encode_cursor, "cursor", n.columns, ["topic_id"])

    def decode(data: bytes) -> list[tuple]:
        c = codecs.decode_cursor(data)
        return [(c["partition_id"], c["next_offset"])]

    return files._exploded(encoded.withColumn("cursor_hex", F.lower(F.hex("cursor"))), "cursor", ["topic_id", "cursor_hex"], _CURSOR_ROWS, decode)


def cursor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nations' cursors say after the round trip, and how long they are."""
    return cursor_roundtrip(spark, sf_dir).select("topic_id", "partition_id", "next_offset", (F.length("cursor_hex") / 2).cast("int").alias("cursor_bytes"))


def record_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as record batches of an idempotent producer, scanned back into records with log offsets."""
    log = derived.records(spark, sf_dir).join(derived.table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    grouped = log.groupBy("partition_id", F.floor(F.col("log_offset") / derived.BATCH_RECORDS).cast("long").alias("batch_id")).agg(F.min("log_offset").alias("first_offset"), F.array_sort(F.collect_list(F.struct("log_offset", "props"))).alias("rows"))

    def encode(row: dict) -> bytes:
        rows = [{"key": None, "value": r["props"].encode()} for r in row["rows"]]
        return records.encode_batch(rows, producer_id=row["partition_id"] + 1, epoch=0, sequence=row["first_offset"], codec=4 if row["batch_id"] % 2 else 1)

    encoded = files.encode_column(grouped, encode, "payload", ["rows", "partition_id", "batch_id", "first_offset"], ["partition_id", "batch_id", "first_offset"])
    return files.decode_records(encoded, "payload", keep=["partition_id", "batch_id"]).select("partition_id", "batch_id", "record_offset", F.col("record_value").cast("string").alias("value"), "producer_sequence")


def pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extents in pack files of their lanes, read back with their checksums by the pack source."""
    stored = _stored(spark, sf_dir).withColumnsRenamed({"virtual_lane_id": "lane"})
    sized = stored.select("lane", "partition_id", F.col("batch_id").cast("long").alias("batch_id"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    packs = reserve.packs(sized, derived.PACK_BYTES).withColumn("batch_id", F.col("batch_id").cast("string"))
    rows = stored.join(packs.select("lane", "partition_id", "batch_id", "pack_sequence"), ["lane", "partition_id", "batch_id"])
    columns = ("topic_id", "partition_id", "batch_id", "transaction_id", "chunk_sequence", "first_offset", "last_offset", "record_count", "ring_epoch", "leader_epoch", "sequence", "payload")
    folder = scratch(spark, "packs")
    files.write_packs(rows.select(F.col("lane").cast("int").alias("lane"), "pack_sequence", F.col("lane").alias("virtual_lane_id"), *columns), folder).collect()  # a row per pack
    files.register(spark)
    found = spark.read.format("extentlog").option("path", folder).load()
    return found.select(F.col("placement.virtual_lane_id").cast("int").alias("lane"), "pack_sequence", F.col("partition_id").cast("int").alias("partition_id"), F.col("batch_id").cast("long").alias("batch_id"), "first_offset", F.sha2("payload", 256).alias("payload_sha256"))


def journal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as truncations in one journal, read back with their checksums by the journal source."""
    rows = derived.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    folder = scratch(spark, "journal")
    target, root = files._open(folder)
    target.create_dir(root, recursive=True)
    with target.open_output_stream(f"{root}/control.ssj") as out:
        for r in rows:
            out.write(codecs.encode_event({"kind": "truncate", "topic_id": str(r["n_nationkey"]), "partition_id": r["n_regionkey"], "log_start": r["n_nationkey"] * 10}))
    files.register(spark)
    return spark.read.format("journallog").option("path", folder).load().select("event_no", "kind", "topic_id", F.col("partition_id").cast("long").alias("partition_id"), "log_start")


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the record batches of each log partition, as their scan counts them."""
    rows = record_batch_scan(spark, sf_dir)
    return rows.groupBy("partition_id").agg(F.count("*").alias("records"), F.countDistinct("batch_id").alias("batches"))


def store_append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended to a new log store, and read back as committed batches with their payloads' digests."""
    log = LogStore(spark, scratch(spark, "store"), Limits(max_batch_bytes=1 << 30))
    log.create_topic("1", 2, [0, 1, 2])
    docs = derived.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).cast("int").alias("partition_id"), F.col("doc_id").alias("arrival_seq"), F.lit(1).alias("record_count"), F.coalesce("text", F.lit("")).alias("payload"))
    log.append("1", docs)
    rows = visible(log.batches("1"), log.watermarks("1"))
    return rows.select("partition_id", "batch_id", "first_offset", "lane", F.sha2("payload", 256).alias("payload_sha256"))


def stream_producer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers' appends as a stream: each gets the outcome that the batch operator gives it."""
    appends = derived.appends(spark, sf_dir)
    source, sink = scratch(spark, "appends"), scratch(spark, "judged")
    appends.write.parquet(source)
    streaming.run_to_end(streaming.judged(spark.readStream.schema(appends.schema).parquet(source)), sink, scratch(spark, "state"))
    return spark.read.parquet(sink)


def stream_sequencer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as live requests: the stream hands out the offsets that the batch operator does."""
    docs = derived.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).cast("int").alias("partition_id"), F.col("doc_id").alias("arrival_seq"), (1 + F.col("doc_id") % 5).alias("record_count"))
    source, sink = scratch(spark, "requests"), scratch(spark, "sequenced")
    docs.write.parquet(source)
    live = spark.readStream.schema(docs.schema).parquet(source)
    streaming.run_to_end(streaming.sequenced(live), sink, scratch(spark, "state"))
    return spark.read.parquet(sink)


def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that come in reverse within runs of eight leave in order."""
    shuffled = derived.batches(spark, sf_dir).select("partition_id", (F.floor(F.col("batch_id") / 8) * 8 + 7 - F.col("batch_id") % 8).cast("long").alias("arrival_seq"), "batch_id", F.col("payload_bytes").alias("size"), F.col("e0").cast("string").alias("payload"))
    source, sink = scratch(spark, "batches"), scratch(spark, "ordered")
    shuffled.write.parquet(source)
    live = spark.readStream.schema(shuffled.schema).parquet(source)
    streaming.run_to_end(streaming.reordered(live), sink, scratch(spark, "state"))
    return spark.read.parquet(sink)


_EXTENT_ROWS = struct_of("batch_id string, first_offset bigint, payload binary")
_CURSOR_ROWS = struct_of("partition_id bigint, next_offset bigint")


def queries() -> dict:
    own = [frame_roundtrip, extent_roundtrip, cursor_roundtrip, cursor_positions, record_batch_scan, record_counts, pack_scan, journal_scan, store_append_read, stream_sequencer, stream_reorder, stream_producer_check]
    return {f.__name__: f for f in own}
