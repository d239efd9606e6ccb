"""A deterministic log over the driver's tables: records, batches, placement, status, replicas, producers, groups and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import reserve, visibility
from tidelog.operators.prefix import running_sums

PARTITIONS, BATCH_RECORDS, LANES, MIN_ISR = 4, 5, 3, 2
RING = ((1, 0, (0, 1, 2)),)
RING_CHANGE = ((1, 0, (0, 1, 2)), (2, 10, (3, 4, 5, 6)))
PACK_BYTES = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", (F.col("user_id") % PARTITIONS).cast("int").alias("partition_id"), F.length("props").cast("long").alias("bytes")
    )
    return running_sums(events, ["partition_id"], "event_id", {"log_offset": F.lit(1)})


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records each: ids, offsets, sizes, lane and status, durable replicas."""
    batch = F.floor(F.col("log_offset") / BATCH_RECORDS).cast("long")
    summed = records(spark, sf_dir).groupBy("partition_id", batch.alias("batch_id")).agg(
        F.min("log_offset").alias("first_offset"),
        F.max("log_offset").alias("last_offset"),
        F.count("*").alias("record_count"),
        F.sum("bytes").alias("payload_bytes"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errs"),
        F.min("event_id").alias("e0"),
    )
    status = F.when(F.col("e0") % 97 == 13, "pending").when(F.col("errs") >= 4, "aborted").when((F.col("errs") == 3) & (F.col("batch_id") > 12), "unresolved").otherwise("committed")
    acks = F.when(F.col("e0") % 211 == 100, 1).otherwise(2 + F.col("e0") % 2)
    return summed.withColumn("status", status).withColumn("durable_replicas", F.when(F.col("status") == "aborted", 0).otherwise(acks).cast("int"))


def marks(log: DataFrame) -> DataFrame:
    return visibility.watermarks(log, MIN_ISR)


def doc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per document by id: uneven sizes, one record each, and lanes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("partition_id"), F.octet_length("text").cast("long").alias("payload_bytes"), F.lit(1).cast("long").alias("record_count"))
    return reserve.place(reserve.reserve(docs, ["partition_id"], "doc_id"), RING)


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_batches(spark, sf_dir).select("lane", "partition_id", "batch_id", "first_offset", "last_offset", "payload_bytes")
    return reserve.packs(rows, PACK_BYTES)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of atomic groups: offsets by (turn, conversation) within four partitions."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 4).cast("int").alias("partition_id"), F.col("conv_id").cast("string").alias("transaction_id"), F.col("turn").alias("chunk_sequence"), F.lit(1).cast("long").alias("record_count"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("payload_bytes"), (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("arrival_seq"),
    )
    return reserve.reserve(turns, ["partition_id"], "arrival_seq")


def group_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by conversation: of three groups one is committed, one aborted, one left open."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    outcome = F.when(F.col("conv_id") % 3 == 0, "committed").when(F.col("conv_id") % 3 == 1, "aborted")
    return ids.select(F.col("conv_id").cast("string").alias("transaction_id"), outcome.alias("outcome")).where("outcome is not null")


def appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers' appends in arrival order: one record each, some sent twice, some lost on the way."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("producer_id"))
    numbered = running_sums(events, ["producer_id"], "event_id", {"first_sequence": F.lit(1)}).where("event_id % 211 <> 5")
    copies = numbered.withColumn("copy", F.explode(F.when(F.col("event_id") % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select(
        "producer_id", F.lit(0).cast("long").alias("epoch"), "first_sequence", F.lit(1).cast("long").alias("record_count"), F.col("event_id").cast("string").alias("digest"), F.lit("").alias("event_id"), (F.col("event_id") * 2 + F.col("copy")).alias("arrival_seq")
    )


def failing_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers one append of which fails: what they send after it in the same epoch, its retry, a repeat of the one before, and the rest in the next epoch."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("producer_id"))
    numbered = running_sums(events, ["producer_id"], "event_id", {"first_sequence": F.lit(1)})
    failed = numbered.where("event_id % 53 = 11").groupBy("producer_id").agg(F.min("first_sequence").alias("f"), F.min("event_id").alias("fe"))
    rows = numbered.join(failed, "producer_id", "left")
    first = rows.select("*", F.lit(0).alias("epoch"), F.lit(0).alias("copy"), F.col("event_id").alias("at"))
    retry = rows.where("first_sequence = f").select("*", F.lit(0).alias("epoch"), F.lit(1).alias("copy"), F.col("event_id").alias("at"))
    repeat = rows.where("first_sequence = f - 1").select("*", F.lit(0).alias("epoch"), F.lit(2).alias("copy"), F.col("fe").alias("at"))
    later = rows.where("first_sequence > f").select("*", F.lit(1).alias("epoch"), F.lit(3).alias("copy"), F.col("event_id").alias("at"))
    sent = first.unionByName(retry).unionByName(repeat).unionByName(later)
    completion = F.when((F.col("copy") == 0) & (F.col("first_sequence") == F.col("f")), "failed")
    return sent.select(
        "producer_id", F.col("epoch").cast("long").alias("epoch"), "first_sequence", F.lit(1).cast("long").alias("record_count"), F.col("event_id").cast("string").alias("digest"), F.lit("").alias("event_id"),
        (F.col("at") * 4 + F.col("copy")).alias("arrival_seq"), completion.alias("completion"),
    )


def sent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent as chunks: every second one twice, some first ones again with other content, some second ones lost, some groups decided before."""
    turns = running_sums(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", {"chunk_sequence": F.lit(1)})
    copies = F.filter(F.array(F.lit(0), F.when(F.col("chunk_sequence") % 2 == 0, 1), F.when((F.col("conv_id") % 5 == 2) & (F.col("chunk_sequence") == 0), 2)), lambda c: c.isNotNull())
    sent = turns.where("NOT (conv_id % 7 = 3 AND chunk_sequence = 1)").withColumn("copy", F.explode(copies))
    return sent.select(
        (F.col("conv_id") % 4).cast("int").alias("partition_id"), F.col("conv_id").cast("string").alias("transaction_id"), "chunk_sequence", F.lit(1).cast("long").alias("record_count"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("payload_bytes"),
        F.when(F.col("copy") == 2, "other").otherwise(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), (F.col("conv_id") % 11 == 5).alias("finalized"), (F.col("chunk_sequence") * 3 + F.col("copy")).alias("arrival_seq"),
    )


def replica_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a follower holds (the first 40 batches of each partition) and what its leader sends: all batches, some again, some of those changed, one left out."""
    log = batches(spark, sf_dir).withColumn("digest", F.col("e0").cast("string"))
    columns = ("partition_id", "batch_id", "first_offset", "record_count", "payload_bytes", "digest")
    copies = F.filter(F.array(F.lit(0), F.when(F.col("e0") % 7 == 0, 1)), lambda c: c.isNotNull())
    sent = log.where("NOT (partition_id = 0 AND batch_id = 300)").withColumn("copy", F.explode(copies))
    sent = sent.withColumn("digest", F.when((F.col("copy") == 1) & (F.col("e0") % 11 == 0), "other").otherwise(F.col("digest")))
    return log.where("batch_id < 40").select(*columns, "status"), sent.select(*columns, (F.col("batch_id") * 2 + F.col("copy")).alias("arrival_seq"))


def led(partition: str = "partition_id"):
    """Whether this broker leads a partition: two it does not lead, one has no assignment."""
    return F.when(F.col(partition) == 4, F.lit(None)).otherwise(F.col(partition) != 2).cast("boolean")
