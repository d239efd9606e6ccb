"""Named queries over the derived log. Their DuckDB SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import protocol
from tidelog.operators import admission, fetch, groups, health, index, producers, recovery, replica, reserve, retention, visibility
from tidelog.plans import derived

FETCHED = ("partition_id", "batch_id", "first_offset", "last_offset", "record_count", "payload_bytes")
START, BUDGET = 7, 400


def reserve_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("partition_id"), (1 + F.col("doc_id") % 5).alias("record_count"))
    return reserve.reserve(docs, ["partition_id"], "doc_id").select("partition_id", "batch_id", "first_offset", "last_offset", "sequence")


def _placed(spark: SparkSession, sf_dir: str, rings) -> DataFrame:
    return reserve.place(derived.batches(spark, sf_dir), rings, "batch_id").select("partition_id", "batch_id", "lane", "ring_epoch")


def lane_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, derived.RING)


def lane_placement_after_ring_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, derived.RING_CHANGE)


def pack_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.packs(spark, sf_dir).select("lane", "pack_sequence", "partition_id", "batch_id")


def gap_fill_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.missing_batches(derived.batches(spark, sf_dir).where("batch_id % 11 NOT IN (4, 5)"))


def partition_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.marks(derived.batches(spark, sf_dir))


def _fetch(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    log = derived.batches(spark, sf_dir)
    return fetch.fetch(log, derived.marks(log), mode, START, BUDGET).select(*FETCHED)


def ordered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetch(spark, sf_dir, "ordered")


def replicated_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetch(spark, sf_dir, "replicated")


def as_available_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetch(spark, sf_dir, "as_available")


def recovery_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetch(spark, sf_dir, "recovery")


def uneven_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte budget over batches of very different sizes, all committed."""
    log = derived.doc_batches(spark, sf_dir).withColumns({"status": F.lit("committed"), "durable_replicas": F.lit(1)})
    return fetch.fetch(log, visibility.watermarks(log, 1), "ordered", 11, 20_000).select(*FETCHED)


def batch_count_limited_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.limited(derived.batches(spark, sf_dir), 10).select(*FETCHED)


def embedded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both limits: bytes and number of records."""
    log = derived.doc_batches(spark, sf_dir).withColumns({"status": F.lit("committed"), "durable_replicas": F.lit(1)})
    return fetch.fetch(log, visibility.watermarks(log, 1), "ordered", 3, 50_000, 7).select(*FETCHED)


def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.point_read(derived.batches(spark, sf_dir), 2, 9).select(*FETCHED)


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.catalog(derived.batches(spark, sf_dir)).select("partition_id", "batch_id", "first_offset", "last_offset")


def retained_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.batches(spark, sf_dir)
    return fetch.retained_bytes(log, derived.marks(log))


def list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = derived.marks(derived.batches(spark, sf_dir))
    early, late = fetch.list_offsets(marks, -2), fetch.list_offsets(marks, -1)
    return early.withColumnRenamed("offset", "earliest").join(late.withColumnRenamed("offset", "latest"), "partition_id")


def producer_dedup_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return producers.outcomes(derived.appends(spark, sf_dir)).select("producer_id", "first_sequence", "arrival_seq", "outcome")


def producer_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return producers.progress(producers.outcomes(derived.appends(spark, sf_dir)))


def producer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.appends(spark, sf_dir).where("arrival_seq % 2 = 0")
    return reserve.producer_gaps(rows, ["producer_id"], "first_sequence", "record_count").select("producer_id", "first_sequence", "expected")


def atomic_group_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.inspect(derived.chunks(spark, sf_dir), derived.group_outcomes(spark, sf_dir)).select("partition_id", "transaction_id", "state", "chunk_count", "record_count", "payload_bytes", "first_offset", "last_offset", "dense")


def _group_visibility(spark: SparkSession, sf_dir: str, open_as: str | None) -> DataFrame:
    log = groups.resolve(derived.chunks(spark, sf_dir), derived.group_outcomes(spark, sf_dir), open_as).withColumn("durable_replicas", F.lit(1))
    return fetch.visible(log, visibility.watermarks(log, 1)).select("partition_id", "batch_id", "transaction_id", "first_offset")


def atomic_group_open_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_visibility(spark, sf_dir, None)


def atomic_group_commit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_visibility(spark, sf_dir, "committed")


def atomic_group_abort_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_visibility(spark, sf_dir, "aborted")


def retention_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.batches(spark, sf_dir)
    start = F.floor(F.col("last_stable_offset") / 2 / derived.BATCH_RECORDS).cast("long") * derived.BATCH_RECORDS
    starts = derived.marks(log).select("partition_id", start.alias("log_start"))
    return retention.retained(log, starts).select("partition_id", "batch_id", "first_offset")


def retention_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four requests per partition: a batch's start, inside a batch, beyond the stable offset, and before the log's start."""
    log = derived.batches(spark, sf_dir)
    marks = derived.marks(log).withColumn("log_start", F.lit(5).cast("long"))
    asked = marks.select("partition_id", F.explode(F.array(F.lit(10), F.lit(12), F.col("last_stable_offset") + 5, F.lit(0)).cast("array<bigint>")).alias("log_start"))
    return retention.truncation_errors(asked, log, marks)


def gc_removable_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = derived.packs(spark, sf_dir)
    starts = extents.groupBy("partition_id").agg(F.floor(F.count("*") / 2).cast("long").alias("log_start"))
    return retention.removable_packs(extents, starts)


def _offloaded(extents: DataFrame) -> DataFrame:
    return extents.select("lane", "pack_sequence").distinct().where("pack_sequence % 7 <> 6")


def tier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = derived.packs(spark, sf_dir)
    return retention.tier_coverage(extents, _offloaded(extents))


def object_durable_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = derived.packs(spark, sf_dir)
    return retention.object_durable(extents, _offloaded(extents)).select("partition_id", "batch_id", "object_durable")


def replica_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.batches(spark, sf_dir)
    reports = log.select("partition_id", "batch_id", "durable_replicas").unionByName(log.select("partition_id", "batch_id", F.lit(1).alias("durable_replicas")))
    return visibility.replica_progress(log, reports)


def recovered_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.partitions(derived.batches(spark, sf_dir).withColumn("topic_id", F.lit("1")))


def ring_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches placed after a ring change, held against the ring history; every 13th is moved to lane 0 first."""
    placed = _placed(spark, sf_dir, derived.RING_CHANGE).withColumn("sequence", F.col("batch_id"))
    placed = placed.withColumn("lane", F.when(F.col("batch_id") % 13 == 0, 0).otherwise(F.col("lane")))
    rings = spark.createDataFrame([(e, list(s)) for e, _, s in derived.RING_CHANGE], "ring_epoch long, shards array<int>")
    judged = reserve.ring_mismatches(placed, rings)
    return judged.groupBy("partition_id", "ring_epoch").agg(F.count("*").alias("batches"), F.count(F.when(~F.col("valid"), 1)).alias("mismatches"))


def log_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.bounds(derived.batches(spark, sf_dir))


def lane_kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reserve.place(derived.batches(spark, sf_dir), derived.RING, "batch_id").select("partition_id", "first_offset", "lane", "batch_id")
    return fetch.merge_lanes([placed.where(F.col("lane") == lane) for lane in range(derived.LANES)])


def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.pages(derived.batches(spark, sf_dir), BUDGET)


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), (F.col("doc_id") % 7).alias("record_count"), F.octet_length("text").cast("long").alias("payload_bytes"))
    return reserve.validate_requests(docs, 4_096).select("request_id", "outcome")


def topic_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.functions.values import binding_valid

    n = derived.table(spark, sf_dir, "nation")
    rows = n.select(
        F.col("n_nationkey").cast("string").alias("logical_topic_id"), (F.col("n_nationkey") % 4).alias("partitions"), (F.col("n_nationkey") % 3).alias("policy_generation"), (F.col("n_nationkey") % 5).alias("data_generation"),
        F.when(F.col("n_regionkey") == 1, "active_active").otherwise("active_passive").alias("mode"), F.when(F.col("n_nationkey") % 2 == 0, F.sha2(F.col("n_name").cast("binary"), 256)).alias("finalized_epoch_hash"), F.concat(F.lit("p "), F.col("n_name")).alias("profile_id"),
    )
    profile = F.when(F.col("data_generation") == 2, F.regexp_replace("profile_id", " ", "-")).when(F.col("data_generation") == 3, F.col("profile_id"))
    return rows.withColumn("profile_id", profile).withColumn("valid", binding_valid()).select("logical_topic_id", "mode", "valid")


def _partitions_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = derived.marks(derived.batches(spark, sf_dir))
    return marks.select(
        F.lit("1").alias("topic_id"), "partition_id", (F.col("partition_id") + 1).cast("long").alias("leader_epoch"), F.col("last_stable_offset").alias("visible_end"), F.col("replicated_high_watermark").alias("replicated_end"),
        F.when(F.col("partition_id") == 3, F.array(F.lit(7))).otherwise(F.array(F.lit(1), F.col("partition_id") + 2)).alias("in_sync_replicas"), F.lit(derived.MIN_ISR).alias("min_in_sync_replicas"),
        F.lit(True).alias("local_leader"), (F.col("partition_id") != 1).alias("writable"), F.lit(True).alias("assignment_current"),
    )


def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.roll_up(_partitions_health(spark, sf_dir))


def readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    broker = spark.range(1).select(
        F.lit("catching_up").alias("lifecycle"), F.lit(False).alias("assignment_current"), F.lit(True).alias("quorum_available"), F.lit(True).alias("caught_up"), F.lit(1 << 20).cast("long").alias("free_bytes"), F.lit(False).alias("corruption"), F.lit(True).alias("probe_failed")
    )
    return health.blockers(_partitions_health(spark, sf_dir), broker)


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.quantiles(derived.table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})


def stage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100_000).alias("nanos"))
    return health.stage_histogram(events, "event_type", "nanos")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.throughput(derived.batches(spark, sf_dir), 4.0)


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durability and fetch-mode names that requests may use, drawn from the events' types."""
    from tidelog.functions.values import durability, fetch_mode

    names = ["leader", "async", "sync-quorum", "all", "object", "as_available", "ordered", "replicated", "none"]
    picked = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    events = derived.table(spark, sf_dir, "events").select(picked.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return events.select("name", "n", durability(F.col("name")).alias("durability"), fetch_mode(F.col("name")).alias("fetch_mode"))


def acknowledged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends of the four durabilities in turn, three replicas wanted and two in sync at least, against the replicas' reports."""
    log = derived.batches(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("leader", "quorum", "all_replicas", "object"))), (F.col("batch_id") % 4 + 1).cast("int"))
    asked = log.select("partition_id", "batch_id", kind.alias("durability"), F.lit(3).alias("replication_factor"), F.lit(2).alias("min_isr"), (F.col("batch_id") % 3 == 0).alias("object_durable"))
    return admission.acknowledged(asked, log.select("partition_id", "batch_id", "durable_replicas")).select("partition_id", "batch_id", "durability", "acknowledged")


def hosted_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions that broker 2 has a replica of."""
    parts = recovered_partitions(spark, sf_dir)
    assigned = parts.select("topic_id", "partition_id", F.array(F.col("partition_id"), F.col("partition_id") + 1).alias("replicas"), F.col("partition_id").alias("leader"))
    return admission.hosted(parts, assigned, 2)


def recovered_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at recovery: what the journal's markers say of their groups, unresolved where it says nothing."""
    chunks = derived.chunks(spark, sf_dir)
    markers = derived.group_outcomes(spark, sf_dir).join(chunks.select("transaction_id", "partition_id").distinct(), "transaction_id")
    return recovery.statuses(chunks, markers).groupBy("partition_id", "status").agg(F.count("*").alias("chunks"), F.sum("payload_bytes").alias("payload_bytes"))


def replication_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that lack a copy, as jobs waiting."""
    log = derived.batches(spark, sf_dir).where("status <> 'aborted' and durable_replicas < 3")
    return health.backlog(log.select(F.col("payload_bytes").alias("bytes"), F.col("e0").alias("queued_at")))


def producer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes around a failed append: its epoch is barred until the next one goes on behind it."""
    return producers.outcomes(derived.failing_appends(spark, sf_dir)).select("producer_id", "epoch", "first_sequence", "arrival_seq", "outcome")


def producer_failure_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return producers.progress(producers.outcomes(derived.failing_appends(spark, sf_dir)))


def atomic_chunk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.chunk_outcomes(derived.sent_chunks(spark, sf_dir)).select("transaction_id", "chunk_sequence", "arrival_seq", "outcome")


def group_finish_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why groups cannot be committed or aborted, some chunks being in flight and some on too few replicas."""
    chunks = derived.chunks(spark, sf_dir).withColumn("status", F.when(F.col("first_offset") % 29 == 7, "pending").otherwise("unresolved")).withColumn("durable_replicas", 1 + F.col("first_offset") % 3)
    commit, abort = (groups.finish_blockers(chunks, o, 2).withColumnRenamed("reason", f"{o}_blocker") for o in ("committed", "aborted"))
    return commit.join(abort, "transaction_id", "left")


def _protocol_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 6 - 1).cast("int").alias("partition_id"))
    return events.withColumn("leader", derived.led())


def protocol_produce_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("request_id")
    rows = _protocol_requests(spark, sf_dir).withColumns({"acks": (e % 4 - 1).cast("int"), "transactional_id": F.when(e % 13 == 0, "tx"), "has_records": e % 17 != 0, "records_error": F.when(e % 19 == 0, "corrupt_message")})
    return protocol.produce_checks(rows).select("request_id", "durability", "error", "answered")


def protocol_list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _protocol_requests(spark, sf_dir).withColumn("timestamp", -(F.col("request_id") % 4))
    return protocol.list_offsets(rows, derived.marks(derived.batches(spark, sf_dir))).select("request_id", "offset", "error")


def _fetch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    rows = derived.table(spark, sf_dir, "nation").select(n.alias("request_id"), (n % 6 - 1).cast("int").alias("partition_id"), (n * 3 - 2).alias("fetch_offset"), (n % 5 * 90 - 30).alias("max_bytes"))
    return rows.withColumn("leader", derived.led())


def protocol_fetch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = derived.marks(derived.batches(spark, sf_dir)).withColumn("log_start", F.lit(5).cast("long"))
    return protocol.fetch_checks(_fetch_requests(spark, sf_dir), marks, 200).select("request_id", "bytes", "high_watermark", "last_stable_offset", "log_start", "error")


def protocol_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches that answer a fetch request of each nation, every one with a place and a budget of its own."""
    log = derived.batches(spark, sf_dir)
    marks = derived.marks(log).withColumn("log_start", F.lit(5).cast("long"))
    return protocol.fetch(_fetch_requests(spark, sf_dir), log, marks, 200).select("request_id", *FETCHED)


def protocol_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as topics of the log's partitions: every third does not exist, and the last partition of the others has no assignment."""
    names = derived.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("topic_id"))
    parts = derived.batches(spark, sf_dir).select("partition_id").distinct()
    partitions = names.where("topic_id % 3 <> 0").select("topic_id").join(F.broadcast(parts))
    assigned = partitions.where("partition_id <> 3").select("topic_id", "partition_id", F.col("partition_id").alias("leader"), F.array(F.col("partition_id"), F.col("partition_id") + 1).alias("replicas"))
    found = protocol.metadata(names, partitions, assigned)
    return found.select("name", "topic_error", "partition_id", "leader", F.array_join("replicas", ",").alias("replicas"), F.array_join("isr", ",").alias("isr"), "error")


def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records pushed by offset; some come one too far, and again as they should."""
    rows = derived.records(spark, sf_dir)
    wrong = F.col("event_id") % 23 == 9
    pushed = rows.withColumn("copy", F.explode(F.when(wrong, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    pushed = pushed.select("partition_id", (F.col("log_offset") + (wrong & (F.col("copy") == 0)).cast("int")).alias("key"), (F.col("event_id") * 2 + F.col("copy")).alias("arrival_seq"))
    return index.dense_appends(pushed, "partition_id", "key", "arrival_seq")


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in order of their first event, each with the type of the last."""
    return index.sparse(derived.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


def replica_append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, sent = derived.replica_feed(spark, sf_dir)
    return replica.replica_outcomes(held, sent).select("partition_id", "batch_id", "arrival_seq", "outcome")


def recovery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.batches(spark, sf_dir)
    return replica.replayed(log, derived.marks(log)).select("partition_id", "batch_id", "first_offset", "stretch")


def journal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control events, some of whose ring epochs stand still and some of whose log starts fall back."""
    e = F.col("event_id")
    rows = derived.table(spark, sf_dir, "events").select(F.lit("1").alias("topic_id"), (F.col("user_id") % 4).cast("int").alias("partition_id"), e.alias("event_no"), F.when(e % 3 == 0, F.floor(e / 20).cast("long")).alias("ring_epoch"), F.when(e % 3 == 1, e - F.when(e % 31 == 1, 40).otherwise(0)).alias("log_start"))
    return recovery.journal_violations(rows).select("event_no", "partition_id", "violation")


def fenced_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends with the leader epoch that their sender knows, against the partitions' epochs."""
    e = F.col("event_id")
    asked = derived.table(spark, sf_dir, "events").select(e.alias("request_id"), F.lit("1").alias("topic_id"), (F.col("user_id") % 4).cast("int").alias("partition_id"), F.when(e % 5 != 0, e % 4).alias("leader_epoch"))
    epochs = asked.select("topic_id", "partition_id").distinct().withColumn("leader_epoch", F.col("partition_id").cast("long"))
    return admission.fenced(asked, epochs).select("request_id", "outcome")


def request_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict numbers, hexadecimal texts and producer fields as requests carry them."""
    from tidelog.functions.values import hex_bytes, producer_complete, unsigned

    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("00"), "k")).when(k % 5 == 1, F.concat("k", F.lit("x"))).when(k % 5 == 2, F.concat(F.lit("1844674407370955"), F.substring(F.lpad("k", 4, "9"), 1, 4))).otherwise(F.col("k"))
    given = [F.when(k % 2 == 0, F.lit(1)), F.when((k % 2 == 0) | (k % 7 == 0), F.lit(2))]
    return o.select("o_orderkey", unsigned(text, 64).alias("number"), F.lower(F.hex(hex_bytes(F.col("k")))).alias("hex"), producer_complete(*given).alias("producer_complete"))


def error_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.error_status(spark)


def sync_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents waiting in their lanes, by the write and the synchronisation that make them durable."""
    rows = derived.doc_batches(spark, sf_dir).select("lane", "partition_id", "batch_id", (F.col("batch_id") * 2 + F.col("partition_id")).alias("place"))
    return reserve.sync_groups(rows, "lane", "place").drop("place")


def sealed_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs at the time of the last batch: full ones are sealed, and a lane's last one if it was opened 20 batches ago or more."""
    extents = derived.packs(spark, sf_dir)
    opened = extents.groupBy("lane", "pack_sequence").agg(F.min("batch_id").alias("opened"))
    now = extents.agg(F.max("batch_id").alias("now"))
    return reserve.sealed_packs(opened, now.scalar(), 20)


def duplicate_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repeat of every batch gets, of the four durabilities in turn, with and without a way to make copies."""
    b = F.col("batch_id")
    kind = F.element_at(F.array(*map(F.lit, ("leader", "quorum", "all_replicas", "object"))), (b % 4 + 1).cast("int"))
    rows = derived.batches(spark, sf_dir).select("partition_id", "batch_id", "durable_replicas", kind.alias("durability"), F.lit(3).alias("replication_factor"), F.lit(2).alias("min_isr"), (b % 3 == 0).alias("object_durable"), (b % 5 != 0).alias("transport"))
    return admission.duplicate_follow_ups(rows).select("partition_id", "batch_id", "durability", "follow_up")


def partition_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What broker 2 is to each partition."""
    parts = recovered_partitions(spark, sf_dir)
    assigned = parts.where("partition_id <> 3").select("topic_id", "partition_id", F.array(F.col("partition_id"), F.col("partition_id") + 1).alias("replicas"), F.col("partition_id").alias("leader"), (F.col("partition_id") + 10).cast("long").alias("leader_epoch"))
    return admission.placed(parts, assigned, 2).select("topic_id", "partition_id", "leader", "leader_epoch", "role")


def observed_leader_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of leader epochs that now and then fall back."""
    e = F.col("event_id")
    reports = derived.table(spark, sf_dir, "events").select(e.alias("report_no"), (F.col("user_id") % 4).cast("int").alias("partition_id"), (F.floor(e / 50) - F.when(e % 17 == 3, 2).otherwise(0)).cast("long").alias("leader_epoch"))
    return admission.observed_epochs(reports).select("report_no", "partition_id", "outcome", "current")


def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as requests, appends and fetches in turn, some of which fail."""
    rows = derived.batches(spark, sf_dir)
    return health.request_counters(rows.select(F.when(F.col("batch_id") % 2 == 0, "append").otherwise("fetch").alias("kind"), F.when(F.col("status") == "aborted", "Fenced").alias("error"), F.lit(1).alias("batches"), F.col("payload_bytes").alias("bytes")))


def batch_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by status now and after a move to committed: pending and unresolved ones move, others stay."""
    rows = derived.batches(spark, sf_dir).withColumn("after", visibility.transition(F.col("status"), "committed"))
    return rows.groupBy("partition_id", "status", "after").agg(F.count("*").alias("batches"))


def queries() -> dict:
    from tidelog import codec_queries

    own = [
        reserve_offsets, lane_placement, lane_placement_after_ring_change, pack_assignment, gap_fill_aborts, partition_watermarks, ordered_fetch, replicated_fetch, as_available_fetch, recovery_fetch,
        uneven_fetch, batch_count_limited_fetch, embedded_read, point_read, catalog_scan, retained_payload_bytes, list_offsets, producer_dedup_outcome, producer_progress, producer_gaps,
        atomic_group_inspect, atomic_group_open_visibility, atomic_group_commit_visibility, atomic_group_abort_visibility, retention_truncate, retention_errors, gc_removable_packs, tier_coverage,
        object_durable_batches, replica_progress, recovered_partitions, ring_validation, log_bounds, lane_kway_merge, cursor_pages, request_validation, topic_bindings, health_rollup, readiness_blockers,
        latency_quantiles, stage_histogram, throughput, spellings, acknowledged_batches, hosted_partitions, recovered_statuses, replication_backlog,
        producer_failures, producer_failure_progress, atomic_chunk_outcomes, group_finish_blockers, protocol_produce_checks, protocol_list_offsets, protocol_fetch_checks, protocol_fetch, protocol_metadata,
        error_status, sync_groups, sealed_packs, duplicate_follow_ups, partition_roles, observed_leader_epochs, request_counters, batch_transitions,
        dense_index, sparse_index, replica_append_outcomes, recovery_replay, journal_violations, fenced_appends, request_values,
    ]
    return {f.__name__: f for f in own} | codec_queries.queries()


def oracle_sql() -> dict[str, str]:
    from tidelog import oracles

    return dict(oracles.SQL)
