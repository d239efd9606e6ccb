"""Health roll-up, readiness blockers, quantiles, histograms and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in nanoseconds. Fixed values.
LATENCY_BOUNDS_NANOS = (10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 5_000_000_000, 10_000_000_000)
MINIMUM_FREE_BYTES = 1 << 30


def roll_up(partitions: DataFrame) -> DataFrame:
    """One row: leader_epoch (greatest), visible_end and replicated_end (least), isr (all replicas in sync, ascending, joined by commas), partitions."""
    replicas = partitions.select(F.explode("in_sync_replicas").alias("r")).distinct().agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("isr"))
    ends = partitions.agg(F.coalesce(F.max("leader_epoch"), F.lit(0)).alias("leader_epoch"), F.coalesce(F.min("visible_end"), F.lit(0)).alias("visible_end"), F.coalesce(F.min("replicated_end"), F.lit(0)).alias("replicated_end"), F.count("*").alias("partitions"))
    return ends.withColumn("isr", replicas.scalar())


def blockers(partitions: DataFrame, broker: DataFrame) -> DataFrame:
    """(reason, topic_id, partition_id) of everything that keeps a broker from being ready; ids are null for the broker's own reasons.

    ``broker``: one row with lifecycle, assignment_current, quorum_available, caught_up, free_bytes, corruption, probe_failed.
    """
    of_broker = [
        (F.col("lifecycle") != "ready", "lifecycle"),
        (~F.col("quorum_available"), "quorum_unavailable"),
        (~F.col("caught_up"), "replication_catch_up"),
        (F.col("free_bytes") < MINIMUM_FREE_BYTES, "low_disk_space"),
        (F.col("corruption"), "corruption_detected"),
        (F.col("probe_failed"), "health_probe_failed"),
    ]
    of_partition = [
        (F.size("in_sync_replicas") < F.col("min_in_sync_replicas"), "insufficient_isr"),
        (F.col("local_leader") & ~F.col("writable"), "write_fenced"),
    ]
    reasons = lambda rules: F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in rules]), lambda r: r.isNotNull()))
    none = {"topic_id": F.lit(None).cast("string"), "partition_id": F.lit(None).cast("int")}
    own = broker.select(reasons(of_broker).alias("reason")).withColumns(none)
    each = partitions.select(reasons(of_partition).alias("reason"), "topic_id", F.col("partition_id").cast("int").alias("partition_id"))
    stale = broker.where(~F.col("assignment_current")).select(F.lit("assignment_stale").alias("reason")).union(partitions.where(~F.col("assignment_current")).select(F.lit("assignment_stale"))).distinct().withColumns(none)
    return own.unionByName(each).unionByName(stale)


#: Distinct values that one task may order.
ORDERED = 100_000


def quantiles(df: DataFrame, value: str, shares: dict[str, float], ordered: int = ORDERED) -> DataFrame:
    """One row: for each name the value at place ceil((n - 1) * share) of the ascending values, and ``max``.

    Approximate quantiles bracket each place, and brackets are narrowed until they hold at most ``ordered`` distinct values, whose
    counts are summed in order; the values below are counted. So no task orders more than that, however often one value comes.
    """
    spark, accuracy = df.sparkSession, 10_000
    values = df.select(F.col(value).alias("v")).where("v is not null")
    n, top = values.agg(F.count("*"), F.max("v")).first()
    if not n:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in [*shares, "max"]])
    found = {}
    for name, share in shares.items():
        place, before, held, inside, bracket = int(-(-(n - 1) * share // 1)), 0, n, values, None
        while inside.select("v").distinct().limit(ordered + 1).count() > ordered:
            at = (place - before) / max(held - 1, 1)
            around = [max(0.0, at - 3 / accuracy), min(1.0, at + 3 / accuracy)]
            narrower = inside.agg(F.percentile_approx("v", around, accuracy)).first()[0]
            if narrower == bracket:
                break
            bracket = narrower
            inside = values.where(F.col("v").between(*bracket))
            before, held = values.agg(F.count(F.when(F.col("v") < bracket[0], 1)), F.count(F.when(F.col("v").between(*bracket), 1))).first()
        counted = inside.groupBy("v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("v")))
        found[name] = counted.where(F.col("upto") > place - before).agg(F.min("v")).first()[0]
    return spark.range(1).select(*[F.lit(found[name]).alias(name) for name in shares], F.lit(top).alias("max"))


def stage_histogram(df: DataFrame, stage: str, nanos: str, bounds: Sequence[int] = LATENCY_BOUNDS_NANOS) -> DataFrame:
    """(stage, bound, observations): cumulative counts of durations at or under each bound; the last bound, -1, has all."""
    counts = df.groupBy(stage).agg(*[F.count(F.when(F.col(nanos) <= b, 1)).alias(f"b{b}") for b in bounds], F.count("*").alias("b-1"))
    pairs = F.array(*[F.struct(F.lit(b).cast("long").alias("bound"), F.col(f"`b{b}`").alias("observations")) for b in [*bounds, -1]])
    return counts.select(F.col(stage).alias("stage"), F.explode(pairs).alias("x")).select("stage", "x.bound", "x.observations")


def throughput(df: DataFrame, seconds: float) -> DataFrame:
    """One row: batches, records and MiB a second."""
    return df.agg(F.count("*").alias("n"), F.sum("record_count").alias("r"), F.sum("payload_bytes").alias("b")).select((F.col("n") / seconds).alias("batches_per_second"), (F.col("r") / seconds).alias("records_per_second"), (F.col("b") / 1048576 / seconds).alias("mib_per_second"))


def backlog(jobs: DataFrame) -> DataFrame:
    """One row: jobs waiting, their bytes, and the oldest."""
    return jobs.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("queued_at").alias("oldest"))


def request_counters(requests: DataFrame) -> DataFrame:
    """One row: requests, errors, and batches and bytes appended and fetched, over requests (kind append or fetch, error, batches, bytes)."""
    good = F.col("error").isNull()
    total = lambda kind, c: F.coalesce(F.sum(F.when(good & (F.col("kind") == kind), F.col(c))), F.lit(0)).cast("long")
    return requests.agg(
        F.count("*").alias("requests"), F.count("error").alias("errors"), total("append", "batches").alias("appended_batches"), total("append", "bytes").alias("appended_bytes"), total("fetch", "batches").alias("fetched_batches"), total("fetch", "bytes").alias("fetched_bytes")
    )
