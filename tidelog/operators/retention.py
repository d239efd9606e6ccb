"""Retention, pack reclamation and tier coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import run_end


def truncation_errors(requests: DataFrame, batches: DataFrame, marks: DataFrame) -> DataFrame:
    """(partition_id, log_start, error) for requested log starts: null, moves_back, beyond_stable, not_a_boundary or splits_group.

    ``batches`` may have ``chunk_sequence``; the first retained batch must not be a later chunk of a group.
    """
    chunk = F.col("chunk_sequence") if "chunk_sequence" in batches.columns else F.lit(None).cast("long")
    starts = batches.select("partition_id", F.col("first_offset").alias("log_start"), F.lit(True).alias("boundary"), chunk.alias("chunk"))
    current = marks.select("partition_id", F.col("log_start").alias("now"), "last_stable_offset")
    joined = requests.join(current, "partition_id").join(starts, ["partition_id", "log_start"], "left")
    error = (
        F.when(F.col("log_start") < F.col("now"), "moves_back")
        .when(F.col("log_start") > F.col("last_stable_offset"), "beyond_stable")
        .when(F.col("boundary").isNull() & (F.col("log_start") != F.col("last_stable_offset")) & (F.col("log_start") != F.col("now")), "not_a_boundary")
        .when(F.coalesce(F.col("chunk"), F.lit(0)) != 0, "splits_group")
    )
    return joined.select("partition_id", "log_start", error.alias("error"))


def retained(batches: DataFrame, log_starts: DataFrame) -> DataFrame:
    """The batches at or after their partition's log start."""
    return batches.join(log_starts, "partition_id").where("first_offset >= log_start").drop("log_start")


def removable_packs(extents: DataFrame, log_starts: DataFrame) -> DataFrame:
    """(lane, pack_sequence, extents, bytes) of sealed packs (all but a lane's last) whose every extent lies before the given log start of its partition."""
    last = extents.groupBy("lane").agg(F.max("pack_sequence").alias("active"))
    gone = F.coalesce(F.col("last_offset") < F.col("log_start"), F.lit(False))
    judged = extents.join(log_starts, "partition_id", "left").groupBy("lane", "pack_sequence").agg(F.bool_and(gone).alias("gone"), F.count("*").alias("extents"), F.sum("payload_bytes").alias("bytes"))
    return judged.join(last, "lane").where("gone and pack_sequence < active").select("lane", "pack_sequence", "extents", "bytes")


def tier_coverage(extents: DataFrame, objects: DataFrame, keys: Sequence[str] = ("partition_id",)) -> DataFrame:
    """(keys, covered_through): how far from 0 offloaded extents cover a partition without a gap (exclusive)."""
    offloaded = extents.join(objects.select("lane", "pack_sequence"), ["lane", "pack_sequence"], "left_semi")
    origin = extents.select(*keys).distinct().withColumn("zero", F.lit(0).cast("long"))
    return run_end(offloaded, list(keys), "first_offset", "last_offset", origin, "zero").select(*keys, F.col("run_end").alias("covered_through"))


def object_durable(extents: DataFrame, objects: DataFrame) -> DataFrame:
    """Extents with ``object_durable``: whether the manifest has their pack."""
    listed = objects.select("lane", "pack_sequence", F.lit(True).alias("__listed"))
    return extents.join(listed, ["lane", "pack_sequence"], "left").withColumn("object_durable", F.col("__listed").isNotNull()).drop("__listed")


def manifest_rows(extents: DataFrame) -> DataFrame:
    """One row per pack with its extents' ranges, as a manifest lists them."""
    return extents.groupBy("lane", "pack_sequence").agg(F.sum("payload_bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("partition_id", "first_offset", "last_offset"))).alias("extents"))
