"""Reservation of dense offsets, lane placement, pack assignment, and request checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import running_sums

#: Bytes of a stored frame besides its payload: header and checksum. Fixed values.
FRAME_HEADER, FRAME_CHECKSUM = 224, 8


def validate_requests(df: DataFrame, max_batch_bytes: int, count: str = "record_count", size: str = "payload_bytes") -> DataFrame:
    """``df`` with ``outcome``: accepted, ZeroRecordCount or PayloadTooLarge."""
    wrong = F.when(F.coalesce(F.col(count), F.lit(0)) <= 0, "ZeroRecordCount").when(F.col(size) > max_batch_bytes, "PayloadTooLarge")
    return df.withColumn("outcome", F.coalesce(wrong, F.lit("accepted")))


def reserve(df: DataFrame, keys: Sequence[str], arrival: str, count: str = "record_count", first_batch: int = 0, first_offset: int = 0) -> DataFrame:
    """Requests in arrival order get ``batch_id``, ``sequence``, ``first_offset`` and ``last_offset``; offsets are dense.

    ``first_batch`` and ``first_offset`` continue a log that has ended there.
    """
    out = running_sums(df, keys, arrival, {"batch_id": F.lit(1), "first_offset": F.col(count)})
    out = out.withColumns({"batch_id": F.col("batch_id") + first_batch, "first_offset": F.col("first_offset") + first_offset})
    return out.withColumns({"sequence": F.col("batch_id"), "last_offset": F.col("first_offset") + F.col(count) - 1})


def place(df: DataFrame, rings: Sequence[tuple[int, int, Sequence[int]]], sequence: str = "sequence") -> DataFrame:
    """``df`` with ``ring_epoch`` and ``lane``: ring[sequence % size] of the ring in force.

    ``rings``: (epoch, first sequence, lanes), epochs and first sequences rising. Sequences survive ring changes.
    """
    check_rings(rings)
    epoch, lane = F.lit(None).cast("long"), F.lit(None).cast("int")
    for number, begins, lanes in rings:
        at = (F.col(sequence) % len(lanes) + 1).cast("int")
        epoch = F.when(F.col(sequence) >= begins, F.lit(number).cast("long")).otherwise(epoch)
        lane = F.when(F.col(sequence) >= begins, F.element_at(F.array(*[F.lit(x).cast("int") for x in lanes]), at)).otherwise(lane)
    return df.withColumns({"ring_epoch": epoch, "lane": lane})


def check_rings(rings: Sequence[tuple[int, int, Sequence[int]]]) -> None:
    for _, _, lanes in rings:
        if not lanes or len(set(lanes)) != len(lanes):
            raise ValueError("a ring needs lanes, each once")
    for (a, x, _), (b, y, _) in zip(rings, rings[1:], strict=False):
        if b <= a:
            raise ValueError("ring epochs must rise")
        if y < x:
            raise ValueError("a later ring begins at an earlier sequence")


def physical_shard(lane: Column, shards: int) -> Column:
    return lane % shards


def ring_mismatches(df: DataFrame, rings: DataFrame) -> DataFrame:
    """Batches with ``valid``: whether their lane is what the ring of their epoch (ring_epoch, shards) says; an unknown epoch is invalid."""
    joined = df.join(rings.select("ring_epoch", "shards"), "ring_epoch", "left")
    expected = F.element_at("shards", (F.col("sequence") % F.size("shards") + 1).cast("int"))
    return joined.withColumn("valid", F.coalesce(expected == F.col("lane"), F.lit(False))).drop("shards")


def segments(df: DataFrame, key: str, order: Sequence[str], size: str, target: int, name: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns, name): consecutive rows share a segment until one would exceed ``target``; a segment is never empty.

    What a row starts depends on all rows before, so a key is one stream; rows are read in order in bounded memory.
    """
    kept = [key, *columns]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, number = object(), 0, 0
        for frame in frames:
            numbers = []
            for k, n in zip(frame[key].tolist(), frame[size].tolist(), strict=True):
                if k != at:
                    at, used, number = k, 0, 0
                if used and used + n > target:
                    used, number = 0, number + 1
                used += n
                numbers.append(number)
            yield frame[kept].assign(**{name: numbers})

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    rows = df.select(*dict.fromkeys([*kept, *order, size])).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(walk, f"{fields}, `{name}` long")


def packs(df: DataFrame, target: int, order: Sequence[str] = ("batch_id", "partition_id"), payload: str = "payload_bytes") -> DataFrame:
    """``df``'s batches with ``pack_sequence``: a lane rotates its pack when the next frame would pass the target."""
    framed = df.withColumn("__frame", F.col(payload) + FRAME_HEADER + FRAME_CHECKSUM)
    columns = [c for c in df.columns if c != "lane"]
    return segments(framed, "lane", order, "__frame", target, "pack_sequence", columns)


#: Extents that one write takes, and writes that one synchronisation covers. Fixed values.
WRITE_EXTENTS, SYNC_WRITES = 128, 8


def sync_groups(df: DataFrame, lane: str, order: str) -> DataFrame:
    """A lane's waiting extents, in order (a number that never repeats), with ``write_group`` and ``sync``: extents are written in groups and groups synchronised together."""
    numbered = running_sums(df, [lane], order, {"__n": F.lit(1)})
    group = F.floor(F.col("__n") / WRITE_EXTENTS).cast("long")
    return numbered.withColumn("write_group", group).withColumn("sync", F.floor(F.col("write_group") / SYNC_WRITES).cast("long")).drop("__n")


def sealed_packs(packs: DataFrame, now: Column, max_age: int) -> DataFrame:
    """``packs`` (lane, pack_sequence, opened) with ``sealed``: all but a lane's last, and the last one too when it is old enough."""
    last = packs.groupBy("lane").agg(F.max("pack_sequence").alias("__active"))
    return packs.join(last, "lane").withColumn("sealed", (F.col("pack_sequence") < F.col("__active")) | (now - F.col("opened") >= max_age)).drop("__active")


def producer_gaps(df: DataFrame, keys: Sequence[str], first: str, count: str) -> DataFrame:
    """Rows that do not begin where the row before of the producer ends, with ``expected``."""
    from tidelog.operators.prefix import with_previous

    linked = with_previous(df, keys, first, [first, count])
    expected = F.coalesce(F.col(f"previous.{first}") + F.col(f"previous.{count}"), F.lit(0))
    return linked.withColumn("expected", expected).where(F.col(first) != F.col("expected")).drop("previous")
