"""Outcomes of idempotent appends, rule by rule, in arrival order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Cursor:
    """What is known of one producer."""

    epoch: int = -1
    next_sequence: int = 0
    failed: bool = False
    seen: dict[tuple[int, int], tuple] = field(default_factory=dict)


def judge(cursor: Cursor, epoch: int, first: int, count: int, digest: object, event: object) -> str:
    """The outcome of one append; an accepted one moves the cursor."""
    if cursor.epoch < 0:
        if first != 0:
            return "out_of_order"
    elif epoch < cursor.epoch:
        return "stale_epoch"
    elif epoch == cursor.epoch:
        known = cursor.seen.get((epoch, first))
        if known is not None:
            return "duplicate" if known == (digest, event, count) else "duplicate_mismatch"
        if cursor.failed:
            return "requires_new_epoch"
        if first != cursor.next_sequence:
            return "out_of_order"
    elif first != cursor.next_sequence:
        return "out_of_order"
    cursor.epoch, cursor.next_sequence, cursor.failed = epoch, first + count, False
    cursor.seen[(epoch, first)] = (digest, event, count)
    return "accepted"


#: Completions of an accepted append after which its producer needs a new epoch: written or not is open, or certainly not written.
FAILURES = ("failed", "aborted")


def complete(cursor: Cursor, epoch: int, first: int, completion: str | None) -> None:
    """What becomes of an accepted append: a failed one is not remembered as sent, and its producer has to start a new epoch."""
    if completion in FAILURES:
        cursor.failed = True
        cursor.seen.pop((epoch, first), None)


def restore(cursor: Cursor, epoch: int, first: int, count: int, digest: object, event: object) -> str:
    """Takes up an append that the log already holds."""
    cursor.epoch, cursor.next_sequence = max(cursor.epoch, epoch), max(cursor.next_sequence, first + count)
    cursor.seen[(epoch, first)] = (digest, event, count)
    return "stored"


def judge_all(rows: Iterable[tuple]) -> Iterator[str]:
    """Outcomes of (producer, epoch, first, count, digest, event, completion, stored) rows that come producer by producer, in arrival order."""
    at, cursor = object(), Cursor()
    for producer, *append, completion, stored in rows:
        if producer is None or producer != producer:  # no identity: nothing to hold against
            yield "stored" if stored else "accepted"
            continue
        if producer != at:
            at, cursor = producer, Cursor()
        outcome = (restore if stored else judge)(cursor, *append)
        if outcome == "accepted":
            complete(cursor, append[0], append[1], completion)
        yield outcome


COLUMNS = ("producer_id", "epoch", "first_sequence", "record_count", "digest", "event_id")


def outcomes(df: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """``df`` (the columns of COLUMNS, the arrival order, ``stored`` for what the log holds already, and, if it is there, ``completion``, what
    became of an append that was accepted: one of FAILURES, or anything else for success) with ``outcome``.

    An append is complete before the producer's next one is judged. A producer's appends form one sequence and are read in order by one task, in batches; producers are spread by hash.
    """
    df = df if "stored" in df.columns else df.withColumn("stored", F.lit(False))
    df = df if "completion" in df.columns else df.withColumn("completion", F.lit(None).cast("string"))
    names = df.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def rows() -> Iterator[tuple]:
            for frame in frames:
                held.append(frame)
                yield from zip(*(frame[c].tolist() for c in (*COLUMNS, "completion", "stored")), strict=True)

        found, done = judge_all(rows()), []
        for outcome in found:
            done.append(outcome)
            while held and len(done) >= len(held[0]):
                frame = held.pop(0)
                yield frame.assign(outcome=done[: len(frame)])
                done = done[len(frame) :]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition("producer_id").sortWithinPartitions("producer_id", arrival).select(*names).mapInPandas(walk, f"{schema}, outcome string")


def progress(judged: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """(producer_id, epoch, next_sequence, requires_new_epoch) after all appends, from the rows and outcomes of ``outcomes``.

    A failure bars its epoch until a later one is accepted, so the last accepted append's completion says whether the producer is barred.
    """
    taken = judged.where(F.col("outcome") == "accepted")
    barred = F.coalesce(F.max_by(F.coalesce(F.col("completion").isin(*FAILURES), F.lit(False)), arrival), F.lit(False))
    return taken.groupBy("producer_id").agg(F.max("epoch").alias("epoch"), F.max(F.col("first_sequence") + F.col("record_count")).alias("next_sequence"), barred.alias("requires_new_epoch"))
