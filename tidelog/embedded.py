"""One log without topics: the caller numbers its records, groups are appended whole, and files behind a sequence can be dropped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.store import Limits, LogError, LogStore

TOPIC = "1"


@dataclass
class EmbeddedLog:
    """``root``: a folder that driver and executors share. A published group is durable and sealed, so ``sync`` and ``seal`` find nothing to do."""

    spark: SparkSession
    root: str
    limits: Limits = field(default_factory=lambda: Limits(max_batch_bytes=64 << 20))

    def __post_init__(self) -> None:
        self.store = LogStore(self.spark, self.root, self.limits)
        self.store.create_topic(TOPIC, 1, [0])
        self.bounds()

    def _part(self) -> dict:
        return self.store.state["topics"][TOPIC]["parts"]["0"]

    def bounds(self) -> tuple[int, int] | None:
        """The retained half-open range of sequences; None for an empty log. A gap is an error."""
        first, last, n = self.store.batches(TOPIC).agg(F.min("first_offset"), F.max("last_offset"), F.sum("record_count")).first()
        if not n:
            return None
        if last - first + 1 != n:
            raise LogError("InvalidInput", "the retained sequence has a gap")
        return first, last + 1

    def append_group(self, first_sequence: int, records: Sequence[bytes]) -> dict:
        """Appends records as ``first_sequence`` and what follows. The first group of a log may start anywhere, later ones where it ends."""
        if not records:
            raise LogError("InvalidInput", "a group cannot be empty")
        if max(map(len, records)) > self.limits.max_batch_bytes:
            raise LogError("PayloadTooLarge")
        if first_sequence < 0 or first_sequence + len(records) > 1 << 63:
            raise LogError("InvalidInput", "the sequence is exhausted")
        part = self._part()
        if part["next_batch"] == 0:
            state = self.store._copy()
            state["topics"][TOPIC]["parts"]["0"] |= {"next_offset": first_sequence, "log_start": first_sequence}
            self.store._publish(state)
        elif part["next_offset"] != first_sequence:
            raise LogError("InvalidInput", f"the next sequence is {part['next_offset']}")
        rows = self.spark.createDataFrame([(0, i, 1, bytearray(r)) for i, r in enumerate(records)], "partition_id int, arrival_seq long, record_count long, payload binary")
        self.store.append(TOPIC, rows)
        return {"first_sequence": first_sequence, "last_sequence": first_sequence + len(records) - 1, "record_count": len(records), "payload_bytes": sum(map(len, records))}

    def read_from(self, start: int, max_bytes: int, max_records: int) -> DataFrame:
        """(sequence, payload) of the records from ``start`` on, within both limits; the first record always."""
        rows = self.store.fetch(TOPIC, 0, max(start, self._part()["log_start"]), max_bytes, "ordered", max_records)
        return rows.select(F.col("first_offset").alias("sequence"), "payload").orderBy("sequence")

    def sync(self) -> None:
        pass

    def seal(self) -> None:
        pass

    def compact_before(self, sequence: int) -> dict:
        """Drops the groups that lie wholly before ``sequence``; returns packs, records and bytes removed."""
        data = self.store.state["data"]
        if not data:
            return {"packs_removed": 0, "records_removed": 0, "bytes_removed": 0}
        gone = [g for g in (self.store._stored([d]).agg(F.max("last_offset").alias("last"), F.sum("record_count").alias("records"), F.sum("payload_bytes").alias("bytes")).first() for d in data) if g["last"] < sequence]
        if gone:
            self.store.truncate(TOPIC, 0, max(g["last"] for g in gone) + 1)
            self.store.reclaim()
        return {"packs_removed": len(gone), "records_removed": sum(g["records"] for g in gone), "bytes_removed": sum(g["bytes"] for g in gone)}
