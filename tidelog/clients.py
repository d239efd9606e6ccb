"""A producer that numbers what it sends, and readers that go on where they stopped, over a log store."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidelog.operators.admission import retry_delay_ms
from tidelog.store import LogError, LogStore, Page

#: Errors after which a request may be sent again, by the status that a caller over HTTP would see. Fixed values.
RETRIED = {"AdmissionLimited": 429, "DurabilityUnavailable": 503}
SENT = "partition_id int, arrival_seq long, record_count long, payload binary, producer_id string, epoch long, first_sequence long"


@dataclass
class Producer:
    """Sends batches of one partition; every batch has the sequence that follows the one before, so a repeated send is taken once."""

    store: LogStore
    topic_id: str
    partition_id: int
    producer_id: str
    epoch: int = 0
    next_sequence: int = 0
    max_request_bytes: int = 4 << 20
    retries: int = 3
    sleep: object = time.sleep

    def resume(self) -> None:
        """Goes on behind what the log holds of this producer, in the same epoch."""
        known = self.store.producer_progress(self.topic_id).where(f"partition_id = {self.partition_id}")
        for row in known.where(known["producer_id"] == self.producer_id).collect():
            self.epoch, self.next_sequence = row["epoch"], row["next_sequence"]

    def requests(self, batches: Sequence[tuple[bytes, int]]) -> list[list[tuple]]:
        """(payload, records) batches as rows, in requests of at most ``max_request_bytes``."""
        out: list[list[tuple]] = []
        sequence, used = self.next_sequence, 0
        for payload, records in batches:
            if len(payload) > self.max_request_bytes:
                raise LogError("PayloadTooLarge")
            if not out or used + len(payload) > self.max_request_bytes:
                out.append([])
                used = 0
            out[-1].append((self.partition_id, len(out[-1]), records, bytearray(payload), self.producer_id, self.epoch, sequence))
            used, sequence = used + len(payload), sequence + records
        return out

    def send(self, batches: Sequence[tuple[bytes, int]]) -> list[dict]:
        """Receipts of all batches, in order. A refused request is sent again as often as ``retries`` says, later each time."""
        receipts = []
        for rows in self.requests(batches):
            for attempt in range(self.retries + 1):
                try:
                    got = self.store.append(self.topic_id, self.store.spark.createDataFrame(rows, SENT)).orderBy("arrival_seq").collect()
                    break
                except LogError as error:
                    delay = retry_delay_ms(attempt, RETRIED.get(error.kind, 400))
                    if delay is None or attempt == self.retries:
                        raise
                    self.sleep(delay / 1000)
            bad = next((r["outcome"] for r in got if r["outcome"] not in ("accepted", "duplicate")), None)
            if bad is not None:
                raise LogError(bad)
            receipts += [r.asDict() for r in got]
            self.next_sequence = rows[-1][6] + rows[-1][2]
        return receipts

    def new_epoch(self) -> None:
        """Starts the next epoch; sequences go on across epochs."""
        self.epoch += 1


@dataclass
class Consumer:
    """Reads a partition page by page from an offset on."""

    store: LogStore
    topic_id: str
    partition_id: int
    offset: int
    max_bytes: int
    mode: str = "ordered"

    def poll(self) -> Iterator[Page]:
        """The pages that are visible now; the consumer moves behind each that it has handed out."""
        for page in self.store.pages(self.topic_id, self.partition_id, self.max_bytes, self.mode, self.offset):
            yield page
            self.offset = page.next_offset


@dataclass
class CursorConsumer:
    """Reads a partition by cursor. Reads that may have holes have no cursor."""

    store: LogStore
    topic_id: str
    partition_id: int
    max_bytes: int
    mode: str = "ordered"
    cursor: str | None = None

    def __post_init__(self) -> None:
        if self.mode == "as_available":
            raise LogError("InvalidConfig", "as-available reads have no cursor")
        self.cursor = self.cursor or self.store.cursor(self.topic_id, self.partition_id)

    def fetch(self) -> DataFrame:
        rows, self.cursor = self.store.fetch_next(self.topic_id, self.partition_id, self.cursor, self.max_bytes, self.mode)
        return rows
