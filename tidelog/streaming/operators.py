"""Live operators with keyed state: the sequencer, the bounded reorder buffer, the producer check.

State is one entry per topic partition (or producer), kept by Spark's state store and checkpointed with the stream. A batch
that is run again after a failure finds the state of its start, so offsets are handed out once.
"""

from __future__ import annotations

import json
import pickle
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.producers import Cursor, judge
from tidelog.schemas import struct_of

#: Bounds of the reorder buffer per partition. Fixed values.
MAX_PENDING, MAX_GAP, MAX_BYTES = 256, 256, 256 << 20
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SEQUENCED = "partition_id int, arrival_seq long, batch_id long, first_offset long, last_offset long"
RELEASED = "partition_id int, batch_id long, payload string, outcome string"


#: Rows of a key that are sorted in memory; more are sorted in runs, which wait in files that have no name. Pieces that a run is read in, and runs that are merged at once.
RUN_ROWS, RUN_PIECES, RUNS = 100_000, 25, 16


def _spilled(frames: Iterator[pd.DataFrame]) -> IO[bytes]:
    """A file of frames, which goes when it is closed or its process ends."""
    out = tempfile.TemporaryFile()
    for frame in frames:
        pickle.dump(frame, out, pickle.HIGHEST_PROTOCOL)
    out.seek(0)
    return out


def _read(run: IO[bytes]) -> Iterator[pd.DataFrame]:
    with run:
        while True:
            try:
                yield pickle.load(run)
            except EOFError:
                return


def _cut(frame: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), rows):
        yield frame.iloc[at : at + rows]


def _merged(runs: list[IO[bytes]], order: str, rows: int) -> Iterator[pd.DataFrame]:
    """Sorted runs as one, with a piece of each in memory: what is not above the least end of a piece can go."""
    rest = [_read(r) for r in runs]
    heads = [next(r, None) for r in rest]
    while live := [i for i, h in enumerate(heads) if h is not None]:
        upto = min(heads[i][order].iloc[-1] for i in live)
        go = []
        for i in live:
            n = int(heads[i][order].searchsorted(upto, "right"))
            go.append(heads[i].iloc[:n])
            heads[i] = heads[i].iloc[n:]
            if heads[i].empty:
                heads[i] = next(rest[i], None)
        yield from _cut(pd.concat(go).sort_values(order, kind="stable"), rows)


def in_order(frames: Iterator[pd.DataFrame], order: str, run_rows: int = RUN_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of a key by ``order``, in frames of bounded length, however many there are."""
    rows, held, n, levels = max(1, run_rows // RUN_PIECES), [], 0, [[]]

    def run() -> pd.DataFrame:
        found = pd.concat(held).sort_values(order, kind="stable")
        held.clear()
        return found

    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= run_rows:
            n = 0
            levels[0].append(_spilled(_cut(run(), rows)))
            for k, level in enumerate(levels):  # so that the number of runs does not grow with the rows
                if len(level) >= RUNS:
                    if k + 1 == len(levels):
                        levels.append([])
                    levels[k + 1].append(_spilled(_merged(level, order, rows)))
                    levels[k] = []
    if not levels[0] and len(levels) == 1:
        if held:
            yield from _cut(run(), rows)
        return
    if held:
        levels[0].append(_spilled(_cut(run(), rows)))
    yield from _merged([r for level in reversed(levels) for r in level], order, rows)


class Sequencer(StatefulProcessor):
    """Requests of a partition, by arrival, get the next batch id and the next offsets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", struct_of("batch long, offset long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        batch, offset = self.next.get() if self.next.exists() else (0, 0)
        for arrived in in_order(rows, "arrival_seq"):
            out = []
            for seq, count in zip(arrived["arrival_seq"].tolist(), arrived["record_count"].tolist(), strict=True):
                out.append((int(key[0]), seq, batch, offset, offset + count - 1))
                batch, offset = batch + 1, offset + count
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCED.split(", ")])
        self.next.update((batch, offset))

    def close(self) -> None:
        pass


def release(waiting: dict[int, tuple[int, str]], expected: int, rows: list[tuple[int, int, str]], held: int, bounds: tuple[int, int, int] = (MAX_PENDING, MAX_GAP, MAX_BYTES)) -> tuple[list[tuple[int, str, str]], int, int]:
    """Batches in order: ((id, payload, outcome) list, next expected id, bytes held). ``waiting`` is changed in place.

    A copy of a waiting batch joins it, another payload under its id is corrupt; a batch beyond a bound is limited.
    """
    out: list[tuple[int, str, str]] = []
    for batch, size, payload in rows:
        if batch < expected:
            out.append((batch, payload, "duplicate"))
        elif batch in waiting:
            out.append((batch, payload, "joined" if waiting[batch] == (size, payload) else "corrupt"))
        elif batch != expected and (len(waiting) >= bounds[0] or batch - expected > bounds[1] or held + size > bounds[2]):
            out.append((batch, payload, "limited"))
        else:
            waiting[batch] = (size, payload)
            held += size
            while expected in waiting:
                size, payload = waiting.pop(expected)
                held -= size
                out.append((expected, payload, "released"))
                expected += 1
    return out, expected, held


class ReorderBuffer(StatefulProcessor):
    """Batches of a partition leave in the order of their ids, whatever the order they come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", struct_of("expected long, held long"))
        self.waiting = handle.getMapState("waiting", struct_of("batch_id long"), struct_of("size long, payload string"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        expected, held = self.at.get() if self.at.exists() else (0, 0)
        before = {k[0]: tuple(v) for k, v in self.waiting.iterator()}  # at most MAX_PENDING
        waiting = dict(before)
        for arrived in in_order(rows, "arrival_seq"):
            out, expected, held = release(waiting, expected, list(zip(arrived["batch_id"].tolist(), arrived["size"].tolist(), arrived["payload"].tolist(), strict=True)), held)
            if out:
                yield pd.DataFrame([(int(key[0]), *o) for o in out], columns=[c.split()[0] for c in RELEASED.split(", ")])
        for k in before.keys() - waiting.keys():
            self.waiting.removeKey((k,))
        for k in waiting.keys() - before.keys():
            self.waiting.updateValue((k,), waiting[k])
        self.at.update((expected, held))

    def close(self) -> None:
        pass


JUDGED = "producer_id long, arrival_seq long, outcome string"


#: Sequences that share an entry of what a producer has sent, and entries that are held at a time.
SENT_WIDTH, SENT_HELD = 256, 64


class Sent:
    """What a producer has sent, by (epoch, first_sequence), as ``judge`` asks for it. Reading or writing the state takes about a third of a millisecond, so
    neighbours are read and written together."""

    def __init__(self, state, fresh: bool):
        self.state, self.fresh, self.held, self.changed = state, fresh, OrderedDict(), set()

    def _near(self, place: tuple[int, int]) -> tuple[tuple[int, int], dict]:
        at = (place[0], place[1] // SENT_WIDTH)
        if at in self.held:
            self.held.move_to_end(at)
        else:
            if len(self.held) >= SENT_HELD:
                self._write(next(iter(self.held)))
            found = None if self.fresh else self.state.getValue(at)
            self.held[at] = {first: tuple(what) for first, *what in json.loads(found[0])} if found else {}
        return at, self.held[at]

    def _write(self, at: tuple[int, int]) -> None:
        near = self.held.pop(at)
        if at in self.changed:
            self.state.updateValue(at, (json.dumps([(first, *what) for first, what in near.items()]),))
            self.changed.discard(at)
            self.fresh = False

    def get(self, place: tuple[int, int]) -> tuple | None:
        return self._near(place)[1].get(place[1])

    def __setitem__(self, place: tuple[int, int], what: tuple) -> None:
        at, near = self._near(place)
        near[place[1]] = what
        self.changed.add(at)

    def close(self) -> None:
        for at in list(self.held):
            self._write(at)


class ProducerCheck(StatefulProcessor):
    """The rules of idempotent appends, live; what a producer has sent is map state, an entry for ``SENT_WIDTH`` sequences.

    A checkpoint of the form before, an entry for each append, is not taken up: such a stream starts with a new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", struct_of("epoch long, next_sequence long, failed boolean"))
        self.sent = handle.getMapState("sent", struct_of("epoch long, near long"), struct_of("appends string"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        known = self.cursor.get() if self.cursor.exists() else None
        cursor = Cursor(*(known or ()))
        cursor.seen = Sent(self.sent, known is None)
        for arrived in in_order(rows, "arrival_seq"):
            out = []
            for seq, *append in zip(*(arrived[c].tolist() for c in ("arrival_seq", "epoch", "first_sequence", "record_count", "digest", "event_id")), strict=True):
                out.append((int(key[0]), seq, judge(cursor, *append)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")])
        cursor.seen.close()
        if cursor.epoch >= 0:
            self.cursor.update((cursor.epoch, cursor.next_sequence, cursor.failed))

    def close(self) -> None:
        pass


def sequenced(requests: DataFrame) -> DataFrame:
    """Streaming (partition_id, arrival_seq, record_count) with ids and offsets."""
    return requests.groupBy("partition_id").transformWithStateInPandas(Sequencer(), SEQUENCED, "Append", "None")


def reordered(batches: DataFrame) -> DataFrame:
    """Streaming (partition_id, arrival_seq, batch_id, size, payload) in batch order."""
    return batches.groupBy("partition_id").transformWithStateInPandas(ReorderBuffer(), RELEASED, "Append", "None")


def judged(appends: DataFrame) -> DataFrame:
    """Streaming appends (as for operators.producers.outcomes) with outcomes."""
    return appends.groupBy("producer_id").transformWithStateInPandas(ProducerCheck(), JUDGED, "Append", "None")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything that is there now, in as many batches as the source makes, into Parquet files."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def linger_micros(now: int, group: int) -> int:
    """The next wait of an adaptive linger: twice as long after a group under 8, half after a full one of 128."""
    return min(now * 2, 60_000_000) if group < 8 else max(now // 2, 1) if group >= 128 else now


def parquet_stream(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path).select(F.col("*"))
