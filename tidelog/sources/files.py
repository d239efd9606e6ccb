"""Python data sources for pack files and journals, and codecs over binary columns.

A source lists its files on the driver and reads them in tasks of some MB of files each. Paths are read with Arrow's file systems, so any
store that Arrow knows (``file://``, ``hdfs://``, ``s3://``) works; other stores are read with Spark's ``binaryFile`` source and the decoders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from tidelog import schemas
from tidelog.functions import codecs, records


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed_sizes(path: str, suffix: str) -> list[tuple[str, int]]:
    """(file, bytes) of a folder's files that end in ``suffix``, by name; a file is itself."""
    files, root = _open(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://"
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def listed(path: str, suffix: str) -> list[str]:
    """The files of a folder that end in ``suffix``, by name; a file is itself."""
    return [name for name, _ in listed_sizes(path, suffix)]


def read_bytes(path: str) -> bytes:
    files, root = _open(path)
    with files.open_input_stream(root) as stream:
        return stream.read()


class FilePartition(InputPartition):
    def __init__(self, path: str, last: bool):
        super().__init__(path)
        self.path, self.last = path, last


def pack_number(path: str) -> int:
    digits = "".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit())
    return int(digits) if digits else 0


def extent_row(number: int, at: int, x: dict) -> tuple:
    """An extent in the order of schemas.EXTENTS."""
    place = (x["virtual_lane_id"], x["ring_epoch"], x["leader_epoch"], x["sequence"])
    producer = None if x["producer_id"] is None else (x["producer_id"], x["epoch"], x["producer_first_sequence"], x["event_id"])
    group = None if x["transaction_id"] is None else (x["transaction_id"], x["chunk_sequence"])
    return (number, at, x["topic_id"], x["partition_id"], x["batch_id"], x["first_offset"], x["last_offset"], x["record_count"], place, producer, group, x["payload"])


class PacksPartition(InputPartition):
    """Packs that one task reads, one after another; ``last``: whether the folder's last pack is the last of them."""

    def __init__(self, paths: list[str], last: bool):
        super().__init__(paths)
        self.paths, self.last = paths, last


#: Bytes of packs that a task reads, one pack at least. A task costs more than reading a small pack.
TASK_BYTES = 16 << 20


class ExtentReader(DataSourceReader):
    """Packs of one folder. Equality filters on topic and partition are applied while frames are read."""

    def __init__(self, options: dict):
        self.path, self.equal = options["path"], {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("topic_id",), ("partition_id",)):
                self.equal[f.attribute[0]] = f.value
            yield f  # Spark applies every filter again

    def partitions(self) -> Sequence[InputPartition]:
        tasks, held = [], TASK_BYTES
        for path, size in listed_sizes(self.path, ".sse"):
            if held + size > TASK_BYTES:
                tasks.append([])
                held = 0
            tasks[-1].append(path)
            held += size
        return [PacksPartition(paths, paths is tasks[-1]) for paths in tasks]

    def read(self, partition: PacksPartition) -> Iterator[pa.RecordBatch]:
        return _packed(self._rows(partition))

    def _rows(self, partition: PacksPartition) -> Iterator[tuple]:
        for path in partition.paths:
            for at, extent in codecs.scan_extents(read_bytes(path), partition.last and path == partition.paths[-1]):
                if all(extent[name] == value for name, value in self.equal.items()):
                    yield extent_row(pack_number(path), at, extent)


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of schemas.EXTENTS in batches of about ``BATCH_BYTES``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(schemas.EXTENTS)
    structs = [f.type if pa.types.is_struct(f.type) else None for f in schema]
    held, size = [], 0
    for row in rows:
        held.append(tuple(v if t is None or v is None else dict(zip(t.names, v, strict=True)) for v, t in zip(row, structs, strict=True)))
        size += codecs.EXTENT_HEADER + len(row[-1])
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class ExtentLog(DataSource):
    """``spark.read.format("extentlog").option("path", folder).load()``: a row per stored extent."""

    @classmethod
    def name(cls) -> str:
        return "extentlog"

    def schema(self) -> StructType:
        return schemas.EXTENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExtentReader(dict(self.options))


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePartition(p, True) for p in listed(self.path, ".ssj")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        events, _ = codecs.scan_journal(read_bytes(partition.path))
        for number, event in enumerate(events):
            yield tuple(number if f == "event_no" else event.get(f) for f in schemas.JOURNAL.names)


class JournalLog(DataSource):
    """``spark.read.format("journallog").option("path", file or folder).load()``: a row per control event."""

    @classmethod
    def name(cls) -> str:
        return "journallog"

    def schema(self) -> StructType:
        return schemas.JOURNAL

    def reader(self, schema: StructType) -> DataSourceReader:
        return JournalReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the pack source takes filters
    spark.dataSource.register(ExtentLog)
    spark.dataSource.register(JournalLog)


#: Bytes of a batch on its way to Python, and of rows that are Python objects at a time; a longer row goes alone. Spark's own bound is
#: ten thousand rows, which may be any number of bytes.
BATCH_BYTES = 4 << 20


def _bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python ``BATCH_BYTES`` at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of about ``BATCH_BYTES``, a row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _exploded(df: DataFrame, column: str, keep: Sequence[str], schema: StructType, decode: Callable[[bytes], list[tuple]]) -> DataFrame:
    """The rows that ``decode`` finds in a binary column, each with the ``keep`` columns; null gives none."""
    from pyspark.sql.pandas.types import to_arrow_type

    _bounded_batches(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    out = StructType([*kept, *schema.fields])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            who, rows = [], []
            for i, data in enumerate(batch.column(len(keep))):
                found = decode(data.as_py()) if data.is_valid else []
                rows += found
                who += [i] * len(found)
            index = pa.array(who, pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(len(keep))), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], out.names)

    return df.select(*keep, F.col(column)).mapInArrow(run, out)


FRAME_ROWS = schemas.struct_of("request_id string, batch_id string, event_id string, transaction_id string, chunk_sequence bigint, first_offset bigint, last_offset bigint, record_count bigint, virtual_lane_id bigint, ring_epoch bigint, leader_epoch bigint, sequence bigint, payload binary")
RECORD_ROWS = schemas.struct_of("record_offset bigint, record_timestamp bigint, record_key binary, record_value binary, producer_id bigint, producer_epoch int, producer_sequence int")


def decode_frames(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row per fetch frame in a binary column."""
    return _exploded(df, column, keep, FRAME_ROWS, lambda data: [tuple(r[n] for n in FRAME_ROWS.names) for r in codecs.decode_frames(data)])


def decode_records(df: DataFrame, column: str, first_offset: str = "first_offset", keep: Sequence[str] = ()) -> DataFrame:
    """A row per record of the record batches in a binary column; offsets follow the stored batch's ``first_offset``."""
    names = list(dict.fromkeys([*keep, first_offset]))

    def decode(data: bytes) -> list[tuple]:
        found = records.scan_batches(data)["records"]
        return [(i, r["timestamp"], r["key"], r["value"], r["producer_id"], r["producer_epoch"], r["sequence"]) for i, r in enumerate(found)]

    rows = _exploded(df, column, names, RECORD_ROWS, decode)
    placed = rows.withColumn("record_offset", F.col("record_offset") + F.col(first_offset))
    return placed if first_offset in keep else placed.drop(first_offset)


def encode_column(df: DataFrame, encode: Callable[[dict], bytes], name: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns with ``name``, the encoding of each row's ``columns``."""
    _bounded_batches(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    out = StructType([*kept, *schemas.struct_of(f"{name} binary").fields])
    names = [c for c in columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            made = pa.array([encode({c: r[c] for c in columns}) for r in batch.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), made], out.names)

    return df.select(*keep, *names).mapInArrow(run, out)


def write_packs(extents: DataFrame, folder: str) -> DataFrame:
    """Writes (lane, pack_sequence and the columns of an extent) rows as pack files, extents by ``sequence``; returns (lane, pack_sequence, bytes) of each.

    A pack is one task's file, of the size that packs are cut to, and gets its name when it is whole.
    """

    columns = extents.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, done = None, [], []

        def finish() -> None:
            lane, number = at
            files, root = _open(f"{folder}/lane-{lane:05d}")
            files.create_dir(root, recursive=True)
            name = f"{root}/pack-{number:020d}.sse"
            with files.open_output_stream(f"{name}.part") as out:
                out.write(b"".join(parts))
            files.move(f"{name}.part", name)
            done.append((lane, number, sum(map(len, parts))))
            parts.clear()

        for batch in _pieces(batches):
            for row in batch.to_pylist():
                if (key := (row["lane"], row["pack_sequence"])) != at:
                    if parts:
                        finish()
                    at = key
                parts.append(codecs.encode_extent(row))
        if parts:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["lane", "pack_sequence", "bytes"])

    _bounded_batches(extents.sparkSession)
    rows = extents.repartition("lane", "pack_sequence").sortWithinPartitions("lane", "pack_sequence", "sequence").select(*columns)
    return rows.mapInArrow(write, "lane int, pack_sequence bigint, bytes bigint")
