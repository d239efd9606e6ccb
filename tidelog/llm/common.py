"""What the operators of this package share: shared-folder tables, row-preserving Arrow maps, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in the syntax of Java and RE2: anything between ASCII space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a session names none (single-machine tests) a local temporary folder is made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        folder = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"


#: Rows of a batch that goes to Python and back: ten thousand, the default, would be tens of MB of texts on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python ``BATCH_ROWS`` at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut there and lost executors lose nothing of it.

    The shuffle files of the job that wrote the table are released when the job ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    small_batches(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    made = spark.read.schema(df.schema).parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.paths[id(made)] = (made, path)
    return made


class Scope:
    """Tables that ``written`` has made within a ``with`` block. They are deleted when the block ends, or earlier by ``drop``; those
    given to ``keep`` stay, and belong to the block around, if there is one."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scope:
        self.before = _SCOPE.set(self)
        return self

    def __exit__(self, *error) -> None:
        _SCOPE.reset(self.before)
        self.drop(*[df for df, _ in self.paths.values()])

    def keep(self, df: DataFrame) -> DataFrame:
        found = self.paths.pop(id(df))
        if isinstance(outer := self.before.old_value, Scope):
            outer.paths[id(df)] = found
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process. Hashing a short word again is quicker than looking it up."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def append_columns(df: DataFrame, column: str, fields: T.StructType, make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """All rows and columns of ``df`` with ``fields`` computed from ``column`` by one narrow Arrow map.

    ``make`` is called once per task and gives a function from a batch's values to one list per field. A column of ``df`` that
    has the name of a computed one (in any case) is replaced by it.
    """
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in names]
    # the text travels under a name of its own, so that replacing a column never hides the input
    source = f"__in_{uuid.uuid4().hex[:8]}"
    frame = df.select(F.col(f"`{column}`").alias(source), *[F.col(f"`{f.name}`") for f in kept])
    types = [to_arrow(f.dataType) for f in fields]
    out = T.StructType([*kept, *fields])
    labels = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in slices(batches):
            made = apply(batch.column(0).to_pylist())
            arrays = [*batch.columns[1:], *(pa.array(v, t) for v, t in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, labels)
        getattr(apply, "close", lambda: None)()  # workers serve later tasks too

    return frame.mapInArrow(tidy(run), out)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker serves later tasks, and text-sized blocks would stay with it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has the call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow map that gives memory back when its task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


#: Bytes of a batch that are Python objects at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of about ``SLICE_BYTES`` of a column, a row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(column).nbytes))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fold(column: Column) -> Column:
    """CRC-32 of the id as text, modulo 5: remainder 0 is the held-out fold; a null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5, F.lit(1))
