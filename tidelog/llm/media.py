"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A text's bytes, padded with zeros to a positive multiple of 64, become one grey 8-bit PNG image of 64 samples a row; PNG is
lossless and its bytes depend on the samples alone. A task writes the images of its rows into tar shards in the shared folder, each distinct
image once per shard, named by its SHA-256 digest; a row carries digest, shard, offset and length. Metadata columns come from range
reads of the 33 header bytes; payloads are read back by offset and length, checked against the digest and decoded.

A shard gets its final name only when it is whole, and a repeated task writes shards of its own, so the rows of a task always
point to shards that it finished. The index is a table in the shared folder, written once.

Defined cases: a null text is an empty one (64 zero bytes); equal texts give equal values; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scratch, slices, tidy, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the IHDR chunk with its length, name and CRC.
HEADER_BYTES = 33
#: A shard is closed when it holds so much.
SHARD_BYTES = 64 << 20
LEVEL = 3


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image whose samples, row by row, are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # the first column: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the header of a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(image[:HEADER_BYTES])
    size, kind = struct.unpack(">I4s", image[HEADER_BYTES : HEADER_BYTES + 8])
    if kind != b"IDAT":
        raise ValueError("no image data")
    body = image[HEADER_BYTES + 8 : HEADER_BYTES + 8 + size]
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class ShardWriter:
    """Tar shards of one task: at most ``SHARD_BYTES`` and one member more each."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, image: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(image).hexdigest()
        if self.out is not None and self.size >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name, self.size, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}.part")
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
            self.known[digest] = self.size + len(head)
            self.size += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
        return digest, self.name, self.known[digest], len(image)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.files.move(f"{self.folder}/{self.name}.part", f"{self.folder}/{self.name}")
            self.out = None


INDEX = "n_bytes long, media_sha256 string, folder string, shard string, offset long, media_bytes long"


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the payloads of all rows; returns the index: the id and ``INDEX``."""
    folder = folder or scratch(df.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        done = []
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                n, payload = padded(text)
                digest, shard, offset, length = writer.add(to_png(payload))
                rows.append((n, digest, folder, shard, offset, length))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            ids = pa.array(batch.column(0).to_pylist(), batch.schema.field(0).type)  # a copy: the batch's texts can go
            done.append(pa.RecordBatch.from_arrays([ids, *map(_column, columns, _INDEX_TYPES)], [id_col, *_INDEX_NAMES]))
        writer.close()  # before any row leaves: rows point to whole shards only
        yield from done

    frame = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = df.schema[id_col].dataType.simpleString()
    return written(frame.mapInArrow(tidy(run), f"`{id_col}` {kind}, {INDEX}"), "media-index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]


def _column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(list(values), kind)


class ShardReader:
    """Range reads of a task's shards; one shard is open at a time."""

    def __init__(self):
        self.at = self.file = None

    def read(self, folder: str, shard: str, offset: int, length: int) -> bytes:
        if self.at != (folder, shard):
            files, path = fs.FileSystem.from_uri(folder)
            if self.file is not None:
                self.file.close()
            self.file, self.at = files.open_input_file(f"{path}/{shard}"), (folder, shard)
        self.file.seek(offset)
        got = self.file.read(length)
        if len(got) != length:
            raise EOFError(f"{shard} ends before {offset + length}")
        return got


def _read(index: DataFrame, schema: str, row_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader()
        for batch in batches:
            place = zip(*(batch.column(c).to_pylist() for c in ("folder", "shard", "offset", "media_bytes", "media_sha256")), strict=True)
            rows = [row_of(reader, *p) for p in place]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(_column, columns, types)], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(tidy(run), f"{kinds}, {schema}")


def read_headers(index: DataFrame) -> DataFrame:
    """The index with ``width``, ``height``, ``sample_bits``: 33 bytes of each payload are read."""
    return _read(index, "width long, height long, sample_bits long", lambda reader, folder, shard, offset, length, digest: png_header(reader.read(folder, shard, offset, HEADER_BYTES)))


def _features(reader: ShardReader, folder: str, shard: str, offset: int, length: int, digest: str) -> tuple:
    image = reader.read(folder, shard, offset, length)
    if hashlib.sha256(image).hexdigest() != digest:
        raise ValueError(f"{shard} at {offset} is not {digest}")
    payload = from_png(image)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = int((counts * np.arange(256)).sum()) / len(payload)
    feature = f"mean={mean:.3f};entropy={abs(float((share * np.log2(share)).sum())):.3f};levels={len(share)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), feature


def read_features(index: DataFrame) -> DataFrame:
    """The index with ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` and ``feature`` (mean sample, bits of entropy, levels used), of the bytes read back."""
    return _read(index, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", _features)
