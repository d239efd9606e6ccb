"""The object tier: files copied and checked by executors, each with its size and BLAKE3 checksum."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession

from tidelog.functions.hashing import blake3


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _bytes(uri: str) -> bytes:
    files, path = _open(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def _copy(source: str, target: str) -> tuple[int, str]:
    """A file, a pack at most, under its final name only when it is whole."""
    data = _bytes(source)
    files, path = _open(target)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(f"{path}.part") as f:
        f.write(data)
    files.move(f"{path}.part", path)
    return len(data), blake3(data).hex()


def copy(spark: SparkSession, listed: list[tuple[str, str]], root: str, tier: str) -> list[dict]:
    """Copies (folder, name) files from ``root`` to ``tier``; returns folder, name, bytes and checksum of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [_copy(f"{root}/{name}", f"{tier}/{name}") for name in frame["name"]]
            yield frame.assign(bytes=[d[0] for d in done], checksum=[d[1] for d in done])

    files = spark.createDataFrame(listed, "folder string, name string").repartition(max(1, len(listed)))
    return [r.asDict() for r in files.mapInPandas(run, "folder string, name string, bytes bigint, checksum string").collect()]


def damaged(spark: SparkSession, listed: list[tuple[str, str, int, str, str]]) -> list[str]:
    """The names of (folder, name, bytes, checksum, tier) files that are missing or differ."""

    def differs(tier: str, name: str, size: int, checksum: str) -> bool:
        try:
            data = _bytes(f"{tier}/{name}")
        except OSError:
            return True
        return (len(data), blake3(data).hex()) != (size, checksum)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[differs(*row) for row in zip(frame["tier"], frame["name"], frame["bytes"], frame["checksum"], strict=True)]][["name"]]

    if not listed:
        return []
    files = spark.createDataFrame(listed, "folder string, name string, bytes bigint, checksum string, tier string").repartition(len(listed))
    return sorted(r["name"] for r in files.mapInPandas(run, "name string").collect())
