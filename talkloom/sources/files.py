"""Files as Spark sources, read by parts, and a sink of files.

`recordings`: one row a sound file, from the first 44 bytes of each.  `digests`: SHA-256 of whole files, carried from
block to block, or of their ranges, which are partitions of their own, so that a large file is read by many tasks.
`files`: writes each row's bytes to a file of that name.  Files are opened where pyarrow's file systems reach (local
and mounted folders, S3, GCS, HDFS); a task never holds more than BLOCK bytes of a file.
"""

from __future__ import annotations

import fnmatch
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HEADER, BLOCK = 44, 1 << 20
#: Files of one task, and bytes of one task unless a single piece is larger.
FILES, BYTES = 1000, 128 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str = "*") -> list[tuple[str, int]]:
    """(path, length) of the files below a folder whose name matches, in order; names that start with . or _ are left out."""
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, glob)]
    return sorted(names)


def typed(**columns: str) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


@dataclass
class Pieces(InputPartition):
    """(path, length of the file, number of the piece, offset, length of the piece) of each piece a task reads."""

    pieces: list[tuple[str, int, int, int, int]]


def dealt(pieces: list[tuple[str, int, int, int, int]], files: int = FILES, size: int = BYTES) -> list[Pieces]:
    out: list[Pieces] = []
    held = 0
    for p in pieces:
        if not out or len(out[-1].pieces) >= files or held + p[4] > size:
            out.append(Pieces([]))
            held = 0
        out[-1].pieces.append(p)
        held += p[4]
    return out


def head(system: fs.FileSystem, path: str, n: int = HEADER) -> bytes:
    with system.open_input_file(path) as f:
        return f.read(n)


def blocks(system: fs.FileSystem, path: str, offset: int, length: int) -> Iterator[bytes]:
    """The bytes of a range, BLOCK at a time."""
    with system.open_input_file(path) as f:
        f.seek(offset)
        while length > 0 and (got := f.read(min(BLOCK, length))):
            length -= len(got)
            yield got


class FolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.path, self.glob, self.options = to_arrow_schema(schema), options["path"], options.get("glob", "*"), dict(options)

    def rows(self, system: fs.FileSystem, piece: tuple[str, int, int, int, int]) -> tuple | None:
        raise NotImplementedError

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        made = [r for p in (partition.pieces if partition else ()) if (r := self.rows(system, p)) is not None]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), self.fields, strict=True)], schema=self.fields)


class RecordingReader(FolderReader):
    def partitions(self) -> list[Pieces]:
        return dealt([(p, n, 0, 0, HEADER) for p, n in listed(self.path, self.glob) if n >= HEADER])

    def rows(self, system, piece):
        path, length, *_ = piece
        channels, rate = struct.unpack_from("<HI", head(system, path), 22)
        if rate and channels:
            return path.rsplit("/", 1)[-1], length, rate, channels, (length - HEADER) * 1000 // (rate * channels * 2)
        return None


class Recordings(DataSource):
    """spark.read.format("recordings").option("glob", "*.wav").load(folder): files shorter than a header, or whose header
    names no rate or channel, go."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> StructType:
        return typed(filename="string", length="long", sample_rate="long", channels="long", duration_ms="long")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingReader(schema, self.options)


class DigestReader(FolderReader):
    def partitions(self) -> list[Pieces]:
        step = int(self.options.get("rangebytes", 0))
        pieces = []
        for path, n in listed(self.path, self.glob):
            for i, at in enumerate(range(0, max(n, 1), step or max(n, 1))):
                pieces.append((path, n, i, at, min(step, n - at) if step else n))
        return dealt(pieces)

    def rows(self, system, piece):
        path, length, part, offset, n = piece
        digest, seen = hashlib.sha256(), 0
        for block in blocks(system, path, offset, n):
            digest.update(block)
            seen += len(block)
        if seen != n:
            raise OSError(f"{path}: {seen} of {n} bytes at {offset}")
        return path.rsplit("/", 1)[-1], path, length, part, offset, seen, digest.hexdigest()


class Digests(DataSource):
    """spark.read.format("digests").load(folder): a row for each file, or with rangeBytes for each range of so many."""

    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> StructType:
        return typed(filename="string", path="string", length="long", part="integer", start="long", bytes="long", sha256="string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader(schema, self.options)


class FileWriter(DataSourceWriter):
    """A file is written under a name of its own and then moved, so that a task that runs twice leaves one whole file."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        for row in iterator:
            folder, _, name = f"{root}/{row['name']}".rpartition("/")
            at = f"{folder}/.{name}-{uuid.uuid4().hex}"
            if "/" in row["name"]:
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(at) as f:
                f.write(bytes(row["content"]))
            system.move(at, f"{root}/{row['name']}")
        return WriterCommitMessage()


class Files(DataSource):
    """df.select("name", "content").write.format("files").mode("append").save(folder); folders in names are made."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for kind in (Recordings, Digests, Files):
        spark.dataSource.register(kind)


def read_recordings(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    register(spark)
    return spark.read.format("recordings").option("glob", glob).load(path)


def write_files(df: DataFrame, path: str) -> None:
    """df: name, content (binary)."""
    register(df.sparkSession)
    df.select("name", "content").write.format("files").mode("append").save(path)


def manifest(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = 64 << 20) -> DataFrame:
    """filename, length, sha256, n_parts, tree_sha256 of each file: the digest of the whole, and the digest of its
    ranges' digests (32 bytes each, in order), which large files get from many tasks at once."""
    register(spark)
    whole = spark.read.format("digests").option("glob", glob).load(path)
    return whole.select("path", "filename", "length", "sha256").join(tree_digests(spark, path, glob, range_bytes), "path").drop("path")


def tree_digests(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = 64 << 20) -> DataFrame:
    """path, n_parts, tree_sha256; no task reads more of a file than range_bytes."""
    register(spark)
    parts = spark.read.format("digests").option("glob", glob).option("rangeBytes", range_bytes).load(path)
    each = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "sha256"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["sha256"]), ""))
    return each.select("path", F.size("p").alias("n_parts"), F.sha2(joined, 256).alias("tree_sha256"))


def wave(samples: str, rate: str, channels: str) -> F.Column:
    """A sound file of 16-bit samples (array<int>): the 44 bytes of its header and the samples, little-endian."""
    @F.pandas_udf("binary")
    def made(values: pd.Series, rates: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for v, r, c in zip(values, rates, counts, strict=True):
            data = np.clip(np.asarray([] if v is None else v, np.int64), -32768, 32767).astype("<i2").tobytes()
            out.append(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, c, r, r * c * 2, c * 2, 16, b"data", len(data)) + data)
        return pd.Series(out)

    return made(F.col(samples), F.col(rate), F.col(channels))
