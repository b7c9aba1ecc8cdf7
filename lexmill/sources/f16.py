"""Vectors as a flat row-major matrix of little-endian float16, as a Spark data source.

``spark.read.format("f16matrix").option("dim", 64).load(path)`` reads one file, or a folder of files that each hold the rows from
the number in their name on; ``df.write.format("f16matrix")`` writes such a folder. Rows carry no ids: ``chunk_id`` is the
row's number. Files are cut into byte ranges, so a large one is many tasks, and each task turns its bytes into
vectors as one array. Files are reached by ``pyarrow.fs`` (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, and of what a task holds at a time.
RANGE, HELD = 64 << 20, 4 << 20
_NAME = re.compile(r"rows-(\d+)\.f16\Z")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int, int]]:
    """(path, first row by name, bytes) of the files of a matrix in order of rows."""
    at, root = store(path)
    info = at.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, 0, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [(f.path, int(m[1]), f.size) for f in at.get_file_info(fs.FileSelector(root)) if (m := _NAME.match(f.base_name))]
    return sorted(found, key=lambda f: f[1])


@dataclass
class Range(InputPartition):
    path: str
    row: int
    start: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, path: str, dim: int, span: int):
        self.path, self.dim, self.span = path, dim, max(1, span // (2 * dim)) * 2 * dim

    def partitions(self):
        out = []
        for path, row, size in files_of(self.path):
            if size % (2 * self.dim):
                raise ValueError(f"{path} holds {size} bytes, no whole number of rows of {self.dim}")
            out += [Range(path, row + start // (2 * self.dim), start, min(self.span, size - start)) for start in range(0, size, self.span)]
        return out

    def read(self, partition: Range):
        at, _ = store(self.path)
        step = max(1, HELD // (2 * self.dim)) * 2 * self.dim
        with at.open_input_file(partition.path) as f:
            for start in range(0, partition.size, step):
                raw = f.read_at(min(step, partition.size - start), partition.start + start)
                x = np.frombuffer(raw, "<f2").astype(np.float32)
                n = len(x) // self.dim
                ids = np.arange(n, dtype=np.int64) + partition.row + start // (2 * self.dim)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors], ["chunk_id", "vector"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    row: int


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its rows, which must be in order without a gap; files get their names when all are there."""

    def __init__(self, path: str, dim: int):
        self.path, self.dim, self.run = path, dim, uuid.uuid4().hex

    def write(self, batches):
        at, root = store(self.path)
        at.create_dir(root, recursive=True)
        name, first, last = f"{root}/.{self.run}-{uuid.uuid4().hex}", None, None
        with at.open_output_stream(name) as out:
            for b in batches:
                ids, vectors = b.column("chunk_id").to_numpy(), b.column("vector")
                if not len(ids):
                    continue
                sizes = np.diff(vectors.offsets.to_numpy())
                if vectors.null_count or (sizes != self.dim).any():
                    raise ValueError(f"a vector is not {self.dim} long")
                if (np.diff(ids) != 1).any() or last is not None and ids[0] != last + 1:
                    raise ValueError("rows are not in order without a gap")
                first, last = int(ids[0]) if first is None else first, int(ids[-1])
                out.write(vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2").tobytes())
        if first is None:
            at.delete_file(name)
        return Part("" if first is None else name, first or 0)

    def commit(self, messages):
        at, root = store(self.path)
        for m in messages:
            if m is not None and m.name:
                at.move(m.name, f"{root}/rows-{m.row:015d}.f16")

    def abort(self, messages):
        at, root = store(self.path)
        for f in at.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                at.delete_file(f.path)


class F16Matrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "f16matrix"

    def schema(self) -> str:
        return "chunk_id long, vector array<float>"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options["dim"]), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options["path"], int(self.options["dim"]))


def read_f16(spark: SparkSession, path: str, count: int, dim: int) -> DataFrame | None:
    """(chunk_id, vector) of a matrix of ``count`` rows; None where the files do not hold just these, which means lexical mode."""
    try:
        found = files_of(path)
    except FileNotFoundError:
        return None
    row = 0
    for _, first, size in found:
        if first != row or size % (2 * dim):
            return None
        row += size // (2 * dim)
    if row != count:
        return None
    spark.dataSource.register(F16Matrix)
    return spark.read.format("f16matrix").option("dim", dim).load(path)


def write_f16(vectors: DataFrame, path: str, dim: int) -> None:
    """Write ``vectors(chunk_id, vector)``, ids from 0 without a gap, to a new folder; ranges of ids are tasks and files."""
    vectors.sparkSession.dataSource.register(F16Matrix)
    rows = vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.format("f16matrix").option("dim", dim).mode("append").save(path)
