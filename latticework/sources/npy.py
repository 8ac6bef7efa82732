"""A Spark data source for .npy matrices: headers are read once, and tasks read ranges of rows.

``spark.dataSource.register(NpySource)``, then ``spark.read.format("npy").load(path)``. Files are opened by Arrow's file systems
(local and shared folders, and the stores that Arrow knows by their URI), on the driver and on executors alike. ``files.read_npy`` reads by
way of Spark's own stores instead, a file a task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a task's range of rows, and rows of a batch.
RANGE_BYTES = 64 << 20
BATCH = 1 << 16


@dataclass
class Header:
    """Where a file's numbers start, their type, whether columns follow each other instead of rows, and the matrix's shape."""

    start: int
    kind: str
    by_column: bool
    rows: int
    dims: int


@dataclass
class Rows(InputPartition):
    path: str
    header: Header
    first: int
    count: int


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def header_of(path: str) -> Header:
    fs, name = located(path)
    with fs.open_input_file(name) as f:
        head = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
        version = np.lib.format.read_magic(head)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if kind.hasobject or kind.kind not in "biuf" or len(shape) not in (1, 2):
            raise ValueError(f"{path} holds no matrix of numbers")
        found = Header(head.tell(), kind.str, bool(by_column and len(shape) == 2), shape[0], shape[1] if len(shape) == 2 else 1)
        if f.size() < found.start + found.rows * found.dims * kind.itemsize:
            raise ValueError(f"{path} is shorter than its header says")
    return found


def files_at(path: str) -> list[str]:
    """The .npy files at a path: the file itself, or those in the folder."""
    fs, name = located(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else path.partition("://")[0] + "://"
    return sorted(prefix + i.path for i in fs.get_file_info(pafs.FileSelector(name)) if i.type == pafs.FileType.File and i.path.endswith(".npy"))


def batches(part: Rows, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """(row, x0 ..) of a range of rows, read a batch at a time."""
    fs, name = located(part.path)
    h, kind = part.header, np.dtype(part.header.kind)
    with fs.open_input_file(name) as f:
        for at in range(part.first, part.first + part.count, size):
            n = min(size, part.first + part.count - at)
            if h.by_column:
                columns = [np.frombuffer(f.read_at(n * kind.itemsize, h.start + (i * h.rows + at) * kind.itemsize), kind) for i in range(h.dims)]
            else:
                x = np.frombuffer(f.read_at(n * h.dims * kind.itemsize, h.start + at * h.dims * kind.itemsize), kind).reshape(n, h.dims)
                columns = [x[:, i] for i in range(h.dims)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(c.astype(np.float64)) for c in columns)], ["row", *(f"x{i}" for i in range(h.dims))])


class NpyReader(DataSourceReader):
    def __init__(self, found: list[tuple[str, Header]], range_bytes: int):
        self.found, self.range_bytes = found, range_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for path, h in self.found:
            step = max(1, self.range_bytes // max(1, h.dims * np.dtype(h.kind).itemsize))
            out += [Rows(path, h, at, min(step, h.rows - at)) for at in range(0, h.rows, step)]
        return out or [Rows("", Header(0, "<f8", False, 0, 1), 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.count:
            yield from batches(partition)


class NpySource(DataSource):
    """(row, x0 .. x{dims-1}) of the matrix at ``path``, or of all .npy files in that folder, of equally many columns; ``row`` counts in each file.

    Option ``rangeBytes``: bytes of a task's range. Numbers of any kind become doubles; matrices by row or by column are read in ranges alike.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _found(self) -> list[tuple[str, Header]]:
        if not hasattr(self, "_headers"):
            self._headers = [(p, header_of(p)) for p in files_at(self.options["path"])]
            if len({h.dims for _, h in self._headers}) > 1:
                raise ValueError("matrices of different numbers of columns")
        return self._headers

    def schema(self) -> str:
        found = self._found()
        return "row long, " + ", ".join(f"x{i} double" for i in range(found[0][1].dims if found else 1))

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self._found(), int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_npy_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rangeBytes", range_bytes).load(path)
