"""Binary sparse matrices (.bsmat): a Spark data source over byte ranges, and a writer.

Fixed layout, little-endian: int32 rows, int32 columns, uint32 entries, then 16 bytes for each entry: uint32 row,
uint32 column, float64 value.  A second file (.degs) has an int32 for each row, its number of entries; their sum, not
the header, counts.  Either may be gzipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import Graph
from ..operators.placement import degrees
from ..storage import ship
from .files import exists, filesystem, is_gzip, opened, size

HEADER = struct.Struct("<iiI")
RECORD = np.dtype([("i", "<u4"), ("j", "<u4"), ("v", "<f8")])
#: Entries of a partition of an uncompressed file, and of a batch.
SPLIT, BATCH = 1 << 22, 1 << 18


def degree_path(path: str) -> str:
    stem = path.removesuffix(".gz")
    for p in (f"{stem}.degs", f"{stem}.degs.gz"):
        if exists(p):
            return p
    raise FileNotFoundError(f"{stem}.degs")


def read_header(path: str) -> tuple[int, int]:
    """(rows, columns)"""
    with opened(path) as f:
        data = f.read(HEADER.size)
    if len(data) < HEADER.size:
        raise ValueError(f"{path} is too short for a matrix")
    rows, columns, _ = HEADER.unpack(data)
    if rows < 0 or columns < 0:
        raise ValueError(f"{path} has a negative size")
    return rows, columns


def read_degrees(path: str, rows: int) -> np.ndarray:
    with opened(degree_path(path)) as f:
        data = f.read(4 * rows + 1)
    if len(data) != 4 * rows:
        raise ValueError(f"the degrees of {path} don't fit its {rows} rows")
    found = np.frombuffer(data, "<i4").astype(np.int64)
    if (found < 0).any():
        raise ValueError(f"{path} has negative degrees")
    return found


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.rows, self.columns = read_header(self.path)
        self.entries = int(read_degrees(self.path, self.rows).sum())
        self.gz = is_gzip(self.path)
        if not self.gz and size(self.path) != HEADER.size + RECORD.itemsize * self.entries:
            raise ValueError(f"{self.path} doesn't hold the {self.entries} entries that its degrees count")

    def partitions(self) -> list[_Range]:
        step = max(1, self.entries if self.gz else self.split)
        return [_Range(a, min(step, self.entries - a)) for a in range(0, self.entries, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        if self.gz:
            f = opened(self.path)
            f.read(HEADER.size)
        else:
            fs, path = filesystem(self.path)
            f = fs.open_input_file(path)
            f.seek(HEADER.size + RECORD.itemsize * partition.first)
        with f:
            at, left = partition.first, partition.count
            while left:
                n = min(BATCH, left)
                data = f.read(n * RECORD.itemsize)
                if len(data) < n * RECORD.itemsize:
                    raise ValueError(f"{self.path} ends before entry {at + len(data) // RECORD.itemsize}")
                e = np.frombuffer(data, RECORD)
                bad = np.flatnonzero((e["i"] >= self.rows) | (e["j"] >= self.columns))
                if len(bad):
                    raise ValueError(f"{self.path}: entry {at + bad[0]} is outside of the {self.rows} x {self.columns} matrix")
                yield pa.RecordBatch.from_arrays([pa.array(e["i"].astype(np.int64)), pa.array(e["j"].astype(np.int64)), pa.array(e["v"].copy())], ["src", "dst", "w"])
                at, left = at + n, left - n
            if self.gz and f.read(1):
                raise ValueError(f"{self.path} holds more than the {self.entries} entries that its degrees count")


class BsmatDataSource(DataSource):
    """spark.read.format("bsmat").load(path): (src, dst, w); option split: entries of a partition."""

    @classmethod
    def name(cls) -> str:
        return "bsmat"

    def schema(self) -> str:
        return "src long, dst long, w double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_bsmat(spark: SparkSession, path: str, split: int = SPLIT) -> Graph:
    """The graph of a square matrix; all its rows are nodes."""
    rows, columns = read_header(path)
    if rows != columns:
        raise ValueError(f"{path} is not square: {rows} x {columns}")
    ship(spark)
    spark.dataSource.register(BsmatDataSource)
    return Graph(spark.range(rows), spark.read.format("bsmat").option("split", split).load(path))


def read_bsmat_entries(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The entries of any matrix, square or not."""
    ship(spark)
    spark.dataSource.register(BsmatDataSource)
    return spark.read.format("bsmat").option("split", split).load(path)


def write_bsmat(g: Graph, path: str) -> None:
    """Write a graph with ids 0..n-1, entries by row and column.

    One file takes one writer: rows are sorted by Spark and streamed through in order of partitions.
    """
    n = g.nodes.count()
    low = g.nodes.agg(F.min("id"), F.max("id")).first()
    if n and (low[0] != 0 or low[1] != n - 1):
        raise ValueError("ids must be 0 to n-1")
    entries = g.edges.count()
    fs, name = filesystem(path)
    with fs.open_output_stream(f"{name}.tmp", compression=None) as f:
        f.write(HEADER.pack(n, n, entries))
        for r in g.edges.repartitionByRange("src").sortWithinPartitions("src", "dst", "w").toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack("<IId", r.src, r.dst, r.w))
    fs.move(f"{name}.tmp", name)
    with fs.open_output_stream(f"{name}.degs", compression=None) as f:
        for r in degrees(g).orderBy("id").toLocalIterator():
            f.write(struct.pack("<i", r.degree))


__all__ = ["BsmatDataSource", "read_bsmat", "read_bsmat_entries", "read_degrees", "read_header", "write_bsmat"]
