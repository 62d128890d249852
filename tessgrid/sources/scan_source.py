"""Raw scans as a data source: files are cut into byte ranges, so one large scan is read by several tasks.

    register_scans(spark)
    spark.read.format("tessgrid-scans").load("/drives").where("number BETWEEN 100 AND 199")

Columns: path, point_idx, x, y, z, intensity, and number, the digits that end the file name. Comparisons of
`path` and `number` with constants choose files while they are listed; the others' bytes are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

NAME = "tessgrid-scans"
COLUMNS = "path string, point_idx long, x double, y double, z double, intensity double, number long"
#: Points a task reads, about, and points of a batch.
SPLIT_POINTS, BATCH_POINTS = 1 << 22, 1 << 17
_POINT = np.dtype([(c, "<f4") for c in ("x", "y", "z", "intensity")])
_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}


@dataclass
class ByteRange(InputPartition):
    """`points` points of a file from point `first` on."""

    path: str
    inner: str
    first: int
    points: int


def number_of(path: str) -> int | None:
    """Digits that end the file name, if there are any and 18 at most."""
    found = re.search(r"(\d{1,18})\.bin$", path)
    return int(found.group(1)) if found else None


def _open(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what to put before such paths so that they read as Spark writes them."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


class ScanReader(DataSourceReader):
    def __init__(self, path: str, split_points: int):
        self.path, self.split_points, self.tests = path, split_points, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what a file name can answer; Spark applies the rest."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and column in ("path", "number"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _chosen(self, path: str) -> bool:
        told = {"path": path, "number": number_of(path)}
        return all(told[c] is not None and _TESTS[kind](told[c], value) for c, kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        system, inner, prefix = _open(self.path)
        listed = system.get_file_info(fs.FileSelector(inner, recursive=True))
        found = []
        for info in sorted(listed, key=lambda i: i.path):
            path = prefix + info.path
            if info.type != fs.FileType.File or not info.path.endswith(".bin") or not self._chosen(path):
                continue
            if info.size % _POINT.itemsize:
                raise ValueError(f"{path}: size is not a whole number of points")
            n = info.size // _POINT.itemsize
            for first in range(0, n, self.split_points):
                found.append(ByteRange(path, info.path, first, min(self.split_points, n - first)))
        # Without any, Spark would call read() with none.
        return found or [ByteRange("", "", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.points:
            return
        system = _open(self.path)[0]
        number = number_of(partition.path)
        with system.open_input_file(partition.inner) as file:
            file.seek(partition.first * _POINT.itemsize)
            for at in range(partition.first, partition.first + partition.points, BATCH_POINTS):
                n = min(BATCH_POINTS, partition.first + partition.points - at)
                data = file.read(n * _POINT.itemsize)
                if len(data) != n * _POINT.itemsize:
                    raise ValueError(f"{partition.path}: shorter than when it was listed")
                scan = np.frombuffer(data, _POINT)
                columns = [pa.array([partition.path] * n, pa.string()), pa.array(np.arange(at, at + n))]
                columns += [pa.array(scan[c].astype("f8")) for c in _POINT.names]
                columns.append(pa.array([number] * n, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["path", "point_idx", *_POINT.names, "number"])


class ScanSource(DataSource):
    """`split_points` is the number of points a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScanReader(self.options["path"], int(self.options.get("split_points", SPLIT_POINTS)))


def register_scans(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)


def scan_points(spark: SparkSession, path: str, split_points: int = SPLIT_POINTS) -> DataFrame:
    """Points of all `*.bin` files under `path`, with frame ids from the paths (`scans.path_id`)."""
    from tessgrid.sources.scans import path_id

    register_scans(spark)
    points = spark.read.format(NAME).option("split_points", split_points).load(path)
    return points.withColumn("frame_id", path_id(points["path"]))
