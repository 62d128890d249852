"""Raw scans: one `.bin` file per frame, little-endian float32 rows of x, y, z, intensity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4")])
_ROWS = "frame_id LONG, path STRING, point_idx LONG, x DOUBLE, y DOUBLE, z DOUBLE, intensity DOUBLE"
_ROWS_PER_BATCH = 262_144


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for frame_id, path, content in zip(batch["frame_id"], batch["path"], batch["content"]):
            if len(content) % _POINT.itemsize:
                raise ValueError(f"{path}: size is not a whole number of points")
            scan = np.frombuffer(content, dtype=_POINT)
            for start in range(0, len(scan), _ROWS_PER_BATCH):
                part = scan[start : start + _ROWS_PER_BATCH]
                rows = pd.DataFrame({name: part[name].astype("f8") for name in _POINT.names})
                rows.insert(0, "frame_id", frame_id)
                rows.insert(1, "path", path)
                rows.insert(2, "point_idx", np.arange(start, start + len(part)))
                yield rows


def parse_scans(files: DataFrame) -> DataFrame:
    """Points of `binaryFile` records that carry a frame_id, batch or streaming."""
    return files.select("frame_id", "path", "content").mapInPandas(_parse, _ROWS)


def path_id(path: Column) -> Column:
    """Frame id from the whole path, so equal names in two folders are two frames and any name will do.
    64 bits: a clash is expected among six billion files."""
    return F.xxhash64(path)


def frame_number(path: Column) -> Column:
    """Digits that end the file name, such as 123 of `drive/000123.bin`; null if there are none or too
    many. It orders the frames of one folder but does not identify a frame."""
    return F.try_to_number(
        F.nullif(F.regexp_extract(path, r"(\d{1,18})\.bin$", 1), F.lit("")), F.lit("999999999999999999")
    ).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. There is no other choice: executors
    do not see a temporary folder of the driver."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("numbering by sorted path needs spark.checkpoint.dir; or use numbering='path'")
    context.setCheckpointDir(named)


def path_ranks(paths: DataFrame) -> DataFrame:
    """(path, frame_id): the 0-based position of each path in sorted order.

    The sorted list is checkpointed, so the partition sizes that turn positions inside a partition into
    positions overall belong to the very rows being numbered. Those sizes are one row per partition.
    """
    ensure_checkpoint_dir(paths.sparkSession)
    in_partition = F.monotonically_increasing_id()
    listed = (
        paths.select("path")
        .distinct()
        .orderBy("path")
        .select("path", in_partition.alias("at"))
        .checkpoint()
        .select(
            "path",
            F.shiftright("at", 33).alias("part"),
            F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        )
    )
    sizes = listed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return listed.join(F.broadcast(offsets), "part").select(
        "path", (F.col("offset") + F.col("at")).alias("frame_id")
    )


def read_scans(spark: SparkSession, path: str, numbering: str = "rank") -> DataFrame:
    """Points of every `*.bin` file under `path`; an error if there is none.

    `numbering="rank"` numbers frames 0 up by sorted path; the numbers are joined to the files, one row
    each, before any is parsed. `numbering="path"` takes an id from the path and shuffles nothing.
    `number` holds the digits that end the file name.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no .bin scans under {path}")
    if numbering == "path":
        numbered = files.withColumn("frame_id", path_id(F.col("path")))
    elif numbering == "rank":
        numbered = files.select("path", "content").join(path_ranks(files), "path")
    else:
        raise ValueError(f"unknown numbering {numbering!r}")
    return parse_scans(numbered).select(
        "frame_id", "point_idx", "x", "y", "z", "intensity", "path", frame_number(F.col("path")).alias("number")
    )
