"""Object-level records: position at a time, nearest objects, changes between frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.functions import spatial
from tessgrid.params import OBJECT_CLASSES, GridParams


def object_list(tracks: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Objects of each frame from `tracks` (frame_id, t, object_id, cls, x0, y0, vx, vy, radius, height):
    moving classes within range, with footprint, speed and a score that falls off with range."""
    placed = (
        tracks.where(F.col("cls").isin(*OBJECT_CLASSES))
        .withColumn("x", F.col("x0") + F.col("vx") * F.col("t"))
        .withColumn("y", F.col("y0") + F.col("vy") * F.col("t"))
        .withColumn("range_m", spatial.polar_range(F.col("x"), F.col("y")))
        .where(F.col("range_m") <= params.max_range_m)
    )
    falling = F.lit(0.95) - F.lit(0.006) * F.col("range_m")
    score = F.least(F.greatest(falling, F.lit(0.25)), F.lit(0.97))
    return placed.select(
        "frame_id",
        "object_id",
        F.bround("x", 2).alias("x"),
        F.bround("y", 2).alias("y"),
        F.bround("range_m", 2).alias("r"),
        "cls",
        F.bround(F.col("radius") * 2, 2).alias("w"),
        F.bround("height", 2).alias("h"),
        F.bround(spatial.polar_range(F.col("vx"), F.col("vy")), 2).alias("speed"),
        F.bround(score, 3).alias("score"),
    )


def by_range(objects: DataFrame) -> DataFrame:
    return objects.orderBy("frame_id", "r", "object_id")


def nearest_objects(objects: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of each frame. Spark applies the rank limit before the shuffle as well, so a task
    sends at most k rows per frame."""
    near = Window.partitionBy("frame_id").orderBy("r", "object_id")
    return objects.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def object_changes(objects: DataFrame, before: int, after: int) -> DataFrame:
    """(class, range) pairs seen in only one of two frames. One aggregation instead of two set
    differences over the same rows."""
    pair = objects.where(F.col("frame_id").isin(before, after)).groupBy("cls", "r")
    return (
        pair.agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
        .where(F.col("first") == F.col("last"))
        .select("cls", "r", F.when(F.col("first") == before, "gone").otherwise("new").alias("change"))
    )
