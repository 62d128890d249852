"""Small dimension tables: classes, categories, drivers, levels.

Each is a fixed list of a few rows (the class list has 15, the level list max_depth + 1), so joining
one by broadcast is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessgrid.functions.spatial import target_size
from tessgrid.params import CATEGORIES, CLASSES, DRIVERS, GridParams


def class_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), "cls INT, name STRING, class_group STRING, hazard BOOLEAN")


def category_bridge(spark: SparkSession) -> DataFrame:
    rows = [(name, list(ids)) for name, ids in CATEGORIES]
    listed = spark.createDataFrame(rows, "category STRING, ids ARRAY<INT>")
    return listed.select("category", F.explode("ids").alias("cls"))


def driver_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DRIVERS), "driver INT, name STRING")


def level_table(spark: SparkSession, params: GridParams = GridParams()) -> DataFrame:
    """Level, cell size and the whole-metre band whose target first asks for that level."""
    sizes = [
        (level, params.cell_size(level))
        for level in range(params.max_depth + 1)
        if params.min_cell_m <= params.cell_size(level) <= 4 * params.coarse_size_m
    ]
    levels = spark.createDataFrame(sizes, "level INT, size_m DOUBLE")
    every = F.lit(params.root_size_m) / F.pow(F.lit(2.0), F.col("depth"))
    # Finest level whose cell is no larger than the target, without the tolerance the grid build uses.
    metres = (
        spark.range(int(params.max_range_m) + 1)
        .select(F.col("id").alias("metre"), target_size(F.col("id").cast("double"), params).alias("target"))
        .select("metre", "target", F.explode(F.sequence(F.lit(0), F.lit(params.max_depth))).alias("depth"))
        .where((every <= F.col("target")) | (F.col("depth") == params.max_depth))
        .groupBy("metre")
        .agg(F.min("depth").alias("level"))
    )
    bands = metres.groupBy("level").agg(
        F.min("metre").alias("range_from_m"), F.max("metre").alias("range_to_m")
    )
    return levels.join(bands, "level", "left").select(
        "level", F.bround("size_m", 4).alias("size_m"), "range_from_m", "range_to_m"
    )
