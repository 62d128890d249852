"""Per-frame statistics of a grid: counts, risk figures, memory against dense baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.dims import class_dim, driver_dim
from tessgrid.functions import risk, spatial
from tessgrid.params import DRIVER_RANGE, GridParams

FRAME = ("frame_id",)


def far_hazard(params: GridParams) -> Column:
    """Hazard cell whose centre lies beyond the fovea."""
    beyond = spatial.polar_range(F.col("x"), F.col("y")) > params.fovea_radius_m
    return risk.is_hazard(F.col("cls"), params) & beyond


def named(df: DataFrame, dim: DataFrame, key: str, out: str) -> DataFrame:
    """Left join to a dimension of a few fixed rows; an unknown id keeps its number as its name."""
    names = F.broadcast(dim.select(key, F.col("name").alias("__name")))
    return df.join(names, key, "left").withColumn(
        out, F.coalesce("__name", F.col(key).cast("string"))
    ).drop("__name")


def cells_by(cells: DataFrame, key: str, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Cells per value of `key` in each frame, long form."""
    return cells.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("n_cells"))


def cells_by_class(cells: DataFrame) -> DataFrame:
    counts = cells_by(cells, "cls")
    return named(counts, class_dim(cells.sparkSession), "cls", "name")


def cells_by_driver(cells: DataFrame) -> DataFrame:
    counts = cells_by(cells, "driver")
    return named(counts, driver_dim(cells.sparkSession), "driver", "name")


def legend(cells: DataFrame, key: str) -> DataFrame:
    """Distinct values of `key` per frame with a 0-based rank. The window runs over the counts, at most
    one row per level or class id and frame."""
    ordered = Window.partitionBy("frame_id").orderBy(key)
    return cells_by(cells, key).withColumn("rank", (F.dense_rank().over(ordered) - 1).cast("long"))


def memory_columns(params: GridParams, n_cells: Column, n_points: Column) -> dict[str, Column]:
    """Bytes of this map, a dense 5 cm map, 5 cm voxels and the raw cloud; ratios are null for no cells."""
    adaptive = n_cells * F.lit(params.bytes_per_cell).cast("long")
    dense = F.lit(params.dense_cells * params.bytes_per_cell).cast("long")
    voxels = F.lit(params.dense_voxels).cast("long")
    cloud = n_points * F.lit(params.bytes_per_point).cast("long")

    def ratio(of: Column, digits: int) -> Column:
        return F.bround(F.try_divide(of.cast("double"), adaptive.cast("double")), digits)

    return {
        "adaptive_bytes": adaptive,
        "dense_uniform_bytes": dense,
        "dense_uniform_cells": F.lit(params.dense_cells).cast("long"),
        "dense_3d_voxel_bytes": voxels,
        "dense_3d_voxels": voxels,
        "reduction_vs_dense_3d": ratio(voxels, 1),
        "raw_cloud_bytes": cloud,
        "reduction_vs_dense": ratio(dense, 1),
        "reduction_vs_cloud": ratio(cloud, 2),
        "bytes_per_cell": F.lit(params.bytes_per_cell),
    }


def _tally_map(keys: str, out_key) -> Column:
    """Sum the per-combination counts of one key into a map. Combinations are few per frame."""
    pairs = F.col("combos")
    found = F.array_sort(F.array_distinct(F.transform(pairs, lambda c: c[keys])))
    return F.map_from_entries(
        F.transform(
            found,
            lambda k: F.struct(
                out_key(k).alias("key"),
                F.aggregate(
                    F.filter(pairs, lambda c: c[keys] == k),
                    F.lit(0).cast("long"),
                    lambda acc, c: acc + c["n"],
                ).alias("value"),
            ),
        )
    )


def _name_of(rows: list[tuple[int, str]]):
    names = F.create_map(*[part for i, name in rows for part in (F.lit(i), F.lit(name))])
    return lambda k: F.coalesce(F.try_element_at(names, k), k.cast("string"))


LEVEL_COUNT = "__at_level_"


def level_counts(which: Column, params: GridParams) -> list[Column]:
    """Aggregates that count rows per level; what `median_size` reads."""
    return [
        F.count_if(which & (F.col("level") == n)).alias(f"{LEVEL_COUNT}{n}") for n in range(params.max_depth + 1)
    ]


def median_size(params: GridParams) -> Column:
    """Median cell size from counts per level, null without rows. A cell has one of few sizes, so the
    middle is found by running counts from the finest up, with no list of values. Array functions keep the
    generated code small."""
    levels = range(params.max_depth, -1, -1)
    counts = F.array(*[F.col(f"{LEVEL_COUNT}{n}") for n in levels])
    sizes = F.expr(f"array({', '.join(repr(params.cell_size(n)) + 'D' for n in levels)})")
    running = F.aggregate(
        counts,
        F.array().cast("array<bigint>"),
        lambda sums, n: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + n),
    )
    total = F.element_at(running, -1)

    def at(place: Column) -> Column:
        return F.get(sizes, F.size(F.filter(running, lambda n: n <= place)))

    return F.when(total > 0, (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2)


def summarise(cells: DataFrame, params: GridParams, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Scalar figures per group, before rounding and naming. Additive, so partially aggregated before
    the shuffle."""
    size = spatial.cell_size(F.col("level"), params)
    hazard, far = risk.is_hazard(F.col("cls"), params), far_hazard(params)
    return cells.groupBy(*keys).agg(
        F.sum("n_points").alias("n_points"),
        F.count(F.lit(1)).alias("n_cells"),
        F.min(size).alias("cell_size_min_m"),
        F.max(size).alias("cell_size_max_m"),
        F.count_if(F.col("driver") != DRIVER_RANGE).alias("risk_driven_cells"),
        F.count_if(hazard).alias("hazard_cells"),
        F.count_if(far).alias("hazard_cells_beyond_fovea"),
        F.count_if(F.col("conf") < params.conf_threshold).alias("degraded_cells"),
        F.min("z").alias("z_low"),
        F.max("z").alias("z_high"),
    )


def frame_stats(
    cells: DataFrame, params: GridParams = GridParams(), frames: DataFrame | None = None
) -> DataFrame:
    """One row per frame with every figure, count maps, and the memory comparison.

    Frames listed in `frames` (a `frame_id` column) but absent from `cells` report zero counts, empty
    maps and null sizes, ranges and ratios.
    """
    from tessgrid.params import CLASSES, DRIVERS

    size = spatial.cell_size(F.col("level"), params)
    # At most levels x drivers x class ids rows per frame, whatever the frame holds.
    combos = cells.groupBy("frame_id", "level", "driver", "cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_points").alias("points"),
        F.count_if(far_hazard(params)).alias("far"),
        F.count_if(F.col("conf") < params.conf_threshold).alias("degraded"),
        F.min("z").alias("z_low"),
        F.max("z").alias("z_high"),
    )
    hazard = risk.is_hazard(F.col("cls"), params)
    per_frame = combos.groupBy("frame_id").agg(
        F.sum("points").alias("n_points"),
        F.sum("n").alias("n_cells"),
        F.min(size).alias("size_min"),
        F.max(size).alias("size_max"),
        F.sum(F.when(F.col("driver") != DRIVER_RANGE, F.col("n")).otherwise(0)).alias("risk_driven"),
        F.sum(F.when(hazard, F.col("n")).otherwise(0)).alias("hazards"),
        F.sum("far").alias("far"),
        F.sum("degraded").alias("degraded"),
        F.min("z_low").alias("z_low"),
        F.max("z_high").alias("z_high"),
        F.collect_list(F.struct("level", "driver", "cls", "n")).alias("combos"),
    )
    if frames is not None:
        per_frame = frames.select("frame_id").distinct().join(per_frame, "frame_id", "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    empty = F.array().cast("array<struct<level:int,driver:int,cls:int,n:bigint>>")
    memory = memory_columns(params, F.col("n_cells"), F.col("n_points"))
    return (
        per_frame.withColumn("combos", F.coalesce("combos", empty))
        .withColumn("n_points", count("n_points"))
        .withColumn("n_cells", count("n_cells"))
        .select(
            "frame_id",
            "n_points",
            "n_cells",
            F.bround("size_min", 4).alias("cell_size_min_m"),
            F.bround("size_max", 4).alias("cell_size_max_m"),
            _tally_map("level", lambda k: k).alias("cells_by_level"),
            _tally_map("driver", _name_of(list(DRIVERS))).alias("cells_by_driver"),
            _tally_map("cls", _name_of([c[:2] for c in CLASSES])).alias("cells_by_class"),
            count("risk_driven").alias("risk_driven_cells"),
            count("hazards").alias("hazard_cells"),
            count("far").alias("hazard_cells_beyond_fovea"),
            count("degraded").alias("degraded_cells"),
            F.when(
                F.col("z_low").isNotNull(), F.array(F.bround("z_low", 2), F.bround("z_high", 2))
            ).alias("elevation_range_m"),
            F.struct(*[c.alias(name) for name, c in memory.items()]).alias("memory"),
        )
    )


def memory_reduction(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    sums = cells.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_points").alias("n_points")
    )
    memory = memory_columns(params, F.col("n_cells"), F.col("n_points"))
    return sums.select(
        "frame_id", "n_cells", "n_points", *[c.alias(name) for name, c in memory.items()]
    )
