"""Data-quality checks. Each returns (frame_id, check, violations) with one row per frame.

`check_all` runs them in the job that builds and stores the grid, plus one pass over the stored cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessgrid.functions import spatial
from tessgrid.functions.wire import roundtrip_error
from tessgrid.operators.grid import adaptive_grid, assign_points
from tessgrid.params import DRIVER_RANGE, HAZARD_IDS, GridParams

_NOISE = 1e-9


def _count(rows: DataFrame, check: str, broken: Column) -> DataFrame:
    """Rows per frame on which `broken` holds; partially aggregated, so a hot frame costs nothing extra."""
    return rows.groupBy("frame_id").agg(F.count_if(broken).alias("violations")).select(
        "frame_id", F.lit(check).alias("check"), "violations"
    )


def check_conservation(points: DataFrame, cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Cropped points that no cell accounts for, or the reverse."""
    inside = points.where(spatial.in_root(F.col("x"), F.col("y"), params))
    put = inside.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    got = cells.groupBy("frame_id").agg(F.sum("n_points").alias("m"))
    gap = F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))
    return put.join(got, "frame_id", "full").select(
        "frame_id", F.lit("conservation").alias("check"), gap.alias("violations")
    )


def check_containment(
    assigned: DataFrame, params: GridParams = GridParams(), tolerance: float = 1e-4
) -> DataFrame:
    """Points outside the square of the cell they were assigned to (`assign_points`)."""
    x, y = spatial.cell_centre(F.col("node"), F.col("level"), params)
    half = spatial.cell_size(F.col("level"), params) / 2.0 + F.lit(tolerance)
    out = (F.abs(F.col("x") - x) > half) | (F.abs(F.col("y") - y) > half)
    return _count(assigned, "containment", out)


def check_lattice(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Centres off the half-cell lattice of their level, or outside the root square."""
    return _count(cells, "lattice", _off_lattice(params))


def _off_lattice(params: GridParams) -> Column:
    size = spatial.cell_size(F.col("level"), params)

    def off(v: str) -> Column:
        step = (F.col(v) + F.lit(params.half_m)) / size - F.lit(0.5)
        return (F.abs(step - F.rint(step)) > 1e-6) | (F.abs(F.col(v)) >= params.half_m)

    return off("x") | off("y")


def check_sizes(cells: DataFrame, params: GridParams = GridParams(), far_m: float = 90.0) -> DataFrame:
    """Cells finer than the finest, deeper than the tree, coarse in the fovea or too coarse far out."""
    return _count(cells, "sizes", _bad_size(params, far_m))


def _bad_size(params: GridParams, far_m: float = 90.0) -> Column:
    size = spatial.cell_size(F.col("level"), params)
    r = spatial.polar_range(F.col("x"), F.col("y"))
    return (
        (size < params.min_cell_m - _NOISE)
        | (F.col("level") > params.max_depth)
        | ((r < params.fovea_radius_m) & (size > params.min_cell_m + _NOISE))
        | ((r > far_m) & (size > params.coarse_size_m + _NOISE))
    )


def check_elevation(cells: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Mean elevation outside the lowest and highest of the cell."""
    return _count(cells, "elevation", _steep(tolerance))


def _steep(tolerance: float = 1e-5) -> Column:
    low = F.col("z_min") > F.col("z") + F.lit(tolerance)
    high = F.col("z") > F.col("z_max") + F.lit(tolerance)
    return low | high


def check_range_only(cells: DataFrame) -> DataFrame:
    """Cells of a range-only build whose size some risk rule set."""
    return _count(cells, "range_only", F.col("driver") != DRIVER_RANGE)


def check_roundtrip(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Cells that quantising moves, or whose elevation or confidence it changes too much."""
    return _count(roundtrip_error(cells, params), "roundtrip", _moved())


def _moved() -> Column:
    return (
        (F.col("x_error") > 1e-6)
        | (F.col("y_error") > 1e-6)
        | (F.col("z_error") > 0.005 + _NOISE)
        | (F.col("conf_error") > 1.0 / 255.0)
    )


def check_points(points: DataFrame) -> DataFrame:
    """Points with a confidence outside 0..1 or a coordinate that is not finite, points without an index
    (which no grid holds), plus one for a frame that mixes sources. Points without a frame are counted
    under frame null."""
    sums = points.groupBy("frame_id").agg(
        F.count_if(_bad_point()).alias("bad"),
        (F.min(F.xxhash64("source")) != F.max(F.xxhash64("source"))).cast("long").alias("mixed"),
    )
    return sums.select(
        "frame_id",
        F.lit("points").alias("check"),
        (F.col("bad") + F.coalesce("mixed", F.lit(0))).alias("violations"),
    )


def _bad_point() -> Column:
    bad_conf = ~F.coalesce(F.col("conf").between(0.0, 1.0), F.lit(False))
    # NaN and infinities are the values whose difference from themselves is not zero
    bad_place = ~F.coalesce((F.col("x") - F.col("x") + F.col("y") - F.col("y") + F.col("z") - F.col("z")) == 0.0, F.lit(False))
    return bad_conf | bad_place | F.col("point_idx").isNull()


def check_tail(headers: DataFrame, decoded: DataFrame) -> DataFrame:
    """Frames whose tail disagrees with the cells decoded from them: cell count, finest or coarsest size.
    The tail is JSON with n_cells, cell_size_min_m and cell_size_max_m."""
    told = headers.select(
        "frame_id", F.from_json("tail", "n_cells LONG, cell_size_min_m DOUBLE, cell_size_max_m DOUBLE").alias("t")
    ).select("frame_id", "t.*")
    seen = decoded.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("size_m").alias("low"), F.max("size_m").alias("high")
    )
    apart = (
        (F.col("n_cells") != F.col("n"))
        | (F.abs(F.col("cell_size_min_m") - F.col("low")) > 1e-6)
        | (F.abs(F.col("cell_size_max_m") - F.col("high")) > 1e-6)
    )
    return told.join(seen, "frame_id", "left").select(
        "frame_id",
        F.lit("tail").alias("check"),
        F.coalesce(apart, F.lit(True)).cast("long").alias("violations"),
    )


def check_sparse(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Empty cells, plus one for a frame that is not far below the dense grid."""
    sums = cells.groupBy("frame_id").agg(
        F.count_if(F.coalesce(F.col("n_points"), F.lit(0)) <= 0).alias("empty"),
        F.count(F.lit(1)).alias("n"),
    )
    dense = (F.col("n") * 100 >= params.dense_cells).cast("long")
    return sums.select(
        "frame_id", F.lit("sparse").alias("check"), (F.col("empty") + dense).alias("violations")
    )


def check_hazard_depth(cells: DataFrame, hazard: int = HAZARD_IDS[0], road: int = 1) -> DataFrame:
    """One for a frame whose hazard surface does not lie below its road surface; zero without both."""
    sums = cells.groupBy("frame_id").agg(
        F.avg(F.when(F.col("cls") == hazard, F.col("z"))).alias("hazard_z"),
        F.avg(F.when(F.col("cls") == road, F.col("z"))).alias("road_z"),
    )
    return sums.select(
        "frame_id",
        F.lit("hazard_depth").alias("check"),
        F.coalesce(F.col("hazard_z") >= F.col("road_z"), F.lit(False)).cast("long").alias("violations"),
    )


def cell_checks(cells: DataFrame, params: GridParams = GridParams(), range_only: bool = False) -> DataFrame:
    """The checks that need cells alone (lattice, sizes, elevation, roundtrip, sparse, hazard_depth and, for a
    `range_only` build, range_only) in one pass: the union of the single checks."""
    road, hazard = 1, HAZARD_IDS[0]
    counted = {
        "lattice": _off_lattice(params),
        "sizes": _bad_size(params),
        "elevation": _steep(),
        "roundtrip": _moved(),
    } | ({"range_only": F.col("driver") != DRIVER_RANGE} if range_only else {})
    sums = roundtrip_error(cells, params).groupBy("frame_id").agg(
        *[F.count_if(broken).alias(name) for name, broken in counted.items()],
        F.count_if(F.coalesce(F.col("n_points"), F.lit(0)) <= 0).alias("empty"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("cls") == hazard, F.col("z"))).alias("hazard_z"),
        F.avg(F.when(F.col("cls") == road, F.col("z"))).alias("road_z"),
    )
    told = {name: F.col(name) for name in counted} | {
        "sparse": F.col("empty") + (F.col("n") * 100 >= params.dense_cells).cast("long"),
        "hazard_depth": F.coalesce(F.col("hazard_z") >= F.col("road_z"), F.lit(False)).cast("long"),
    }
    rows = [F.struct(F.lit(name).alias("check"), n.cast("long").alias("violations")) for name, n in told.items()]
    return sums.select("frame_id", F.explode(F.array(*rows)).alias("c")).select("frame_id", "c.*")


@dataclass
class Checked:
    """What `check_all` found: a row per frame and check, and the totals of the one pass over the points."""

    violations: DataFrame
    totals: dict[str, int]


def _weight() -> Column:
    """Random weight of a frame below 2**40: sums of points by weight agree if they do frame by frame."""
    return F.shiftrightunsigned(F.xxhash64("frame_id"), 24).cast("decimal(20,0)")


def _outside_finest(params: GridParams, tolerance: float = 1e-4) -> Column:
    def off(v: str) -> Column:
        centre = (spatial.grid_index(F.col(v), params) + F.lit(0.5)) * params.min_cell_m - F.lit(params.half_m)
        return F.abs(F.col(v) - centre) > params.min_cell_m / 2 + tolerance

    return off("x") | off("y")


def check_all(points: DataFrame, path: str, params: GridParams = GridParams()) -> Checked:
    """Build the grid of `points`, store its cells under `path` and check both.

    The points are read once: what the checks need of them (bad points, points outside their finest cell,
    sources, points inside the root square by frame) is observed on the way into the grid, and the cells'
    side on their way out. One pass over the stored cells gives the rows of `cell_checks`. Only if a total of
    the points is off are they read again, to tell the frames; and where points lie outside the root square
    their frame_id is, as a frame may have no other. Rows are those of the single checks: conservation,
    containment, points and the checks of cells; what is packed has `check_tail`.
    """
    spark, x, y = points.sparkSession, F.col("x"), F.col("y")
    inside = spatial.in_root(x, y, params) & F.col("frame_id").isNotNull() & F.col("point_idx").isNotNull()
    # A leaf holds the finest cells of its points, so only points outside theirs can lie outside their leaf.
    out = inside & _outside_finest(params)
    source = F.xxhash64("source")
    seen, built = Observation("points"), Observation("cells")
    observed = points.observe(
        seen,
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(_bad_point()).alias("bad"),
        F.count_if(out).alias("outside"),
        F.count_if(inside).alias("inside"),
        F.count_if(F.col("point_idx").isNull() | F.col("frame_id").isNull()).alias("without_key"),
        (F.min(source) != F.max(source)).cast("long").alias("sources_differ"),
        F.sum(F.when(inside, _weight())).alias("weight"),
    )
    cells = adaptive_grid(observed, params).observe(
        built, F.count(F.lit(1)).alias("n_cells"), F.sum(_weight() * F.col("n_points")).alias("weight")
    )
    cells.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(cells.schema).parquet(path)
    try:
        got, made = seen.get, built.get
    except Py4JJavaError:
        # Of a table that is known to be empty Spark plans nothing, and so observes nothing.
        if not stored.isEmpty() or not points.isEmpty():
            raise
        names = ("n_points", "bad", "outside", "inside", "without_key", "sources_differ")
        got, made = dict.fromkeys((*names, "weight")), {"n_cells": 0, "weight": None}
    totals = {k: int(v or 0) for k, v in got.items() if k != "weight"} | {
        "n_cells": made["n_cells"], "unaccounted": int((got["weight"] or 0) != (made["weight"] or 0)),
    }
    found = cell_checks(stored, params, not params.risk_adaptive)
    if any(totals[k] for k in ("bad", "outside", "without_key", "sources_differ", "unaccounted")):
        rest = [check_points(points), check_conservation(points, stored, params)]
        rest.append(check_containment(assign_points(points, params), params))
    else:
        frames = stored.select("frame_id").distinct()
        all_frames = frames if totals["inside"] == totals["n_points"] else points.select("frame_id").distinct()
        none = F.lit(0).cast("long").alias("violations")
        rest = [
            some.select("frame_id", F.lit(name).alias("check"), none)
            for name, some in (("points", all_frames), ("conservation", frames), ("containment", frames))
        ]
    for rows in rest:
        found = found.unionByName(rows)
    return Checked(found, totals)
