"""Views of a built grid: windows, histograms, hazard clusters."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.functions import risk, spatial
from tessgrid.operators.ordered import salted_join
from tessgrid.params import GridParams

ELEVATION_BINS = 24
CONFIDENCE_BINS = 16
#: Ranges of codes a window is written as at most; the closest ones are joined beyond it. Levels that only
#: coarsened cells have get one range each. More would outgrow what the JVM compiles.
MAX_RANGES = 10


def _touches(
    west: float, east: float, south: float, north: float, params: GridParams
) -> Column:
    # Each coordinate is named once: as a predicate moves below the projection that computes it, every
    # mention becomes a copy of that computation.
    half = spatial.cell_size(F.col("level"), params) / 2.0
    near_x = F.abs(F.col("x") - F.lit((west + east) / 2)) <= F.lit((east - west) / 2) + half
    near_y = F.abs(F.col("y") - F.lit((south + north) / 2)) <= F.lit((north - south) / 2) + half
    return near_x & near_y


def _nodes_at(low: float, high: float, level: int, params: GridParams) -> tuple[int, int]:
    """First and last node of a level, along one axis, whose closed span meets low..high."""
    size = params.cell_size(level)
    first = ceil((low + params.half_m) / size - 1e-6) - 1
    last = floor((high + params.half_m) / size + 1e-6)
    return max(first, 0), min(last, 2**level - 1)


def code_ranges(
    x_from: float, x_to: float, y_from: float, y_to: float, level: int,
    params: GridParams = GridParams(), most: int = MAX_RANGES,
) -> list[tuple[int, int]]:
    """Codes, as at most `most` inclusive ranges, of all finest cells in the nodes of `level` that meet the
    window. A cell of that level holds no other codes. Where ranges are joined, more codes are let in."""
    (x0, x1), (y0, y1) = _nodes_at(x_from, x_to, level, params), _nodes_at(y_from, y_to, level, params)
    if x0 > x1 or y0 > y1:
        return []
    found: list[list[int]] = []

    def descend(node: int, nx: int, ny: int, at: int) -> None:
        span = 1 << (level - at)
        left, low = nx * span, ny * span
        if left > x1 or low > y1 or left + span - 1 < x0 or low + span - 1 < y0:
            return
        inside = left >= x0 and low >= y0 and left + span - 1 <= x1 and low + span - 1 <= y1
        if inside or at == level:
            bits = 2 * (params.max_depth - at)
            first, last = node << bits, ((node + 1) << bits) - 1
            if found and found[-1][1] + 1 == first:
                found[-1][1] = last
            else:
                found.append([first, last])
            return
        for child in range(4):  # in order of code: x takes the higher bit
            descend(node * 4 + child, nx * 2 + (child >> 1), ny * 2 + (child & 1), at + 1)

    descend(0, 0, 0, 0)
    while len(found) > most:
        at = min(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])
        found[at - 1 : at + 1] = [[found[at - 1][0], found[at][1]]]
    return [(a, b) for a, b in found]


def in_window_codes(
    x_from: float, x_to: float, y_from: float, y_to: float, params: GridParams = GridParams(),
) -> Column:
    """Ranges of the stored column `code` that hold every cell meeting the window, per `level` down to the
    coarsest a built grid has. Parquet skips what lies outside if cells are stored by code (`write_cells`)."""
    window = (x_from, x_to, y_from, y_to)

    def one_of(level: int, most: int = 1) -> Column:
        ranges = [F.col("code").between(a, b) for a, b in code_ranges(*window, level, params, most)]
        return reduce(lambda a, b: a | b, ranges, F.lit(False))

    finest = params.coarsest_leaf
    built = (F.col("level") >= finest) & one_of(finest, MAX_RANGES)
    return reduce(lambda a, b: a | b, [(F.col("level") == level) & one_of(level) for level in range(finest)], built)


def viewport_cells(
    cells: DataFrame, x_from: float, x_to: float, y_from: float, y_to: float,
    params: GridParams = GridParams(),
) -> DataFrame:
    """Cells whose square meets the window. Stored cells are read by ranges of their code."""
    window = (x_from, x_to, y_from, y_to)
    return cells.where(in_window_codes(*window, params)).where(_touches(*window, params))


def viewport_lod(
    cells: DataFrame, x_from: float, x_to: float, y_from: float, y_to: float, pixels_per_m: float,
    min_pixels: float = 4.0, params: GridParams = GridParams(), budget: int | None = None,
) -> DataFrame:
    """Every cell of the window that is large enough on screen to outline; with `budget`, the first so many
    of each frame (`first_cells`)."""
    seen = viewport_cells(cells, x_from, x_to, y_from, y_to, params).where(
        spatial.cell_size(F.col("level"), params) * F.lit(pixels_per_m) >= F.lit(min_pixels)
    )
    return seen if budget is None else first_cells(seen, budget, params)


def first_cells(cells: DataFrame, budget: int, params: GridParams = GridParams()) -> DataFrame:
    """The first `budget` cells of each frame in the order they are packed: by code, then level.

    Cells are counted by tile. The running count of a frame's tiles (4**tile_level at most) tells the tile
    in which its budget ends; only that tile's cells are put in order. No frame is sorted.
    """
    if budget < 0:
        raise ValueError("budget must be 0 or more")
    tiled = cells.withColumn("__tile", spatial.prefix(F.col("code"), params.tile_level, params))
    counts = tiled.groupBy("frame_id", "__tile").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("frame_id").orderBy("__tile")
    upto = F.sum("__n").over(along)
    ends = (
        counts.withColumn("__upto", upto)
        .where((F.col("__upto") > budget) & (F.col("__upto") - F.col("__n") <= budget))
        .groupBy("frame_id")
        .agg(F.min(F.struct(F.col("__tile").alias("tile"), (F.lit(budget) - F.col("__upto") + F.col("__n")).alias("room"))).alias("__end"))
    )
    placed = salted_join(tiled, ends, ["frame_id"], F.col("code"))
    whole = placed.where(F.col("__end").isNull() | (F.col("__tile") < F.col("__end.tile")))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("code", "level"))
    last = placed.where(F.col("__tile") == F.col("__end.tile")).withColumn("__place", place)
    last = last.where(F.col("__place") <= F.col("__end.room")).drop("__place")
    return whole.unionByName(last).drop("__tile", "__end")


def _bin(share: Column, bins: int) -> Column:
    return F.least(F.floor(share * F.lit(float(bins))).cast("int"), F.lit(bins - 1))


def elevation_histogram(cells: DataFrame, bins: int = ELEVATION_BINS) -> DataFrame:
    """Cells per elevation bin, each frame scaled to its own range."""
    spans = cells.groupBy("frame_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    placed = salted_join(cells.select("frame_id", "code", "z"), spans, ["frame_id"], F.col("code"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(0.01))
    return (
        placed.withColumn("bin", _bin((F.col("z") - F.col("low")) / span, bins))
        .groupBy("frame_id", "bin")
        .agg(F.count(F.lit(1)).alias("n_cells"))
    )


def confidence_histogram(cells: DataFrame, bins: int = CONFIDENCE_BINS) -> DataFrame:
    return (
        cells.withColumn("bin", _bin(F.col("conf"), bins))
        .groupBy("frame_id", "bin")
        .agg(F.count(F.lit(1)).alias("n_cells"))
    )


def hazard_clusters(
    cells: DataFrame, bin_m: float = 3.0, params: GridParams = GridParams()
) -> DataFrame:
    """Hazard cells gathered into square bins: mean position, count and range of the mean."""

    def nearest(v: str) -> Column:
        return F.floor(F.col(v) / F.lit(bin_m) + F.lit(0.5)).cast("long")

    return (
        cells.where(risk.is_hazard(F.col("cls"), params))
        .groupBy("frame_id", nearest("x").alias("bin_x"), nearest("y").alias("bin_y"))
        .agg(
            F.avg("x").alias("x"),
            F.avg("y").alias("y"),
            F.count(F.lit(1)).alias("n_cells"),
        )
        .withColumn("range_m", spatial.polar_range(F.col("x"), F.col("y")))
    )
