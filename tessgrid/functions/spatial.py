"""Geometry as column expressions: cropping, Morton codes, the range schedule, sectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessgrid.params import GridParams


def in_root(x: Column, y: Column, params: GridParams) -> Column:
    """Strictly inside the root square. NaN sorts above every number, so NaN coordinates drop out."""
    return (F.abs(x) < params.half_m) & (F.abs(y) < params.half_m)


def grid_index(v: Column, params: GridParams) -> Column:
    """Index of the finest cell a coordinate falls in, clipped to the root square."""
    raw = F.floor((v + F.lit(params.half_m)) / F.lit(params.min_cell_m)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(params.grid_width - 1).cast("long"), raw))


def _spread_byte(b: int) -> int:
    return sum((b >> i & 1) << 2 * i for i in range(8))


def _even_bits(b: int) -> int:
    return sum((b >> 2 * i & 1) << i for i in range(4))


# Byte-wise lookups keep the generated code small; bit-by-bit expressions outgrow what the JVM compiles.
# As text a table is one call to the JVM, which folds it into one literal.
_SPREAD = f"array({', '.join(f'{_spread_byte(b)}L' for b in range(256))})"
_EVEN = f"array({', '.join(f'{_even_bits(b)}L' for b in range(256))})"


def _byte(v: Column, i: int) -> Column:
    return F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("long")).cast("int")


def _bytewise(v: Column, table: str, n_bytes: int, out_bits: int) -> Column:
    lookup = F.expr(table)
    zero = F.lit(0).cast("long")
    parts = [
        F.shiftleft(F.coalesce(F.get(lookup, _byte(v, i)), zero), out_bits * i) for i in range(n_bytes)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def morton_encode(ix: Column, iy: Column, depth: int) -> Column:
    """Interleave two indices bit by bit; x takes the higher bit of every pair."""
    n_bytes = (depth + 7) // 8
    high, low = (_bytewise(v, _SPREAD, n_bytes, 16) for v in (ix, iy))
    return F.shiftleft(high, 1).bitwiseOR(low)


def morton_decode(code: Column, depth: int) -> tuple[Column, Column]:
    """The two indices behind a code, or behind a prefix of one."""
    n_bytes = (2 * depth + 7) // 8
    return (
        _bytewise(F.shiftright(code, 1), _EVEN, n_bytes, 4),
        _bytewise(code, _EVEN, n_bytes, 4),
    )


def prefix(code: Column, level: int, params: GridParams) -> Column:
    """Node of a fixed level that contains a finest-cell code."""
    return F.shiftright(code, 2 * (params.max_depth - level))


def prefix_at(code: Column, level: Column, params: GridParams) -> Column:
    """Same with the level as an INT column."""
    return F.call_function("shiftright", code, F.lit(2) * (F.lit(params.max_depth) - level))


def cell_size(level: Column, params: GridParams) -> Column:
    return F.lit(params.root_size_m) / F.pow(F.lit(2.0), level.cast("double"))


def cell_centre(node: Column, level: Column, params: GridParams) -> tuple[Column, Column]:
    ix, iy = morton_decode(node, params.max_depth)
    size = cell_size(level, params)
    origin = F.lit(-params.half_m)
    return origin + (ix + F.lit(0.5)) * size, origin + (iy + F.lit(0.5)) * size


def polar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def target_size(range_m: Column, params: GridParams) -> Column:
    """Cell size a range asks for: flat inside the fovea, then linear and not clamped."""
    fovea = F.lit(params.fovea_radius_m)
    share = (range_m - fovea) / F.lit(params.max_range_m - params.fovea_radius_m)
    beyond = F.lit(params.min_cell_m) + share * F.lit(params.coarse_size_m - params.min_cell_m)
    return F.when(range_m <= fovea, F.lit(params.min_cell_m)).otherwise(beyond)


def level_for(target: Column, params: GridParams) -> Column:
    floored = F.greatest(target, F.lit(params.min_cell_m))
    level = F.ceil(F.log2(F.lit(params.root_size_m) / floored) - F.lit(1e-9)).cast("int")
    return F.least(F.greatest(level, F.lit(0)), F.lit(params.max_depth))


def azimuth_deg(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def azimuth_distance(azimuth: Column, centre: Column) -> Column:
    """Unsigned angle between two directions, wrapped to 0..180 degrees."""
    return F.abs(F.pmod(azimuth - centre + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def in_sector(x: Column, y: Column, centre: Column, half_width: Column) -> Column:
    return azimuth_distance(azimuth_deg(x, y), centre) < half_width
