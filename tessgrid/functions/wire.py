"""Fixed-point cell columns and link arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessgrid.functions.spatial import cell_size
from tessgrid.params import GridParams


def _clip(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def quantised(params: GridParams) -> dict[str, Column]:
    """Centres in half-cell steps, elevation in centimetres, confidence in 1/255; halves round to even."""
    steps = F.lit(params.quant_m)
    return {
        "xq": F.rint(F.col("x") / steps).cast("short"),
        "yq": F.rint(F.col("y") / steps).cast("short"),
        "zq": _clip(F.rint(F.col("z") * F.lit(100.0)), -32768, 32767).cast("short"),
        "confq": _clip(F.rint(F.col("conf") * F.lit(255.0)), 0, 255).cast("short"),
    }


def restored(params: GridParams) -> dict[str, Column]:
    steps = F.lit(params.quant_m)
    return {
        "x": F.col("xq") * steps,
        "y": F.col("yq") * steps,
        "z": F.col("zq") / F.lit(100.0),
        "conf": F.col("confq") / F.lit(255.0),
    }


def quantise_cells(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    fixed = [c.alias(name) for name, c in quantised(params).items()]
    return cells.select("frame_id", "code", "level", "cls", "driver", *fixed)


def dequantise_cells(packed: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    return packed.select(
        "frame_id",
        "code",
        "level",
        "cls",
        "driver",
        *[c.alias(name) for name, c in restored(params).items()],
        cell_size(F.col("level"), params).alias("size_m"),
    )


def roundtrip_error(cells: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Cells with what packing and unpacking changes in x, y, z and confidence."""
    both = cells.withColumns(quantised(params))
    names = ("x", "y", "z", "conf")
    return both.withColumns(
        {f"{name}_error": F.abs(restored(params)[name] - F.col(name)) for name in names}
    )


def link_budget(frames: DataFrame, hz: Column | float, wire_bytes: str = "wire_bytes") -> DataFrame:
    """What frames of `wire_bytes` cost on a link at `hz` frames per second."""
    rate = hz if isinstance(hz, Column) else F.lit(float(hz))
    bps = F.col(wire_bytes).cast("double") * F.lit(8.0) * rate
    return frames.select(
        "*",
        F.bround(F.col(wire_bytes) / F.lit(1024.0), 1).alias("kb_per_frame"),
        F.bround(bps / F.lit(1000.0), 1).alias("kbps"),
        F.bround(bps / F.lit(1e6), 3).alias("mbps"),
        (bps <= F.lit(256_000.0)).alias("fits_256kbps_link"),
        (bps <= F.lit(1_000_000.0)).alias("fits_1mbps_link"),
    )
