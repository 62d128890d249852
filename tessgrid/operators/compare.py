"""Comparisons of one set of frames under several settings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessgrid.functions import spatial
from tessgrid.operators.decimate import Tier, decimate_tiers
from tessgrid.operators.grid import scenario_grids
from tessgrid.operators.stats import (
    LEVEL_COUNT,
    far_hazard,
    level_counts,
    median_size,
    memory_columns,
    summarise,
)
from tessgrid.params import DRIVERS, GridParams
from tessgrid.sources.frames import pack_frames


def ab_grids(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """Risk-adaptive and range-only cells (`scenario`), both from one pass over the points."""
    return scenario_grids(
        points,
        {
            "risk_adaptive": replace(params, risk_adaptive=True),
            "range_only": replace(params, risk_adaptive=False),
        },
        tasks,
    )


def ab_wire(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """What the frames of either scenario cost once packed."""
    grids = ab_grids(points, params, tasks).withColumnRenamed("scenario", "variant")
    return pack_frames(grids, params=params, tasks=tasks).drop("wire").withColumnRenamed("variant", "scenario")


def ab_compare(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """Risk-adaptive against range-only, per frame."""
    grids = ab_grids(points, params, tasks)
    far, size = far_hazard(params), spatial.cell_size(F.col("level"), params)
    sums = grids.groupBy("frame_id", "scenario").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("n_points").alias("n_points"),
        *[
            F.count_if(F.col("driver") == i).alias("cells_" + name.replace(" ", "_"))
            for i, name in DRIVERS
        ],
        F.count_if(far).alias("hazard_cells_beyond_fovea"),
        *level_counts(far, params),
        F.bround(F.min(F.when(far, size)), 3).alias("finest_hazard_cell_m"),
        F.count_if(F.col("conf") < params.conf_threshold).alias("degraded_cells"),
    )
    memory = memory_columns(params, F.col("n_cells"), F.col("n_points"))
    named = [c for c in sums.columns if not c.startswith(LEVEL_COUNT)]
    return sums.select(
        *named,
        F.bround(median_size(params), 3).alias("median_hazard_cell_m"),
        *[
            memory[name].alias(name)
            for name in (
                "adaptive_bytes", "dense_uniform_bytes", "raw_cloud_bytes", "reduction_vs_dense",
                "reduction_vs_dense_3d", "reduction_vs_cloud",
            )
        ],
    )


def onboard_vs_link(
    cells: DataFrame,
    max_level: int,
    preserve_risk: bool = True,
    params: GridParams = GridParams(),
) -> DataFrame:
    """Figures of the full map beside those of the coarsened one. The full map is the tier that merges
    nothing, so both sides share one pass and one shuffle."""
    tiers = [Tier("onboard", params.max_depth), Tier("link", max_level, preserve_risk)]
    figures = summarise(
        decimate_tiers(cells, tiers, params), params, keys=("frame_id", "tier")
    )
    shown = ["n_cells", "risk_driven_cells", "hazard_cells", "cell_size_max_m"]

    def side(tier: str):
        return [
            F.max(F.when(F.col("tier") == tier, F.col(name))).alias(f"{tier}_{name}") for name in shown
        ]

    return figures.groupBy("frame_id").agg(
        F.max("n_points").alias("n_points"), *side("onboard"), *side("link")
    )
