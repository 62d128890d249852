"""Coarsening of a grid for a thin link, and the reports on it.

Merging is one grouped aggregation, not a filter and a union, so the cells it reads are built once.
With `preserve_risk` merged coarse cells overlap the fine cells left untouched: only point counts are
conserved, the result is no longer a disjoint tiling.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessgrid.functions import spatial
from tessgrid.functions.wire import link_budget
from tessgrid.operators.grid import CELL_COLUMNS, majority_rank
from tessgrid.operators.ordered import salted_join
from tessgrid.operators.stats import far_hazard, level_counts, median_size, memory_columns
from tessgrid.params import DRIVER_RANGE, GridParams
from tessgrid.sources.frames import pack_frames

#: Tiers that one pass over the cells makes; more take a pass each.
_TIERS_AT_ONCE = 62


@dataclass(frozen=True)
class Tier:
    """A link tier: cells finer than `max_level` are merged, unless a risk rule set their size."""

    name: str
    max_level: int
    preserve_risk: bool = True


def link_tiers(levels: tuple[int, ...] = (11, 10, 9, 8)) -> list[Tier]:
    return [
        Tier(f"level{level}_{'risk_preserved' if keep else 'plain'}", level, keep)
        for level in levels
        for keep in (True, False)
    ]


def decimate_tiers(
    cells: DataFrame, tiers: list[Tier], params: GridParams = GridParams()
) -> DataFrame:
    """Cells of every tier, with `tier`, `max_level`, `kept` and `merged_from` (input cells behind each
    output cell).

    All tiers come from one pass over `cells`. Sums are grouped by the square of the coarsest tier, or by
    the tile that `cells` carry if no square reaches beyond it: cells already lie together by tile, so
    nothing moves.
    """
    if len(tiers) > _TIERS_AT_ONCE:
        parts = [tiers[i : i + _TIERS_AT_ONCE] for i in range(0, len(tiers), _TIERS_AT_ONCE)]
        return reduce(DataFrame.unionByName, [decimate_tiers(cells, part, params) for part in parts])
    coarsest = min(t.max_level for t in tiers)
    if "tile" in cells.columns and coarsest >= params.tile_level:
        gathered, place = cells, "tile"
    else:
        place = "square"
        gathered = cells.withColumn(place, spatial.prefix(F.col("code"), coarsest, params))
    # A cell is one row for all tiers that keep it, and one for each tier that merges it. Tiers are bits.
    stay = [
        F.when(_stays(F.lit(t.max_level), F.lit(t.preserve_risk)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, t in enumerate(tiers)
    ]
    wanted = F.array(
        *[
            F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(t.max_level).alias("max_level"))
            for i, t in enumerate(tiers)
        ]
    )
    held = F.col("held")
    fanned = (
        gathered.withColumn("held", reduce(Column.bitwiseOR, stay).cast("long"))
        .withColumn("t", F.explode(wanted))
        .select("*", "t.*")
        .withColumn("kept", held.bitwiseAND(F.col("bit")) != 0)
        .where(~F.col("kept") | (held.bitwiseAND(F.negative(held)) == F.col("bit")))
        .withColumn("tiers", F.when(F.col("kept"), held).otherwise(F.col("bit")))
    )
    named = F.array(
        *[
            F.struct(
                F.lit(1 << i).cast("long").alias("bit"),
                F.lit(t.name).alias("tier"),
                F.lit(t.max_level).alias("max_level"),
            )
            for i, t in enumerate(tiers)
        ]
    )
    merged = _coarsen(fanned, place, params).withColumn("t", F.explode(named))
    own = merged.where(F.col("tiers").bitwiseAND(F.col("t.bit")) != 0)
    return own.select("t.tier", "t.max_level", "kept", "merged_from", *CELL_COLUMNS)


def decimate_asof(cells: DataFrame, settings: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Cells coarsened to each frame's own tier. `settings` has one row per frame: `frame_id`,
    `link_tier` (null: as built) and `preserve_risk`."""
    own = settings.select(
        "frame_id",
        F.coalesce(F.col("link_tier").cast("int"), F.lit(params.max_depth)).alias("max_level"),
        F.coalesce("preserve_risk", F.lit(True)).alias("preserve"),
    )
    joined = salted_join(cells, own, ["frame_id"], F.col("code")).where(F.col("max_level").isNotNull())
    # tiers differ by row, so no square is known to hold every merge: shuffle partial sums
    asked = joined.withColumns(
        {
            "square": F.lit(0),
            "tiers": F.lit(1).cast("long"),
            "kept": _stays(F.col("max_level"), F.col("preserve")),
        }
    )
    return _coarsen(asked, "square", params).select(*CELL_COLUMNS)


def _stays(max_level: Column, preserve: Column) -> Column:
    """Whether a tier leaves a cell as it is."""
    return (F.col("level") <= max_level) | (preserve & (F.col("driver") != DRIVER_RANGE))


def _coarsen(asked: DataFrame, place: str, params: GridParams) -> DataFrame:
    """Merge cells that carry (tiers, max_level, kept), grouped under `place`. `tiers` are the tiers a row
    stands for, as bits."""
    up = F.lit(2) * (F.lit(params.max_depth) - F.col("max_level"))
    node = spatial.prefix_at(F.col("code"), F.col("max_level"), params)
    tagged = asked.select(
        "frame_id",
        place,
        "tiers",
        "kept",
        F.when(F.col("kept"), F.col("level")).otherwise(F.col("max_level")).alias("level"),
        F.when(F.col("kept"), F.col("code"))
        .otherwise(F.call_function("shiftleft", node, up))
        .alias("code"),
        "cls",
        F.when(F.col("kept"), F.col("driver")).otherwise(F.lit(DRIVER_RANGE)).alias("driver"),
        "z",
        "z_min",
        "z_max",
        "conf",
        "n_points",
    )
    out = ["frame_id", place, "tiers", "kept", "level", "code"]
    n = F.col("n_points")
    votes = tagged.groupBy(*out, "cls").agg(
        F.count(F.lit(1)).alias("merged_from"),
        F.sum("n_points").alias("n_points"),
        F.sum(F.col("z") * n).alias("weighted_z"),
        F.sum(F.col("conf") * n).alias("weighted_conf"),
        F.max("z").alias("z"),
        F.max("conf").alias("conf"),
        F.min("z_min").alias("z_min"),
        F.max("z_max").alias("z_max"),
        F.max("driver").alias("driver"),
    )
    merged = votes.groupBy(*out).agg(
        F.sum("merged_from").alias("merged_from"),
        F.max_by("cls", majority_rank(n, F.col("cls"))).alias("cls"),
        (F.sum("weighted_z") / F.sum("n_points")).alias("mean_z"),
        (F.sum("weighted_conf") / F.sum("n_points")).alias("mean_conf"),
        F.max("z").alias("z"),
        F.max("conf").alias("conf"),
        F.min("z_min").alias("z_min"),
        F.max("z_max").alias("z_max"),
        F.max("driver").alias("driver"),
        F.sum("n_points").alias("n_points"),
    )
    # A kept cell is alone in its group and stays exactly as it was.
    x, y = spatial.cell_centre(
        spatial.prefix_at(F.col("code"), F.col("level"), params), F.col("level"), params
    )
    return (
        merged.withColumns(
            {
                "z": F.when(F.col("kept"), F.col("z")).otherwise(F.col("mean_z")),
                "conf": F.when(F.col("kept"), F.col("conf")).otherwise(F.col("mean_conf")),
                "x": x,
                "y": y,
            }
        ).select("tiers", "kept", "merged_from", *CELL_COLUMNS)
    )


def decimate(
    cells: DataFrame,
    max_level: int,
    preserve_risk: bool = True,
    params: GridParams = GridParams(),
) -> DataFrame:
    """Cells no finer than `max_level`, except (with `preserve_risk`) those sized by a risk rule."""
    tier = Tier("link", max_level, preserve_risk)
    return decimate_tiers(cells, [tier], params).select(*CELL_COLUMNS)


def decimation_report(
    cells: DataFrame,
    max_level: int,
    preserve_risk: bool = True,
    params: GridParams = GridParams(),
) -> DataFrame:
    """Per frame: what coarsening merged, what it left alone, and the memory figures afterwards. A frame
    with nothing finer than `max_level` reports no preserved cells, as nothing had to be preserved."""
    tiers = decimate_tiers(cells, [Tier("link", max_level, preserve_risk)], params)
    merged = ~F.col("kept")
    sums = tiers.groupBy("frame_id").agg(
        F.sum("merged_from").alias("cells_before"),
        F.count(F.lit(1)).alias("cells_after"),
        F.sum(F.when(merged, F.col("merged_from")).otherwise(0)).alias("merged_from"),
        F.count_if(merged).alias("merged_into"),
        F.count_if(F.col("kept") & (F.col("driver") != DRIVER_RANGE)).alias("preserved"),
        (F.max(F.when(F.col("kept"), F.col("level"))) > max_level).alias("finer_kept"),
        F.sum("n_points").alias("n_points"),
    )
    changed = (F.col("merged_into") > 0) | F.coalesce("finer_kept", F.lit(False))
    memory = memory_columns(params, F.col("cells_after"), F.col("n_points"))
    return sums.select(
        "frame_id",
        F.lit(max_level).alias("max_level"),
        F.lit(round(params.cell_size(max_level), 3)).alias("max_cell_m"),
        "cells_before",
        "cells_after",
        "merged_from",
        "merged_into",
        F.when(changed, F.col("preserved")).otherwise(0).cast("long").alias("preserved_risk_cells"),
        F.lit(preserve_risk).alias("preserve_risk"),
        *[
            memory[name].alias(name)
            for name in (
                "adaptive_bytes", "reduction_vs_dense", "reduction_vs_cloud", "reduction_vs_dense_3d",
            )
        ],
    )


def tier_matrix(
    cells: DataFrame, tiers: list[Tier] | None = None, params: GridParams = GridParams()
) -> DataFrame:
    """Per frame and tier: coarsest cell, cell count and the median size of hazard cells beyond the
    fovea."""
    return (
        decimate_tiers(cells, tiers or link_tiers(), params)
        .groupBy("frame_id", "tier", "max_level")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.sum("n_points").alias("n_points"),
            *level_counts(far_hazard(params), params),
        )
        .select(
            "frame_id",
            "tier",
            F.bround(F.lit(params.root_size_m) / F.pow(F.lit(2.0), "max_level"), 3).alias("max_cell_m"),
            "n_cells",
            "n_points",
            F.bround(median_size(params), 3).alias("median_hazard_cell_m"),
        )
    )


def tier_wire(
    cells: DataFrame,
    tiers: list[Tier] | None = None,
    params: GridParams = GridParams(),
    tasks: int | None = None,
) -> DataFrame:
    """What each tier of each frame costs once packed, and its rate at the target frame rate."""
    coarse = decimate_tiers(cells, tiers or link_tiers(), params).withColumnRenamed("tier", "variant")
    packed = pack_frames(coarse, params=params, tasks=tasks).drop("wire").withColumnRenamed("variant", "tier")
    return link_budget(packed, params.target_hz)
