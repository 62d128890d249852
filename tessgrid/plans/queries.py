"""Registered queries: every operator over whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessgrid import dims
from tessgrid.functions import spatial, wire
from tessgrid.operators import (
    attach,
    compare,
    decimate,
    evidence,
    grid,
    layout,
    mapviews,
    objects,
    quality,
    stats,
    telemetry,
)
from tessgrid.params import GridParams
from tessgrid.plans import inputs
from tessgrid.plans.inputs import derived, points, table
from tessgrid.sources import frames

P = GridParams()
PLAIN = replace(P, risk_adaptive=False)
# edges off the cell lattice, so that no cell merely touches the window
WINDOW = (-40.02, 60.01, -30.03, 45.02)
PIXELS_PER_M = 20.0
CELL_BUDGET = 300
SECTOR = (37.7, 52.3)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(name: str, digits: int = 9) -> Column:
    return F.round(F.col(name), digits).alias(name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_r(c) if c in names else c for c in df.columns])


def _tidy_cells(cells: DataFrame) -> DataFrame:
    # only means depend on the order of a sum
    return _rounded(cells, "z", "conf")


def _tasks(spark: SparkSession, sf_dir: str) -> int | None:
    return layout.tasks_for(table(spark, sf_dir, "lineitem"))


def _cells(spark: SparkSession, sf_dir: str, tile: bool = False) -> DataFrame:
    return grid.adaptive_grid(points(spark, sf_dir), P, keep_tile=tile, tasks=_tasks(spark, sf_dir))


# ------------------------------------------------------------- points and expressions
@query
def crop_root(spark, sf_dir):
    moved = points(spark, sf_dir).withColumn("x", F.col("x") + F.lit(20.0))
    kept = moved.where(spatial.in_root(F.col("x"), F.col("y"), P))
    return kept.select("frame_id", "point_idx", _r("x"), _r("y"))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = points(spark, sf_dir).select(
        "frame_id",
        "point_idx",
        spatial.grid_index(F.col("x"), P).alias("ix"),
        spatial.grid_index(F.col("y"), P).alias("iy"),
    )
    code = spatial.morton_encode(F.col("ix"), F.col("iy"), P.max_depth)
    return placed.withColumn("code", code)


@query
def morton_codes(spark, sf_dir):
    return _coded(spark, sf_dir)


@query
def morton_roundtrip(spark, sf_dir):
    x, y = spatial.morton_decode(F.col("code"), P.max_depth)
    return _coded(spark, sf_dir).select("frame_id", "point_idx", x.alias("ix"), y.alias("iy"))


@query
def target_size_schedule(spark, sf_dir):
    r = spatial.polar_range(F.col("x"), F.col("y"))
    ranged = points(spark, sf_dir).select("frame_id", "point_idx", r.alias("range_m"))
    target = spatial.target_size(F.col("range_m"), P)
    return ranged.select(
        "frame_id",
        "point_idx",
        _r("range_m"),
        F.round(target, 9).alias("target_m"),
        spatial.level_for(target, P).alias("level"),
    )


@query
def required_level(spark, sf_dir):
    return grid.required_levels(points(spark, sf_dir), P, _tasks(spark, sf_dir))


@query
def class_edges(spark, sf_dir):
    return grid.class_edges(points(spark, sf_dir), P, _tasks(spark, sf_dir))


@query
def conf_default(spark, sf_dir):
    holes = (
        F.when(F.col("cls") == 8, F.lit(float("nan")))
        .when(F.col("cls") == 7, F.lit(None))
        .otherwise(F.col("conf"))
    )
    filled = attach.default_confidence(points(spark, sf_dir).withColumn("conf", holes))
    return filled.select("frame_id", "point_idx", _r("conf"))


@query
def sector_confidence(spark, sf_dir):
    return _rounded(attach.sector_confidence(points(spark, sf_dir), *SECTOR), "mean_conf")


@query
def class_dim_lookup(spark, sf_dir):
    shifted = points(spark, sf_dir).withColumn("cls", F.col("cls") + F.col("frame_id").cast("int") % 3)
    return attach.class_lookup(shifted).select(
        "frame_id", "point_idx", "cls", "name", "class_group", F.coalesce("hazard", F.lit(False)).alias("hazard")
    )


@query
def range_image_lookup(spark, sf_dir):
    image = derived(spark, sf_dir, inputs.IMAGE_ROWS).select(
        "frame_id",
        "h",
        F.transform("embedding", lambda e: (e.cast("double") + F.lit(1.0)) / F.lit(2.0)).alias("pixels"),
    )
    found = attach.range_image_lookup(points(spark, sf_dir), image, 64, 64, P)
    return found.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count("image_conf").alias("n_found"),
        F.round(F.avg("image_conf"), 6).alias("mean_conf"),
    )


@query
def attach_predictions(spark, sf_dir):
    joined = attach.attach_predictions(points(spark, sf_dir), derived(spark, sf_dir, inputs.PREDICTIONS))
    return joined.select("frame_id", "point_idx", "cls", _r("conf"), "source", "matched")


def _height_model(block: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a user's model: ground where it is low, surer the closer it is."""
    low = block["z"] < -1.4
    conf = 1.0 - np.sqrt(block["x"] ** 2 + block["y"] ** 2) / 200.0
    return pd.DataFrame({"cls": np.where(low, 1, 4), "conf": conf})


@query
def predict_hook(spark, sf_dir):
    return _rounded(attach.predict_points(points(spark, sf_dir), _height_model, "height-model"), "conf")


def _step_model(block: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a model with context: what rises above the lowest point around it is a wall."""
    rise = block["z"] - block.groupby("square")["z"].transform("min")
    return pd.DataFrame({"cls": np.where(rise < 0.25, 1, 4), "conf": 1.0 / (1.0 + rise)})


@query
def predict_tiles(spark, sf_dir):
    found = attach.predict_tiles(
        points(spark, sf_dir), _step_model, P.tile_level, "step-model", batched=True, tasks=_tasks(spark, sf_dir)
    )
    return _rounded(found, "conf")


@query
def point_cell_assignment(spark, sf_dir):
    found = grid.assign_points(points(spark, sf_dir), P, _tasks(spark, sf_dir))
    return found.select("frame_id", "point_idx", "level", "node", "driver")


# ------------------------------------------------------------- grid and statistics
@query
def adaptive_grid(spark, sf_dir):
    return _tidy_cells(_cells(spark, sf_dir))


@query
def leaf_extraction(spark, sf_dir):
    return _cells(spark, sf_dir).select(
        "frame_id", "level", spatial.prefix_at(F.col("code"), F.col("level"), P).alias("node"), "driver", "n_points"
    )


@query
def majority_class(spark, sf_dir):
    return _cells(spark, sf_dir).select("frame_id", "level", "code", "cls")


@query
def level_usage(spark, sf_dir):
    used = _cells(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"))
    table = dims.level_table(spark, P)
    return table.join(used, "level", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))


@query
def cells_by_level(spark, sf_dir):
    return stats.cells_by(_cells(spark, sf_dir), "level")


@query
def cells_by_driver(spark, sf_dir):
    return stats.cells_by_driver(_cells(spark, sf_dir))


@query
def cells_by_class(spark, sf_dir):
    return stats.cells_by_class(_cells(spark, sf_dir))


@query
def level_legend(spark, sf_dir):
    return stats.legend(_cells(spark, sf_dir), "level")


@query
def class_legend(spark, sf_dir):
    return stats.legend(_cells(spark, sf_dir), "cls")


@query
def frame_stats(spark, sf_dir):
    found = stats.frame_stats(_cells(spark, sf_dir), P)
    levels = [
        F.coalesce(F.try_element_at("cells_by_level", F.lit(level)), F.lit(0)).alias(f"level_{level}")
        for level in range(9, 13)
    ]
    return found.select(
        "frame_id",
        "n_points",
        "n_cells",
        "cell_size_min_m",
        "cell_size_max_m",
        "risk_driven_cells",
        "hazard_cells",
        "hazard_cells_beyond_fovea",
        "degraded_cells",
        F.col("elevation_range_m")[0].alias("z_low"),
        F.col("elevation_range_m")[1].alias("z_high"),
        *levels,
        F.coalesce(F.try_element_at("cells_by_driver", F.lit("class boundary")), F.lit(0)).alias("boundary_cells"),
        F.coalesce(F.try_element_at("cells_by_class", F.lit("pothole")), F.lit(0)).alias("pothole_cells"),
        "memory.adaptive_bytes",
        "memory.reduction_vs_dense",
    )


@query
def memory_reduction(spark, sf_dir):
    return stats.memory_reduction(_cells(spark, sf_dir), P)


# ------------------------------------------------------------- coarsening and comparison
@query
def decimate_l9(spark, sf_dir):
    return _tidy_cells(decimate.decimate(_cells(spark, sf_dir, tile=True), 9, True, P))


@query
def decimate_l9_plain(spark, sf_dir):
    return _tidy_cells(decimate.decimate(_cells(spark, sf_dir, tile=True), 9, False, P))


@query
def decimation_report(spark, sf_dir):
    return decimate.decimation_report(_cells(spark, sf_dir, tile=True), 9, True, P)


@query
def ab_compare(spark, sf_dir):
    return compare.ab_compare(points(spark, sf_dir), P, _tasks(spark, sf_dir))


@query
def tier_matrix(spark, sf_dir):
    return decimate.tier_matrix(_cells(spark, sf_dir, tile=True), params=P)


# What packing costs in full is fixed by the data; how far deflate gets is not, save that it gains.
def _proved(packed: DataFrame, *keys: str) -> DataFrame:
    return packed.select(
        *keys, "n_cells", "tail_bytes", "raw_bytes", (F.col("wire_bytes") < F.col("raw_bytes")).alias("smaller")
    )


@query
def tier_wire(spark, sf_dir):
    return _proved(decimate.tier_wire(_cells(spark, sf_dir, tile=True), params=P, tasks=_tasks(spark, sf_dir)), "frame_id", "tier")


@query
def ab_wire(spark, sf_dir):
    return _proved(compare.ab_wire(points(spark, sf_dir), P, _tasks(spark, sf_dir)), "frame_id", "scenario")


@query
def onboard_vs_link(spark, sf_dir):
    return compare.onboard_vs_link(_cells(spark, sf_dir, tile=True), 9, True, P)


# ------------------------------------------------------------- wire
@query
def quantise_cells(spark, sf_dir):
    fixed = wire.quantise_cells(_cells(spark, sf_dir), P)
    return fixed.select(
        "frame_id", "code", "level", "cls", "driver",
        *[F.col(c).cast("long").alias(c) for c in ("xq", "yq", "zq", "confq")],
    )


@query
def dequantise_error(spark, sf_dir):
    errors = wire.roundtrip_error(_cells(spark, sf_dir), P)
    return errors.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.round(F.max(f"{c}_error"), 9).alias(f"{c}_error") for c in ("x", "y", "z", "conf")],
    )


def _frame_bytes(cells: DataFrame) -> DataFrame:
    raw = F.lit(frames.HEADER_BYTES) + F.count(F.lit(1)) * F.lit(frames.BYTES_PER_PACKED_CELL)
    return cells.groupBy("frame_id").agg(raw.cast("long").alias("wire_bytes"))


@query
def link_budget(spark, sf_dir):
    return wire.link_budget(_frame_bytes(_cells(spark, sf_dir)), P.target_hz)


@query
def pack_frames(spark, sf_dir):
    packed = frames.pack_frames(_cells(spark, sf_dir), params=P, tail_of=frames.size_tail, tasks=_tasks(spark, sf_dir))
    return _proved(packed, "frame_id")


@query
def unpack_roundtrip(spark, sf_dir):
    back = frames.unpack_frames(frames.pack_frames(_cells(spark, sf_dir), params=P, tasks=_tasks(spark, sf_dir)))
    return _rounded(back, "x", "y").drop("position")


@query
def unpack_damaged(spark, sf_dir):
    """Every frame, each damaged in one of three ways or left whole: cells, or the reason there are none."""
    packed = frames.pack_frames(_cells(spark, sf_dir), compress=False, params=P, tasks=_tasks(spark, sf_dir))
    cut = F.expr("substring(wire, 1, length(wire) - 1)")
    spoilt = packed.withColumn(
        "wire",
        F.when(F.col("frame_id") % 4 == 1, F.expr("substring(wire, 1, 7)"))
        .when(F.col("frame_id") % 4 == 2, F.concat(F.lit(b"none"), F.expr("substring(wire, 5)")))
        .when(F.col("frame_id") % 4 == 3, cut)
        .otherwise(F.col("wire")),
    )
    return frames.unpack_frames(spoilt).groupBy("frame_id", "error").agg(F.count("level").alias("n_cells"))


@query
def check_tail(spark, sf_dir):
    def told(records, params):
        tail = frames.size_tail(records, params)
        odd = len(records) % 2
        return {**tail, "n_cells": tail["n_cells"] + odd}

    packed = frames.pack_frames(_cells(spark, sf_dir), params=P, tail_of=told, tasks=_tasks(spark, sf_dir))
    # headers and cells come from one packing: the bytes are read twice, the grid is built once
    packed = packed.select("frame_id", "wire").repartition("frame_id")
    return quality.check_tail(frames.frame_headers(packed), frames.unpack_frames(packed))


# ------------------------------------------------------------- views
@query
def viewport_cells(spark, sf_dir):
    return _tidy_cells(mapviews.viewport_cells(_cells(spark, sf_dir), *WINDOW, P))


@query
def viewport_lod(spark, sf_dir):
    seen = mapviews.viewport_lod(_cells(spark, sf_dir), *WINDOW, pixels_per_m=PIXELS_PER_M, params=P)
    return seen.select("frame_id", "code", "level")


@query
def viewport_budget(spark, sf_dir):
    seen = mapviews.viewport_lod(
        _cells(spark, sf_dir), *WINDOW, pixels_per_m=PIXELS_PER_M, params=P, budget=CELL_BUDGET
    )
    return seen.select("frame_id", "code", "level")


@query
def elevation_histogram(spark, sf_dir):
    # elevations are multiples of a bin here, so noise in a mean's last bits would move cells
    return mapviews.elevation_histogram(_tidy_cells(_cells(spark, sf_dir)))


@query
def confidence_histogram(spark, sf_dir):
    return mapviews.confidence_histogram(_cells(spark, sf_dir))


@query
def hazard_clusters(spark, sf_dir):
    return _rounded(mapviews.hazard_clusters(_cells(spark, sf_dir), params=P), "x", "y", "range_m")


# ------------------------------------------------------------- objects and categories
def _object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.expr("explode(array(named_struct('frame_id', 0L, 't', 0.0D), named_struct('frame_id', 1L, 't', 3.0D)))")
    tracks = derived(spark, sf_dir, inputs.TRACKS).select("*", times.alias("at"))
    return objects.object_list(tracks.select("*", "at.frame_id", "at.t"), P)


@query
def object_list(spark, sf_dir):
    return objects.by_range(_object_list(spark, sf_dir))


@query
def nearest_objects(spark, sf_dir):
    return objects.nearest_objects(_object_list(spark, sf_dir)).select("frame_id", "object_id", "r", "rank")


@query
def object_changes(spark, sf_dir):
    return objects.object_changes(_object_list(spark, sf_dir), 0, 1)


@query
def category_coverage(spark, sf_dir):
    return attach.category_coverage(points(spark, sf_dir))


@query
def missing_categories(spark, sf_dir):
    # every order is a frame of its own here: few points, so categories are missing
    small = points(spark, sf_dir).withColumn("frame_id", F.col("frame_id") * 4096 + F.shiftright("point_idx", 41))
    return attach.missing_categories(small)


# ------------------------------------------------------------- telemetry
def _rolling(spark: SparkSession, sf_dir: str, history: bool) -> DataFrame:
    return telemetry.rolling_stats(
        derived(spark, sf_dir, inputs.TIMINGS), digits=9, history=history
    )


@query
def rolling_stats(spark, sf_dir):
    rolled = _rolling(spark, sf_dir, history=True)
    newest = F.element_at("history_ms", -1)
    return rolled.select(
        "*",
        F.when(F.size("history_ms") > 0, newest).alias("newest_ms"),
        F.size("history_ms").cast("long").alias("history_len"),
    ).drop("history_ms")


@query
def rate_target(spark, sf_dir):
    return telemetry.rate_target(_rolling(spark, sf_dir, history=False), 20.0).drop("fps")


@query
def settings_asof(spark, sf_dir):
    log = derived(spark, sf_dir, inputs.COMMANDS)
    return telemetry.settings_asof(
        log,
        telemetry.SETTINGS,
        {"conf_threshold": P.conf_threshold, "hazard_factor": P.hazard_factor, "risk_adaptive": 1.0,
         "compress": 1.0, "hz": P.target_hz, "preserve_risk_on_link": 1.0},
    )


# ------------------------------------------------------------- evidence
@query
def edge_pivot(spark, sf_dir):
    return evidence.edge_report(derived(spark, sf_dir, inputs.LEDGER))


@query
def distance_report(spark, sf_dir):
    return evidence.distance_report(derived(spark, sf_dir, inputs.LEDGER)).drop("n_scans")


@query
def checklist_rollup(spark, sf_dir):
    return evidence.checklist_rollup(derived(spark, sf_dir, inputs.CHECKS))


@query
def distance_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.col("event_id") % 2).alias("export_path"),
        F.concat(F.lit("label"), F.col("event_id")).alias("label"),
        (F.col("user_id") % 17).alias("n_scans"),
        F.concat(F.lit("run-"), "event_type").alias("command"),
        F.create_map(
            F.lit("0-10m"), F.struct(F.col("value").alias("mIoU_dataset")),
            F.lit("10-30m"), F.struct((F.col("value") / 2).alias("mIoU_dataset")),
        ).alias("summary"),
    )
    return evidence.distance_report(derived(spark, sf_dir, inputs.LEDGER), runs)


@query
def per_class_report(spark, sf_dir):
    none = F.lit(None).cast("map<string,string>")

    def row(category: str, seg: Column, det: Column, seg_parts: Column, det_parts: Column) -> Column:
        return F.struct(
            F.lit(category).alias("ps_category"), seg.cast("double").alias("seg_mIoU"), det.cast("double").alias("det_AP"),
            seg_parts.alias("seg_constituents"), det_parts.alias("det_constituents"),
        )

    value, kind = F.col("value"), F.col("event_type")
    place = (F.col("user_id") % 3).cast("string")
    runs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.col("event_id")).alias("export_path"),
        F.when(F.col("event_id") % 4 != 0, kind).alias("label"),
        F.lit("mean").alias("aggregation"),
        F.concat(F.lit("day"), F.col("event_id") % 9).alias("created"),
        F.array(
            row("walls", value, F.lit(None), F.create_map(F.lit("wall"), kind, F.lit("fence"), F.lit("f")),
                F.create_map(F.lit("fence"), place, F.lit("gate"), kind)),
            row("poles", F.lit(None), value / 2, none, F.create_map(F.lit("pole"), place)),
        ).alias("rows"),
    )
    return _rounded(evidence.per_class_report(runs), "seg_miou", "det_ap")


@query
def segmentation_entries(spark, sf_dir):
    found = evidence.segmentation_entries(derived(spark, sf_dir, inputs.LEDGER))
    return found.select("export_path", "seq", "metric", "value", "command")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export per event, with what an export may or may not hold."""
    n, kind = F.col("event_id"), F.col("event_type")

    def baseline(checkpoint: Column) -> Column:
        return F.struct(kind.alias("name"), F.lit("axis").alias("axis"), checkpoint.alias("checkpoint"), F.lit("c").alias("config"))

    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("export"), n).alias("export_path"),
        (n % 11 != 0).alias("available"),
        F.concat(F.lit("day"), n % 9).alias("generated"),
        F.when(n % 3 == 0, F.lit("")).when(n % 3 == 1, kind).alias("edge_board"),
        F.when(n % 2 == 0, F.array(kind, F.lit("few scans"))).alias("data_caveats"),
        F.when(n % 5 == 0, F.array(F.struct(F.concat(F.lit("better than "), kind).alias("claim")))).alias("comparisons"),
        F.create_map(
            F.lit("one"), baseline(F.when(n % 2 == 0, F.concat(F.lit("/ckpt/"), kind))),
            F.lit("two"), baseline(F.when(n % 3 == 0, F.lit("")).otherwise(F.lit("/two"))),
        ).alias("baselines"),
        F.when(n % 4 == 0, F.lit("edge")).when(n % 4 == 1, F.lit("segmentation")).alias("tag"),
    )


@query
def named_baselines(spark, sf_dir):
    return evidence.named_baselines(_exports(spark, sf_dir)).select("export_path", "key", "name", "checkpoint")


@query
def evidence_status(spark, sf_dir):
    # both proofs of a row in one pass
    told = table(spark, sf_dir, "events").select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("run"), F.col("event_id") % 5).alias("export_path"),
                     F.expr(inputs.LEDGER_TAG).alias("block")),
            F.struct(F.concat(F.lit("run"), F.col("user_id") % 7).alias("export_path"), F.lit("checklist").alias("block")),
        )).alias("p")
    )
    return evidence.evidence_status(told.select("p.*")).select("export_path", "block", "status")


@query
def evidence_snapshot(spark, sf_dir):
    exports = _exports(spark, sf_dir)
    proofs = exports.select(
        "export_path",
        F.explode(F.array_compact(F.array(
            F.col("tag"),
            F.when(F.exists(F.map_values("baselines"), lambda b: F.coalesce(b["checkpoint"], F.lit("")) != ""), F.lit("baselines")),
        ))).alias("block"),
    )
    found = evidence.evidence_snapshot(exports, proofs)
    return found.select(
        "export_path", "block", "status", "available", "generated", "board",
        F.array_join("data_caveats", "; ").alias("caveats"), F.array_join("claims", "; ").alias("claims"),
        F.col("missing").isNotNull().alias("told"),
    )


# ------------------------------------------------------------- quality
# Each check sees cells of which some are spoilt in the way it looks for.
def _spoil(rows: DataFrame, column: str, value: Column, every: int, key: str = "code") -> DataFrame:
    hit = F.col(key) % every == 0
    return rows.withColumn(column, F.when(hit, value).otherwise(F.col(column)))


@query
def check_conservation(spark, sf_dir):
    pts = points(spark, sf_dir)
    spoilt = _spoil(grid.adaptive_grid(pts, P, tasks=_tasks(spark, sf_dir)), "n_points", F.col("n_points") + 1, 97)
    return quality.check_conservation(pts, spoilt, P)


@query
def check_conservation_link(spark, sf_dir):
    link = decimate.decimate(_cells(spark, sf_dir, tile=True), 9, True, P)
    return quality.check_conservation(points(spark, sf_dir), link.where(F.col("code") % 53 != 0), P)


@query
def check_containment(spark, sf_dir):
    assigned = grid.assign_points(points(spark, sf_dir), P, _tasks(spark, sf_dir))
    return quality.check_containment(_spoil(assigned, "x", F.col("x") + 0.17, 7), P)


@query
def check_lattice(spark, sf_dir):
    return quality.check_lattice(_spoil(_cells(spark, sf_dir), "y", F.col("y") + 0.01, 31), P)


@query
def check_sizes(spark, sf_dir):
    return quality.check_sizes(_spoil(_cells(spark, sf_dir), "level", F.col("level") - 3, 29), P)


@query
def check_elevation(spark, sf_dir):
    return quality.check_elevation(_spoil(_cells(spark, sf_dir), "z", F.col("z") + 5.0, 37))


@query
def check_elevation_link(spark, sf_dir):
    link = decimate.decimate(_cells(spark, sf_dir, tile=True), 9, True, P)
    return quality.check_elevation(_spoil(link, "z", F.col("z") - 5.0, 41))


@query
def check_range_only(spark, sf_dir):
    plain = grid.adaptive_grid(points(spark, sf_dir), PLAIN, tasks=_tasks(spark, sf_dir))
    return quality.check_range_only(_spoil(plain, "driver", F.lit(1), 43))


@query
def check_roundtrip(spark, sf_dir):
    return quality.check_roundtrip(_spoil(_cells(spark, sf_dir), "z", F.col("z") + 400.0, 47), P)


@query
def check_points(spark, sf_dir):
    # some rows get what the check looks for
    spoilt = (
        points(spark, sf_dir)
        .withColumn("conf", F.when(F.col("conf") > 0.93, F.col("conf") + 0.2).otherwise(F.col("conf")))
        .withColumn("z", F.when(F.col("cls") == 5, F.lit(float("nan"))).otherwise(F.col("z")))
        .withColumn("source", F.when(F.col("frame_id") % 2 == 1, F.col("cls").cast("string")).otherwise(F.col("source")))
    )
    return quality.check_points(spoilt)


@query
def check_sparse(spark, sf_dir):
    return quality.check_sparse(_spoil(_cells(spark, sf_dir), "n_points", F.lit(0), 59), P)


@query
def check_hazard_depth(spark, sf_dir):
    return quality.check_hazard_depth(_cells(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to cells to per-frame statistics."""
    return frame_stats(spark, sf_dir)


@query
def cell_checks(spark, sf_dir):
    spoilt = _spoil(_cells(spark, sf_dir), "y", F.col("y") + 0.01, 31)
    spoilt = _spoil(_spoil(spoilt, "z", F.col("z") + 400.0, 47), "n_points", F.lit(0), 59)
    return quality.cell_checks(spoilt, P)
