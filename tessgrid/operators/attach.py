"""Putting classes and confidences from elsewhere onto points."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessgrid.dims import category_bridge, class_dim
from tessgrid.functions import risk, spatial
from tessgrid.operators.layout import gathered, whole_groups
from tessgrid.operators.ordered import salted_join
from tessgrid.params import CATEGORIES, GridParams

_PREDICTED = "frame_id LONG, point_idx LONG, cls INT, conf DOUBLE, source STRING"
#: Rows of whole squares that a Python task holds at a time.
_SQUARE_ROWS = 2**17


def default_confidence(points: DataFrame) -> DataFrame:
    return points.withColumn("conf", risk.conf_or_default(F.col("conf")))


def attach_predictions(points: DataFrame, predictions: DataFrame, source: str = "model") -> DataFrame:
    """Replace class and confidence by a model's (`pred_cls`, `pred_conf`), matched by position. Points
    without a prediction become unknown (0) with full confidence. Keys are unique on both sides."""
    joined = points.drop("cls", "conf", "source").join(
        predictions.select("frame_id", "point_idx", "pred_cls", "pred_conf").hint("merge"),
        ["frame_id", "point_idx"],
        "left",
    )
    return (
        joined.withColumn("matched", F.col("pred_cls").isNotNull())
        .withColumn("cls", risk.class_id(F.col("pred_cls")))
        .withColumn("conf", risk.conf_or_default(F.col("pred_conf")))
        .withColumn("source", F.lit(source))
        .drop("pred_cls", "pred_conf")
    )


def _predicted(block: pd.DataFrame, found: pd.DataFrame, source: str) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "frame_id": block["frame_id"].to_numpy(),
            "point_idx": block["point_idx"].to_numpy(),
            "cls": found["cls"].to_numpy().astype("int32"),
            "conf": found["conf"].fillna(1.0).to_numpy(),
            "source": source,
        }
    )


def predict_points(
    points: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], source: str = "model"
) -> DataFrame:
    """Run a pointwise model: x, y, z in, a frame with `cls` and `conf` in the same order out. What the
    model says of a point must depend on that point alone; it sees arbitrary batches. Nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            yield _predicted(block, model(block[["x", "y", "z"]]), source)

    return points.select("frame_id", "point_idx", "x", "y", "z").mapInPandas(run, _PREDICTED)


def _loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """What `load` gives, once in the life of a Python worker; a model of another name takes its place."""
    kept = sys.modules.setdefault("_tessgrid_models", types.ModuleType("_tessgrid_models"))
    if getattr(kept, "name", None) != name:
        kept.name, kept.model = None, None  # the older one is freed before the next is loaded
        kept.model = load()
        kept.name = name
    return kept.model


def predict_loaded(
    points: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    name: str,
    source: str = "model",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """`predict_points` for a model that needs set-up, such as weights to read or a device to claim.

    `load` runs in a Python worker before its first batch and gives the model; later tasks and micro-batches in
    that worker find it by `name`, which therefore names the version too. A `load` that fails fails the task
    and is tried again. `profile` asks for executors with the resources the model needs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for block in batches:
            model = model or _loaded(name, load)
            yield _predicted(block, model(block[["x", "y", "z"]]), source)

    return points.select("frame_id", "point_idx", "x", "y", "z").mapInPandas(run, _PREDICTED, profile=profile)


def predict_tiles(
    points: DataFrame,
    model: Callable[[pd.DataFrame], pd.DataFrame],
    tile_level: int,
    source: str = "model",
    params: GridParams = GridParams(),
    batched: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Run a model that uses context: it sees all points of one frame in one square of `tile_level`, in
    index order. The caller chooses the square, and with it how many points a call may hold. Points
    outside the root square are left out.

    A call costs far more than the few points of a small square. A `batched` model is given many squares
    at once, each of them whole; the column `square` tells them apart, and what it says of a point must
    depend on that point's square alone. `tasks` is how many partitions the squares are dealt to, see
    `layout.tasks_for`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ("frame_id", "tile"), _SQUARE_ROWS):
            block = table.select(["x", "y", "z"]).to_pandas()
            ends = [*starts[1:], len(block)]
            if batched:
                sizes = np.diff([*starts, len(block)])
                found = [model(block.assign(square=np.repeat(np.arange(len(starts)), sizes)))]
            else:
                found = [model(block.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts, ends)]
            conf = np.concatenate([f["conf"].fillna(1.0).to_numpy().astype("float64") for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    *[table[name].cast(pa.int64()).combine_chunks() for name in ("frame_id", "point_idx")],
                    pa.array(np.concatenate([f["cls"].to_numpy().astype("int32") for f in found])),
                    pa.array(conf),
                    pa.array([source]).take(pa.array(np.zeros(len(block), "int64"))),
                ],
                names=["frame_id", "point_idx", "cls", "conf", "source"],
            )

    x, y = F.col("x"), F.col("y")
    code = spatial.morton_encode(
        spatial.grid_index(x, params), spatial.grid_index(y, params), params.max_depth
    )
    placed = points.where(spatial.in_root(x, y, params)).select(
        "frame_id", "point_idx", "x", "y", "z", spatial.prefix(code, tile_level, params).alias("tile")
    )
    squares = gathered(placed, tasks, "frame_id", "tile")
    in_order = squares.sortWithinPartitions("frame_id", "tile", F.asc_nulls_last("point_idx"))
    return in_order.mapInArrow(run, _PREDICTED)


def image_bins(points: DataFrame, height: int, width: int, params: GridParams = GridParams()) -> DataFrame:
    """Row `h` and column `w` of the range image each point projects to."""
    azimuth = F.pmod(spatial.azimuth_deg(F.col("x"), F.col("y")) + F.lit(180.0), F.lit(360.0))
    flat = F.greatest(spatial.polar_range(F.col("x"), F.col("y")), F.lit(1e-6))
    elevation = F.degrees(F.atan2(F.col("z"), flat))
    up, down = params.fov_up_deg, params.fov_down_deg
    row = (F.lit(up) - elevation) / F.lit(up - down) * F.lit(float(height - 1))
    column = azimuth / F.lit(360.0) * F.lit(float(width))

    def clipped(v, size: int):
        return F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(size - 1))

    return points.withColumn("h", clipped(row, height)).withColumn("w", clipped(column, width))


def range_image_lookup(
    points: DataFrame, image: DataFrame, height: int, width: int, params: GridParams = GridParams()
) -> DataFrame:
    """Confidence of each point from its frame's range image, given as one row of `pixels`
    (ARRAY<DOUBLE>) per (frame_id, h). Points outside any image keep a null `image_conf`.

    Image rows are few per frame, so copying each to a handful of salts lets a frame with very many
    points spread out.
    """
    binned = image_bins(points, height, width, params)
    joined = salted_join(
        binned, image.select("frame_id", "h", "pixels"), ["frame_id", "h"], F.xxhash64("point_idx")
    )
    return joined.withColumn("image_conf", F.get("pixels", F.col("w"))).drop("pixels")


def sector_confidence(points: DataFrame, centre_deg: float, half_width_deg: float) -> DataFrame:
    """Mean confidence inside and outside an azimuth sector, per frame."""
    inside = spatial.in_sector(F.col("x"), F.col("y"), F.lit(centre_deg), F.lit(half_width_deg))
    return (
        points.withColumn("inside", inside)
        .groupBy("frame_id", "inside")
        .agg(F.count(F.lit(1)).alias("n_points"), F.avg("conf").alias("mean_conf"))
    )


def class_lookup(points: DataFrame) -> DataFrame:
    """Class name, group and hazard flag of each point; unknown ids keep their number as their name."""
    facts = F.broadcast(class_dim(points.sparkSession).select("cls", "name", "class_group", "hazard"))
    return points.join(facts, "cls", "left").withColumn("name", F.coalesce("name", F.col("cls").cast("string")))


def category_coverage(points: DataFrame) -> DataFrame:
    """Points and frames per named category, and for hazards of any kind."""
    seen = points.groupBy("frame_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    hazards = class_dim(points.sparkSession).where("hazard").select(F.lit("hazards").alias("category"), "cls")
    wanted = category_bridge(points.sparkSession).unionByName(hazards)
    return (
        seen.join(F.broadcast(wanted), "cls")
        .groupBy("category")
        .agg(F.sum("n").alias("n_points"), F.count_distinct("frame_id").alias("n_frames"))
    )


def missing_categories(points: DataFrame) -> DataFrame:
    """Per frame, the named categories without a single point in it. One flag per category, so the points
    are read once and a frame is one row of flags."""
    flags = [F.max(F.col("cls").isin(*ids)).alias(f"has_{name}") for name, ids in CATEGORIES]
    absent = F.array(*[F.when(~F.coalesce(f"has_{n}", F.lit(False)), F.lit(n)) for n, _ in CATEGORIES])
    return points.groupBy("frame_id").agg(*flags).select(
        "frame_id", F.explode(F.array_compact(absent)).alias("category")
    )
