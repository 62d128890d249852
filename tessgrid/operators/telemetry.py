"""Rolling frame timings and settings as of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.operators.ordered import carried_forward, with_history

SETTINGS = (
    "risk_adaptive", "compress", "conf_threshold", "hazard_factor", "hz", "link_tier",
    "preserve_risk_on_link",
)


def rolling_stats(
    timings: DataFrame, window: int = 60, digits: int = 2, history: bool = True, span: int = 4096
) -> DataFrame:
    """Per frame, figures over up to `window` frames of its stream before it, the frame itself excluded.

    A stream is cut into spans of consecutive frames that each bring along the frames before them, so a
    long stream is not confined to one task.
    """
    spread, keys, order = with_history(timings, ["stream_id"], "frame_id", window, span)
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)

    def mean(name: str) -> Column:
        return F.bround(F.avg(name).over(past), digits)

    rolled = (
        spread.withColumn("frame_ms_mean", mean("frame_ms"))
        .withColumn("frame_ms_p95", F.bround(F.percentile("frame_ms", 0.95).over(past), digits))
        .withColumn("perception_ms_mean", mean("perception_ms"))
        .withColumn("grid_ms_mean", mean("grid_ms"))
        .withColumn("codec_ms_mean", mean("codec_ms"))
        .withColumn("wire_bytes_mean", F.floor(F.avg("wire_bytes").over(past)).cast("long"))
        .withColumn("samples", F.count("frame_ms").over(past))
    )
    kept = [
        "stream_id", "frame_id", "fps", "frame_ms_mean", "frame_ms_p95", "perception_ms_mean",
        "grid_ms_mean", "codec_ms_mean", "wire_bytes_mean", "samples",
    ]
    if history:
        values = F.collect_list("frame_ms").over(past)
        rolled = rolled.withColumn(
            "history_ms", F.transform(values, lambda v: F.bround(v, digits))
        )
        kept.append("history_ms")
    mean_ms = F.when(F.col("frame_ms_mean") != 0, F.col("frame_ms_mean"))
    return (
        rolled.where(~F.col("is_history"))
        .withColumn("fps", F.bround(F.lit(1000.0) / mean_ms, digits))
        .select(*kept)
    )


def rate_target(rolling: DataFrame, target_hz: float) -> DataFrame:
    """Whether the rolling rate meets a target, and by how much."""
    margin = F.abs(F.col("fps") - F.lit(target_hz))
    return rolling.where(F.col("fps").isNotNull()).select(
        "stream_id",
        "frame_id",
        "fps",
        (F.col("fps") >= target_hz).alias("met"),
        F.bround(margin, 1).alias("margin_hz"),
    )


def settings_asof(
    log: DataFrame, settings: tuple[str, ...] = SETTINGS, defaults: dict[str, float] | None = None
) -> DataFrame:
    """Settings in force at each frame of a stream's log.

    `log` mixes commands (`setting` names what they set, `value` may be an explicit null) and frames
    (`setting` is null) in `seq` order; a command at the `seq` of a frame counts for it. A setting sticks
    until set again; a null that was set is kept apart from a setting never set, which takes its default.
    """
    log = log.withColumn("_frame", F.col("setting").isNull())
    wrapped = {
        f"set_{name}": F.when(F.col("setting") == name, F.struct(F.col("value").alias("v")))
        for name in settings
    }
    filled = carried_forward(log, ["stream_id"], "seq", wrapped, then=("_frame",))
    known = defaults or {}

    def current(name: str) -> Column:
        held = F.col(f"set_{name}")
        default = F.lit(known.get(name)).cast("double")
        return F.when(held.isNotNull(), held["v"]).otherwise(default).alias(name)

    return filled.where(F.col("setting").isNull()).select(
        "stream_id", "seq", *[current(name) for name in settings]
    )
