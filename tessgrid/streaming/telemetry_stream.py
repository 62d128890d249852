"""Rolling frame timings on a stream, from the last frames of each stream id as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessgrid.sources.sinks import write_batch
from tessgrid.streaming.keyed_state import RollingFrames, use_keyed_state

_RAW = (
    "stream_id long, frame_id long, frame_ms_mean double, frame_ms_p95 double, perception_ms_mean double, "
    "grid_ms_mean double, codec_ms_mean double, wire_bytes_mean double, samples long"
)


def rolling_figures(
    timings: DataFrame, window: int = 60, digits: int = 2, late: int = 60, idle_ms: int | None = None
) -> DataFrame:
    """Streaming `rolling_stats`: per frame, figures over up to `window` frames of its stream before it.

    Frames may come up to `late` frames late: they and the frames after them are then told again, and the
    last word on a frame is the one of the newest batch (`newest`). Later ones come with `samples` null. Nulls
    in a measure are skipped. With `idle_ms`, a stream that is silent for so long is forgotten.
    """
    use_keyed_state(timings.sparkSession)
    mode = "None" if idle_ms is None else "ProcessingTime"
    raw = timings.groupBy("stream_id").transformWithState(RollingFrames(window, late, idle_ms), _RAW, "Update", mode)
    rounded = [
        F.bround(c, digits).alias(c)
        for c in ("frame_ms_mean", "frame_ms_p95", "perception_ms_mean", "grid_ms_mean", "codec_ms_mean")
    ]
    told = raw.select("stream_id", "frame_id", *rounded, F.floor("wire_bytes_mean").cast("long").alias("wire_bytes_mean"), "samples")
    mean_ms = F.when(F.col("frame_ms_mean") != 0, F.col("frame_ms_mean"))
    return told.withColumn("fps", F.bround(F.lit(1000.0) / mean_ms, digits))


def start_rolling_stream(
    timings: DataFrame, out: str, checkpoint: str, window: int = 60, digits: int = 2, late: int = 60,
    idle_ms: int | None = None, once: bool = False,
) -> StreamingQuery:
    """Write the rolling figures of a streaming `timings` into `out`, a folder per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out, batch_id)

    figures = rolling_figures(timings, window, digits, late, idle_ms)
    writer = figures.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest(spark: SparkSession, out: str) -> DataFrame:
    """What a rolling stream wrote, each frame as last told."""
    rows = spark.read.parquet(out)
    figures = [c for c in rows.columns if c not in ("stream_id", "frame_id", "batch_id")]
    last = rows.groupBy("stream_id", "frame_id").agg(F.max_by(F.struct(*figures), "batch_id").alias("last"))
    return last.select("stream_id", "frame_id", "last.*")
