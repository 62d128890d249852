"""Continuous grid building: each micro-batch runs the batch operators on the frames it brings.

`start_scan_stream` takes raw scans all the way to packed frames: keyed state numbers the frames of each
drive and holds its settings, a hook labels the points, and grid, coarsening and packing follow.
`start_grid_stream` starts from labelled points.

Row-based windows are not defined on streaming DataFrames, so the operators run inside foreachBatch. Each
batch replaces its own folder, which makes a replay after a failure harmless. A frame whose points come
in several files may arrive in several batches: each batch then rebuilds its frames from what is stored
of the earlier ones, and `latest` reads the last version of each frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessgrid.functions.wire import link_budget
from tessgrid.operators.decimate import decimate, decimate_asof
from tessgrid.operators.grid import adaptive_grid, grid_of_parts, part_runs
from tessgrid.operators.ordered import salted_join
from tessgrid.operators.stats import summarise
from tessgrid.operators.telemetry import SETTINGS, settings_asof
from tessgrid.params import GridParams
from tessgrid.sources.frames import pack_frames
from tessgrid.sources.scans import frame_number, parse_scans, path_id
from tessgrid.sources.sinks import write_batch
from tessgrid.streaming.keyed_state import NumberedFrames, use_keyed_state
from tessgrid.streaming.versions import newest_frames, write_version

POINTS_SCHEMA = (
    "frame_id LONG, point_idx LONG, x DOUBLE, y DOUBLE, z DOUBLE, cls INT, conf DOUBLE, source STRING"
)

def stream_points(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Labelled points from Parquet files as they arrive."""
    return (
        spark.readStream.schema(POINTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def stream_scans(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Raw scans as they arrive, identified by their path; `number` is the digits that end the name."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", "*.bin")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return parse_scans(files.withColumn("frame_id", path_id(F.col("path")))).select(
        "frame_id", "point_idx", "x", "y", "z", "intensity", frame_number(F.col("path")).alias("number")
    )


def known_settings(params: GridParams) -> dict[str, float]:
    """What holds before a setting is set. Flags are numbers, 0 for off."""
    return {
        "risk_adaptive": float(params.risk_adaptive),
        "conf_threshold": params.conf_threshold,
        "hazard_factor": params.hazard_factor,
        "preserve_risk_on_link": 1.0,
        "compress": 1.0,
        "hz": params.target_hz,
    }


def as_held(settings: DataFrame) -> DataFrame:
    """Settings per frame_id in the types and names that `build_cells` takes."""
    return settings.select(
        "frame_id",
        (F.col("risk_adaptive") != 0).alias("set_risk_adaptive"),
        F.col("conf_threshold").alias("set_conf_threshold"),
        F.col("hazard_factor").alias("set_hazard_factor"),
        F.col("link_tier").cast("int").alias("link_tier"),
        (F.col("preserve_risk_on_link") != 0).alias("preserve_risk"),
        (F.col("compress") != 0).alias("compress"),
        "hz",
    )


def settings_of_frames(frames: DataFrame, commands: DataFrame, params: GridParams) -> DataFrame:
    """Settings in force at each frame: `commands` (seq, setting, value) count for frames from number seq on.
    Flags are numbers there, 0 for off. Any LONG may be a frame number; their order decides."""
    one = F.lit(0).cast("long").alias("stream_id")
    log = frames.select(
        one, F.col("frame_id").alias("seq"), F.lit(None).cast("string").alias("setting"), F.lit(None).cast("double").alias("value")
    ).unionByName(commands.select(one, "seq", "setting", "value"))
    held = settings_asof(log, SETTINGS, known_settings(params))
    return as_held(held.withColumnRenamed("seq", "frame_id"))


def build_cells(
    points: DataFrame,
    params: GridParams = GridParams(),
    link_tier: int | None = None,
    preserve_risk: bool = True,
    held: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cells of a batch as built and as sent over the link, under fixed settings or those held at each
    frame (`settings_of_frames`)."""
    if held is None:
        cells = adaptive_grid(points, params, keep_tile=True)
        full = cells.drop("tile")
        return full, full if link_tier is None else decimate(cells, link_tier, preserve_risk, params)
    risk_columns = ["set_risk_adaptive", "set_conf_threshold", "set_hazard_factor"]
    set_points = salted_join(
        points, held.select("frame_id", *risk_columns), ["frame_id"], F.xxhash64("point_idx")
    )
    overrides = {name.removeprefix("set_"): name for name in risk_columns}
    full = adaptive_grid(set_points, params, overrides)
    return full, decimate_asof(full, held, params)


def frame_tails(
    full: DataFrame, link: DataFrame, params: GridParams, held: DataFrame | None = None,
    rates: DataFrame | None = None,
) -> DataFrame:
    """frame_id, tail, compress, hz: what is sent beside a frame's cells. The tail is JSON: figures of the
    cells as built (`onboard`) and as sent (`link`), the frame rate, and the rolling figures of the frame
    if `rates` (`rolling_stats`, one stream) has them. The rate of the link is the rolling one if known."""
    figures = ["n_points", "n_cells", "cell_size_min_m", "cell_size_max_m", "risk_driven_cells", "hazard_cells"]

    def side(cells: DataFrame, name: str) -> DataFrame:
        return summarise(cells, params).select("frame_id", F.struct(*figures).alias(name))

    told = side(full, "onboard").join(side(link, "link"), "frame_id", "left")
    if held is not None:
        told = told.join(held.select("frame_id", "compress", "hz"), "frame_id", "left")
    else:
        told = told.withColumns({"compress": F.lit(True), "hz": F.lit(params.target_hz)})
    parts = ["onboard", "link", "hz"]
    if rates is not None:
        shown = ["fps", "frame_ms_mean", "frame_ms_p95", "wire_bytes_mean", "samples"]
        told = told.join(rates.select("frame_id", F.struct(*shown).alias("rolling")), "frame_id", "left")
        told = told.withColumn("hz", F.coalesce("rolling.fps", "hz"))
        parts.append("rolling")
    return told.select("frame_id", F.to_json(F.struct(*parts)).alias("tail"), "compress", "hz")


def packed_link(full: DataFrame, link: DataFrame, tails: DataFrame, params: GridParams) -> DataFrame:
    """Packed frames with their tails and what they cost on a link at their rate."""
    packed = pack_frames(link, tails.select("frame_id", "tail", "compress"), params=params)
    return link_budget(packed.join(tails.select("frame_id", "hz"), "frame_id", "left"), F.col("hz"))


#: Consecutive frames whose parts share a folder, and folders a batch names when it looks for its frames.
PART_FRAMES, PART_FOLDERS = 256, 1000


def _with_part(batch: DataFrame, params: GridParams, folder: str, batch_id: int) -> DataFrame:
    """Store the class runs of a batch and give those of all its frames so far."""
    spark = batch.sparkSession
    block = F.floor(F.col("frame_id") / PART_FRAMES).cast("long")
    runs = part_runs(batch, params)
    here = f"{folder}/batch_id={batch_id}"
    runs.withColumn("frame_block", block).write.mode("overwrite").partitionBy("frame_block").parquet(here)
    schema = runs.schema.add("frame_block", "long").add("batch_id", "long")
    mine = spark.read.schema(runs.schema.add("frame_block", "long")).parquet(here)
    frames = mine.select("frame_id", "frame_block").distinct()
    every = spark.read.schema(schema).parquet(folder).where(F.col("batch_id") <= batch_id)
    blocks = [r.frame_block for r in frames.select("frame_block").distinct().limit(PART_FOLDERS + 1).collect()]
    if len(blocks) <= PART_FOLDERS:
        every = every.where(F.col("frame_block").isin(blocks))
    return every.drop("batch_id").join(frames, ["frame_id", "frame_block"], "left_semi").drop("frame_block")


def start_grid_stream(
    points: DataFrame,
    out: str,
    checkpoint: str,
    params: GridParams = GridParams(),
    link_tier: int | None = None,
    preserve_risk: bool = True,
    commands: Callable[[], DataFrame] | None = None,
    pack: bool = False,
    once: bool = False,
    source: Callable[[], DataFrame] | None = None,
    rates: Callable[[], DataFrame] | None = None,
    parts: str | None = None,
) -> StreamingQuery:
    """Build, coarsen and (with `pack`) pack every batch of `points` into `out`.

    `commands`, `source` (all points there are) and `rates` are called per batch, so tables that grow are
    read as they then are. A frame may be split over batches if `parts` names a folder: each batch adds the
    class runs of its points there, and rebuilds its frames from the runs of all batches, reading no point
    twice (`grid_of_parts` says what the parts must be like). Or `source` gives all points again, which
    also serves with `commands`. Without either a frame must come in one batch. `once` processes what is
    there and stops.
    """
    if parts is not None and (commands is not None or source is not None):
        raise ValueError("parts go with neither commands nor source")

    def handle(batch: DataFrame, batch_id: int) -> None:
        if parts is not None:
            built = grid_of_parts(_with_part(batch, params, parts, batch_id), params, keep_tile=True)
            full = built.drop("tile")
            link = full if link_tier is None else decimate(built, link_tier, preserve_risk, params)
            held = None
        else:
            frames = batch.select("frame_id").distinct()
            whole = batch if source is None else source().join(frames, "frame_id", "left_semi")
            held = settings_of_frames(frames, commands(), params) if commands is not None else None
            full, link = build_cells(whole, params, link_tier, preserve_risk, held)
        if pack:
            tails = frame_tails(full, link, params, held, rates() if rates is not None else None)
            link = packed_link(full, link, tails, params)
        write_version(link, out, batch_id)

    writer = points.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Frames that a drive may have if frames of several drives are to fit the 32 bits of a packed frame.
FRAME_BITS = 20


def drive_of(path: Column) -> Column:
    """The folder a file lies in."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def numbered_frames(
    spark: SparkSession, folder: str, params: GridParams = GridParams(), commands: DataFrame | None = None,
    files_per_batch: int = 64, link_tier: int | None = None,
) -> DataFrame:
    """Streaming: drive, path, number and the settings in force of every `*.bin` file as it arrives under
    `folder`. Files are listed, not read. `commands`: a stream of drive, seq, setting, value."""
    use_keyed_state(spark)
    files = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", "*.bin")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("setting", "string"), ("value", "double"))]
    log = files.select(drive_of(F.col("path")).alias("drive"), "path", *none)
    if commands is not None:
        given = commands.where("setting IS NOT NULL AND seq IS NOT NULL")
        log = log.unionByName(given.select("drive", F.lit(None).cast("string").alias("path"), "seq", "setting", "value"))
    schema = "drive string, path string, number long, " + ", ".join(f"{s} double" for s in SETTINGS)
    known = known_settings(params) | ({} if link_tier is None else {"link_tier": float(link_tier)})
    processor = NumberedFrames(SETTINGS, known)
    return log.groupBy("drive").transformWithState(processor, schema, "Append", "None")


def _drive_numbers(spark: SparkSession, batch: DataFrame, state: str, batch_id: int) -> DataFrame:
    """drive, drive_no of the drives of a batch: numbered from 0 up as they first appear, in order of name
    within a batch. One row per drive is remembered; a replay numbers them the same."""
    seen = batch.select("drive").distinct()
    schema = "drive string, drive_no long, batch_id long"
    known = spark.createDataFrame([], schema)
    if batch_id > 0:
        known = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{state}/drives").where(F.col("batch_id") < batch_id)
    first = known.agg(F.coalesce(F.max("drive_no") + 1, F.lit(0))).first()[0]
    new = seen.join(known, "drive", "left_anti")
    new = new.select("drive", (F.row_number().over(Window.orderBy("drive")) - 1 + first).cast("long").alias("drive_no"))
    write_batch(new, f"{state}/drives", batch_id)
    return spark.read.schema(schema).parquet(f"{state}/drives").where(F.col("batch_id") <= batch_id).join(seen, "drive", "left_semi").drop("batch_id")


def start_scan_stream(
    spark: SparkSession,
    folder: str,
    out: str,
    state: str,
    checkpoint: str,
    label: Callable[[DataFrame], DataFrame],
    params: GridParams = GridParams(),
    commands: DataFrame | None = None,
    link_tier: int | None = None,
    pack: bool = True,
    files_per_batch: int = 64,
    once: bool = False,
    rates: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Raw scans under `folder`, a folder per drive, to packed frames (or cells) in `out`.

    `label` turns raw points (frame_id, point_idx, x, y, z, intensity) into labelled ones (with cls and
    conf), by a model or otherwise. Settings come from the stream
    `commands` (drive, seq, setting, value), `link_tier` holds until one sets it. `rates` is called per batch.

    A frame's id is its drive's number times 2**FRAME_BITS plus its own, so the frames of the first drive are
    0, 1, 2 and so on. `state` remembers the drives and what each batch numbered; `frames_of` reads it. A
    batch lists its own files on the driver, `files_per_batch` at most.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Written before anything else reads it: state is updated once per batch.
        write_batch(batch, f"{state}/frames", batch_id)
        told = spark.read.schema(batch.schema).parquet(f"{state}/frames/batch_id={batch_id}")
        drives = _drive_numbers(spark, told, state, batch_id)
        frame_id = F.shiftleft("drive_no", FRAME_BITS) + F.col("number")
        frames = told.join(drives, "drive").withColumn("frame_id", frame_id)
        paths = [r.path for r in frames.select("path").collect()]
        if not paths:
            return
        files = spark.read.format("binaryFile").load(paths).select("path", "content")
        points = parse_scans(files.join(F.broadcast(frames.select("path", "frame_id")), "path")).drop("path")
        held = as_held(frames)
        full, link = build_cells(label(points), params, held=held)
        if pack:
            tails = frame_tails(full, link, params, held, rates() if rates is not None else None)
            link = packed_link(full, link, tails, params)
        write_version(link, out, batch_id)

    numbered = numbered_frames(spark, folder, params, commands, files_per_batch, link_tier)
    writer = numbered.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def frames_of(spark: SparkSession, state: str) -> DataFrame:
    """drive, path, number, frame_id of every frame a scan stream has numbered."""
    drives = spark.read.parquet(f"{state}/drives").select("drive", "drive_no")
    frames = spark.read.parquet(f"{state}/frames").select("drive", "path", "number")
    return frames.join(drives, "drive").select(
        "drive", "path", "number", (F.shiftleft("drive_no", FRAME_BITS) + F.col("number")).alias("frame_id")
    )


def latest(spark: SparkSession, out: str) -> DataFrame:
    """What a stream wrote, each frame in its last version (`versions.newest_frames`)."""
    return newest_frames(spark, out)
