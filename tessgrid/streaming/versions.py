"""Which stored version of a frame counts: a manifest beside what a stream writes.

A batch writes its rows to `batch_id=N` and the frames it holds to `_frames/batch_id=N`. A frame's rows are
those of the newest folder that lists it, so reading opens the folders that still count and no other.

`compact` gathers what counts into one new folder and then writes `_manifest/version=K`, which says for each
frame where its rows are, and up to which batch it speaks. A version counts once Spark has marked it
complete; until then, and after a failure, everything reads as before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessgrid.sources.sinks import write_batch

_FRAMES = "frame_id long, batch_id long"
_PLACES = "frame_id long, folder string, batch_id long, upto long"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def write_version(df: DataFrame, out: str, batch_id: int) -> None:
    """One batch's rows, and the list of frames in them. A replay writes both anew."""
    write_batch(df, out, batch_id)
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{out}/batch_id={batch_id}")
    write_batch(rows.select(F.col("frame_id").cast("long")).distinct(), f"{out}/_frames", batch_id)


def _version(spark: SparkSession, out: str) -> int:
    """The newest complete version of the manifest, 0 if there is none."""
    found = [int(n.split("=")[1]) for n in _names(spark, f"{out}/_manifest") if n.startswith("version=")]
    done = [k for k in found if "_SUCCESS" in _names(spark, f"{out}/_manifest/version={k}")]
    return max(done, default=0)


def places(spark: SparkSession, out: str) -> DataFrame:
    """frame_id, folder, batch_id: where the rows of each frame are that count, and which batch wrote them."""
    version, upto = _version(spark, out), -1
    known = spark.createDataFrame([], _PLACES)
    if version:
        known = spark.read.schema(_PLACES).parquet(f"{out}/_manifest/version={version}")
        upto = known.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
    new = spark.createDataFrame([], _FRAMES)
    if any(n.startswith("batch_id=") for n in _names(spark, f"{out}/_frames")):
        new = spark.read.schema(_FRAMES).parquet(f"{out}/_frames").where(F.col("batch_id") > upto)
    folder = F.concat(F.lit("batch_id="), F.col("batch_id").cast("string"))
    every = known.select("frame_id", "folder", "batch_id").unionByName(new.select("frame_id", folder.alias("folder"), "batch_id"))
    return every.groupBy("frame_id").agg(F.max(F.struct("batch_id", "folder")).alias("p")).select(
        "frame_id", "p.folder", "p.batch_id"
    )


def newest_frames(spark: SparkSession, out: str) -> DataFrame:
    """What a stream wrote, each frame in its last version, with the batch that wrote it. Folders that hold
    no such frame are not opened."""
    placed = places(spark, out)
    folders = sorted(r.folder for r in placed.select("folder").distinct().collect())
    if not folders:
        raise FileNotFoundError(f"no frames under {out}")
    rows = None
    for folder in folders:
        some = spark.read.parquet(f"{out}/{folder}").drop("batch_id").withColumn("_folder", F.lit(folder))
        rows = some if rows is None else rows.unionByName(some)
    where = placed.withColumnsRenamed({"folder": "_folder"})
    return rows.join(where, ["frame_id", "_folder"]).drop("_folder")


def compact(spark: SparkSession, out: str) -> int:
    """Gather the rows that count into one folder and say so in a new version of the manifest. Returns its
    number. One compaction runs at a time; batches may go on arriving, they count after it."""
    placed = places(spark, out)
    upto = placed.agg(F.max("batch_id")).first()[0]
    if upto is None:
        raise FileNotFoundError(f"no frames under {out}")
    # What arrives from here on is left to the next time.
    placed = placed.where(F.col("batch_id") <= upto)
    folder, version = f"compact-{uuid.uuid4().hex}", _version(spark, out) + 1
    rows = newest_frames(spark, out).where(F.col("batch_id") <= upto).drop("batch_id")
    rows.sortWithinPartitions("frame_id").write.parquet(f"{out}/{folder}")
    told = placed.select("frame_id", F.lit(folder).alias("folder"), "batch_id", F.lit(upto).cast("long").alias("upto"))
    told.coalesce(1).write.mode("overwrite").parquet(f"{out}/_manifest/version={version}")
    return version


def unused_folders(spark: SparkSession, out: str) -> list[str]:
    """Folders of rows that no frame counts from, which may be deleted once no reader has them open."""
    used = {r.folder for r in places(spark, out).select("folder").distinct().collect()}
    return sorted(n for n in _names(spark, out) if n.startswith(("batch_id=", "compact-")) and n not in used)
