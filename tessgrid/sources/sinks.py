"""Writing cells and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cells(cells: DataFrame, path: str, frames_per_folder: int = 4096, mode: str = "overwrite") -> None:
    """Parquet, one folder per block of consecutive frames, so that readers prune by frame without a
    folder for each. Rows are gathered by block before they are written, a few files per folder; a block
    that is large is split over several tasks."""
    block = F.floor(F.col("frame_id") / frames_per_folder).cast("long")
    gathered = cells.withColumn("frame_block", block).hint("rebalance", "frame_block")
    order = [c for c in ("frame_block", "code", "frame_id") if c in gathered.columns]
    gathered = gathered.sortWithinPartitions(*order)
    gathered.write.mode(mode).partitionBy("frame_block").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch into its own folder, replaced on a retry, so a replayed batch changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
