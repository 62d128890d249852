"""Shards along a Hilbert curve.

Metadata dimensions are quantised to a few bits each and combined into an index on a Hilbert curve:
documents that are close on the curve are close in every dimension. Runs of the curve order become
shards, so a filter on any of the dimensions touches few of them.

Ranks come from counts of curve cells, not from one global sort: totals of coarse cells (at most
2**COARSE_BITS rows), running counts inside a coarse cell, and row numbers inside a cell. A cell is cut
into 2**SPLIT_BITS parts by text hash, and the rows of a text with many copies by row, so a cell or a text
that holds a third of all rows is ranked by many tasks.

Equal texts take the place of the first of them, whatever their own source and language, and lie in a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import free_names, stored, whole_text
from tessgrid.operators.ordered import salted_join

#: Bits per dimension; three dimensions give a curve of 2**24 cells.
DIM_BITS = 8
COARSE_BITS, SPLIT_BITS = 16, 8
#: Copies of a text from which on they are split.
MANY = 256
N_SHARDS = 24


def category(column: str) -> Column:
    """A category as DIM_BITS bits of its hash; null has a value of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\x00"))), 64 - DIM_BITS)


def magnitude(x: Column) -> Column:
    """A count on a logarithmic scale, 8 steps per doubling."""
    return F.least(F.floor(F.log2(x.cast("double") + 1) * 8), F.lit(2**DIM_BITS - 1)).cast("long")


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points. `axes`: one row per dimension, values below 2**bits.

    From the top bit down, each bit plane is expressed in the orientation the curve has there: reflect or
    swap the lower bits by what the plane says, then read the planes as a Gray code.
    """
    x = axes.astype(np.int64).copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            on = (x[d] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> bit) & 1 == 1, flip ^ ((1 << bit) - 1), flip)
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> bit) & 1)
    return index


def hilbert(*dims: Column) -> Column:
    """Curve index of the given dimensions, each below 2**DIM_BITS."""

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        axes = np.stack([c.to_numpy(dtype=np.int64) for c in columns])
        return pd.Series(curve_index(axes, DIM_BITS))

    return index(*dims)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds `rank`, 0 up, in order of (curve, part, text, doc_id), and `total`. Needs curve and part."""
    cells = rows.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("coarse", F.shiftright("curve", 3 * DIM_BITS - COARSE_BITS))
    totals = cells.groupBy("coarse").agg(F.sum("n").alias("n"))
    before = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("coarse").alias("_coarse"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("coarse_start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    inside = (
        Window.partitionBy("coarse").orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = cells.join(F.broadcast(starts), F.col("coarse") == F.col("_coarse")).select(
        "curve",
        "part",
        "total",
        (F.col("coarse_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"),
    )
    within = Window.partitionBy("curve", "part").orderBy("text_hash", "doc_id", "text_crc32", "size")
    return (
        rows.join(placed.hint("merge"), ["curve", "part"])
        .withColumn("rank", F.col("start") + F.row_number().over(within) - 1)
    )


def shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every document, under the law
    `rows`: shard counts differ by one at most.

    Dimensions: source, lang and text length. Equal texts go by source and lang of the one with the smallest
    doc_id (null first), and lie next to each other; of their groups only those that one of the n_shards - 1
    borders falls into are parted, as counts may not differ. Null texts are empty texts, of size 8; null
    source or lang is a category of its own. Rows repeated under one id get slots of their own. Fewer
    documents than shards leave some shards empty.
    """
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.shiftleft(category("source"), DIM_BITS).bitwiseOR(category("lang")).alias("own"),
            magnitude(F.octet_length(text)).alias("length"),
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - SPLIT_BITS).alias("spread"),
        )
    )
    groups = rows.groupBy("text_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "own"))["own"].alias("home")
    )
    told = salted_join(rows, groups.where("copies > 1"), ["text_hash"], F.col("spread"))
    home = F.coalesce("home", "own")
    text_part = F.shiftleft(F.shiftrightunsigned("text_hash", 64 - SPLIT_BITS), SPLIT_BITS)
    placed = stored(
        told.select(
            "doc_id", "size", "text_crc32", "text_hash",
            text_part.bitwiseOR(F.when(F.col("copies") > MANY, F.col("spread")).otherwise(0)).alias("part"),
            hilbert(
                F.shiftright(home, DIM_BITS), home.bitwiseAND(F.lit(2**DIM_BITS - 1)), F.col("length")
            ).alias("curve"),
        )
    )
    shard = F.expr(f"rank * {n_shards} DIV total")
    first = F.expr(f"(shard * total + {n_shards - 1}) DIV {n_shards}")
    return (
        ranked(placed)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
            F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Documents as Parquet, one folder per shard. A shard is cut along its curve order into files, whose
    footers then hold narrow ranges of every dimension. The columns `shard`, `slot` and `curve` are added,
    with an underscore behind them where the documents have such columns."""
    shard, slot, curve, place = free_names(docs.columns, "shard", "slot", "curve", "_place")
    # Ids may repeat or be null: rows are joined by their number, in a stored copy.
    rows = stored(docs.withColumn(place, F.monotonically_increasing_id()))
    numbered = rows.select(F.col(place).alias("doc_id"), "text", "source", "lang")
    placed = shards(numbered, n_shards).select(
        F.col("doc_id").alias(place), F.col("shard").alias(shard), F.col("slot").alias(slot), F.col("curve").alias(curve)
    )
    (
        rows.join(placed.hint("merge"), place)
        .drop(place)
        .repartitionByRange(shard, slot)
        .sortWithinPartitions(shard, slot)
        .write.partitionBy(shard)
        .parquet(path)
    )
