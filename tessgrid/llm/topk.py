"""Exact top-k by inner product with a pivot-distance index.

With one more coordinate, sqrt(M - |x|**2), all vectors get the same length, and the largest inner
products with a query are its nearest neighbours. Every vector is keyed by its nearest pivot and its
distance to it. A query at distance d from a pivot and within r of its k-th best can find better vectors
only at distances d - r to d + r from that pivot: the annuli outside are never read, those inside are
expanded from d outwards until the triangle inequality ends the search.

Annuli are cut into chunks of bounded size by id hash where they are crowded, so a vector that a third
of all rows repeat is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import stored

#: Pivots, and rows whose scores give each query its first bound: bounded samples in order of id hash.
PIVOTS, SEEDS = 32, 2048
#: Annuli per pivot at most (by equal steps of distance), rows per chunk, and queries per search.
RINGS, CHUNK, QUERIES = 64, 8192, 1024
SCALE = 1024


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component. Vectors that are null, empty of numbers, or hold
    null or non-finite components are left out."""
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows as float64, short ones filled with zeros. Exact while products stay below 2**53."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.array(column.value_lengths())
    if len(ends) and (ends == dims).all():
        return flat.astype(np.float64).reshape(-1, dims)
    out = np.zeros((len(ends), dims))
    starts = np.cumsum(ends) - ends
    for i, (a, n) in enumerate(zip(starts, ends)):
        out[i, :n] = flat[a : a + n]
    return out


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """The same rows as they are."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.array(column.value_lengths())
    out = np.zeros((len(ends), dims), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(ends)), ends)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


_LONGS = np.iinfo(np.int64)


def _exact_scores(x: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of integers as LONGs; what is beyond a LONG becomes the nearest."""
    if longest < 2**62:
        return x @ q
    return np.array([min(max(s, _LONGS.min), _LONGS.max) for s in x.astype(object) @ q.astype(object)], np.int64)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


class Index:
    """What every task knows: the length bound, dimensions, pivots and seed rows. All are bounded."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = rows.agg(F.max(square).alias("longest"), F.max(F.size("v")).alias("dims")).first()
        self.longest, self.dims = facts["longest"] or 0.0, facts["dims"] or 0
        #: Doubles hold the products of vectors up to this length; beyond it scores are made of integers.
        self.wide = self.longest >= 2**52
        seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()
        self.seed_ids = np.array([r["vec_id"] for r in seeds], np.int64)
        self.seeds = np.zeros((len(seeds), self.dims))
        for i, r in enumerate(seeds):
            self.seeds[i, : len(r["v"])] = r["v"]
        self.pivots = _lifted(np.unique(self.seeds[:PIVOTS], axis=0), self.longest)
        # Far wider than the error of distances in double precision.
        self.slack = 1e-6 * (1 + self.longest**0.5)

    def ring(self, distance: np.ndarray) -> np.ndarray:
        """Equal steps up to the largest distance there can be, twice the common length."""
        width = max(2 * self.longest**0.5 / RINGS, 1e-9)
        return np.minimum(distance / width, RINGS - 1).astype(np.int32)


def keyed(rows: DataFrame, index: Index) -> DataFrame:
    """pivot, ring, distance, vec_id, v, chunk: every vector under its nearest pivot."""
    told = index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _distances(_lifted(_matrix(batch.column(1), told.dims), told.longest), told.pivots)
            pivot = found.argmin(axis=1)
            distance = found[np.arange(len(found)), pivot]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot, pa.int32()), pa.array(told.ring(distance), pa.int32()), pa.array(distance),
                 batch.column(0), batch.column(1)],
                ["pivot", "ring", "distance", "vec_id", "v"],
            )

    placed = stored(rows.mapInArrow(run, "pivot int, ring int, distance double, vec_id long, v array<long>"))
    crowded = placed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    return placed.join(F.broadcast(crowded), ["pivot", "ring"]).withColumn(
        "chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    )


def _asked(queries: DataFrame, index: Index, directory: list[tuple], k: int) -> DataFrame:
    """query rows once per chunk they must look into: pivot, ring, chunk, block, query_id, q, bound.

    `directory`: pivot, ring, chunks, nearest, farthest of every annulus, at most PIVOTS * RINGS rows.
    The bound is the k-th best score among the seed rows.
    """
    told = index
    schema = "pivot int, ring int, chunk long, query_id long, q array<long>, bound double, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, ring, chunks, near, far = (np.array(c) for c in zip(*directory))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = _matrix(batch.column(1), told.dims)
            scores = x @ told.seeds.T
            scores[ids[:, None] == told.seed_ids] = -np.inf
            bound = np.full(len(x), -np.inf)
            if len(told.seed_ids) > k:
                bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            if told.wide:
                bound = bound - 1e-9 * np.abs(bound) - 1
            length = (x * x).sum(axis=1)
            reach = np.sqrt(np.maximum(length + told.longest - 2 * bound, 0)) + told.slack
            lifted = np.hstack([x, np.zeros((len(x), 1))])
            from_pivots = _distances(lifted, told.pivots)
            for i in range(len(x)):
                d = from_pivots[i, pivot]
                at = np.flatnonzero((d - reach[i] <= far) & (d + reach[i] >= near))
                repeat = np.repeat(at, chunks[at])
                n = len(repeat)
                if not n:
                    continue
                chunk = np.arange(n) - np.repeat(np.cumsum(chunks[at]) - chunks[at], chunks[at])
                one = batch.column(1).slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot[repeat], pa.int32()), pa.array(ring[repeat], pa.int32()), pa.array(chunk, pa.int64()),
                     pa.array(np.full(n, ids[i])), one.take(pa.array(np.zeros(n, np.int64))),
                     pa.array(np.full(n, bound[i])), pa.array(d[repeat])],
                    ["pivot", "ring", "chunk", "query_id", "q", "bound", "distance"],
                )

    return queries.mapInArrow(run, schema)


def _expand(x: np.ndarray, ids: np.ndarray, distance: np.ndarray, q: np.ndarray, query_id: int, d: float,
            bound: float, longest: float, slack: float, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best k of one chunk, sorted by distance to its pivot, looked at outwards from distance d. With `exact`,
    x and q are integers."""
    best_s, best_i = np.zeros(0, np.int64 if exact else np.float64), np.zeros(0, np.int64)
    low = high = int(np.searchsorted(distance, d))
    length = q.astype(np.float64)
    base, step = float(length @ length) + longest, 256
    while True:
        reach = np.sqrt(max(base - 2 * bound, 0.0)) + slack if bound > -np.inf else np.inf
        left = max(np.searchsorted(distance, d - reach), low - step) if reach < np.inf else max(0, low - step)
        right = min(np.searchsorted(distance, d + reach, "right"), high + step) if reach < np.inf else min(len(ids), high + step)
        left, right = min(int(left), low), max(int(right), high)
        fresh = np.r_[left:low, high:right]
        if not len(fresh):
            return best_s, best_i
        low, high, step = left, right, step * 4
        fresh = fresh[ids[fresh] != query_id]
        scores = _exact_scores(x[fresh], q, longest) if exact else x[fresh] @ q
        keep = scores >= bound
        best_s, best_i = np.append(best_s, scores[keep]), np.append(best_i, ids[fresh[keep]])
        order = np.lexsort((best_i, ~best_s if exact else -best_s))[:k]
        best_s, best_i = best_s[order], best_i[order]
        if len(best_s) == k:
            least = float(best_s[-1])
            bound = max(bound, least - 1e-9 * abs(least) - 1 if exact else least)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k other rows of largest inner product,
    ties to the smaller vec_id, fewer if there are fewer. `rows`, `queries`: vec_id, v (longs).

    Vectors of different length are compared as if the shorter one went on with zeros. Rows repeated
    under one id count once per row. Scores of any LONG components are exact; one beyond a LONG is given as
    the nearest LONG, and such ones tie. An empty table gives no rows.
    """
    rows = stored(rows)
    index = Index(rows)
    if not index.dims:
        return rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0L AS score").where("false")
    placed = keyed(rows, index)
    directory = [
        tuple(r)
        for r in placed.groupBy("pivot", "ring")
        .agg(F.max("chunks"), F.min("distance"), F.max("distance"))
        .orderBy("pivot", "ring")
        .collect()
    ]
    asked = _asked(queries.select("vec_id", "v"), index, directory, k)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERIES))))
    asked = asked.withColumn("block", block)
    told = index

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("distance")
            rows_of = _integers if told.wide else _matrix
            x = rows_of(left.column("v").combine_chunks(), told.dims)
            ids, distance = left.column("vec_id").to_numpy(), left.column("distance").to_numpy()
            asks = rows_of(right.column("q").combine_chunks(), told.dims)
            names, bounds, ds = (right.column(c).to_numpy() for c in ("query_id", "bound", "distance"))
            for i, q in enumerate(asks):
                s, v = _expand(x, ids, distance, q, names[i], ds[i], bounds[i], told.longest, told.slack, k, told.wide)
                out.append((np.full(len(s), names[i]), v, s.astype(np.int64)))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*out)) or [(), (), ()])]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    # A block of queries meets a chunk once; chunks go to every block that asks for them.
    at = ["pivot", "ring", "chunk", "block"]
    wanted = asked.select(*[F.col(c).alias(f"_{c}") for c in at]).distinct()
    here = [F.col(c) == F.col(f"_{c}") for c in at[:3]]
    sides = placed.join(wanted, here).withColumnRenamed("_block", "block").select(*at, "distance", "vec_id", "v")
    found = sides.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(look, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
