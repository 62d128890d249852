"""Windows read by code ranges, and budgets of cells."""

import random

import pytest
from pyspark.sql import functions as F
from test_grid import P, SCHEMA, random_rows

from tessgrid.operators import decimate, grid, mapviews
from tessgrid.sources import sinks

WINDOWS = [(-40.02, 60.01, -30.03, 45.02), (3.0, 3.0, -7.0, -7.0), (-500, 500, -500, 500), (500, 600, 0, 1), (0, 0.05, 0, 51.2)]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f, i, *map(float, r[:3]), r[3], float(r[4]), "t") for f in range(3) for i, r in enumerate(random_rows(900, f))]
    return grid.adaptive_grid(spark.createDataFrame(rows, SCHEMA), P, keep_tile=True).cache()


@pytest.mark.parametrize("window", WINDOWS)
@pytest.mark.parametrize("tier", [None, 3, 9])
def test_ranges_lose_no_cell(cells, window, tier):
    some = cells if tier is None else decimate.decimate(cells, tier, False, P)
    plain = some.where(mapviews._touches(*window, P))
    found = mapviews.viewport_cells(some, *window, P)
    assert found.count() == plain.count()
    assert found.select("frame_id", "code", "level").exceptAll(plain.select("frame_id", "code", "level")).isEmpty()


def test_ranges_cover_every_node_and_stay_few():
    rng = random.Random(2)
    for _ in range(40):
        x, y = (rng.uniform(-110, 100) for _ in range(2))
        window = (x, x + rng.uniform(0, 60), y, y + rng.uniform(0, 60))
        level = rng.choice([0, 2, 5, 7])
        ranges = mapviews.code_ranges(*window, level, P)
        assert len(ranges) <= mapviews.MAX_RANGES
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        size, shift = P.cell_size(level), 2 * (P.max_depth - level)
        for node in range(4**level):
            ix = sum((node >> (2 * i + 1) & 1) << i for i in range(level))
            iy = sum((node >> (2 * i) & 1) << i for i in range(level))
            west, south = ix * size - P.half_m, iy * size - P.half_m
            meets = west <= window[1] and west + size >= window[0] and south <= window[3] and south + size >= window[2]
            if meets:
                assert any(a <= node << shift and ((node + 1) << shift) - 1 <= b for a, b in ranges)


def _scanned(df):
    """Rows that the scan of a finished query gave out."""
    df.collect()

    def scans(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if plan.nodeName().startswith("Scan"):
            yield plan
        for i in range(plan.children().size()):
            yield from scans(plan.children().apply(i))
        if "QueryStage" in plan.nodeName():
            yield from scans(plan.plan())

    return sum(s.metrics().apply("numOutputRows").value() for s in scans(df._jdf.queryExecution().executedPlan()))


def test_stored_cells_outside_the_window_are_not_read(spark, cells, tmp_path):
    spark.conf.set("parquet.block.size", str(8 * 1024))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(8 * 1024))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.size", str(2 * 1024))
    path = str(tmp_path / "cells")
    try:
        sinks.write_cells(cells.drop("tile").coalesce(1), path)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.page.size")
        spark.conf.unset("parquet.block.size")
    stored = spark.read.parquet(path)
    window = (10.0, 20.0, 10.0, 20.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    seen = mapviews.viewport_cells(stored, *window, P)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(code," in plan.split("PushedFilters")[1]
    total = stored.count()
    assert _scanned(seen) < total / 3 and _scanned(stored.where("z IS NOT NULL OR z IS NULL")) == total


@pytest.mark.parametrize("budget", [0, 1, 7, 130, 10**6])
def test_budget_takes_the_first_cells_of_each_frame(cells, budget):
    got = mapviews.first_cells(cells, budget, P).select("frame_id", "code", "level").collect()
    want = []
    rows = cells.select("frame_id", "code", "level").collect()
    for frame in {r.frame_id for r in rows}:
        want += sorted(tuple(r) for r in rows if r.frame_id == frame)[:budget]
    assert sorted(map(tuple, got)) == sorted(want)


def test_budget_of_overlapping_cells(cells):
    mixed = decimate.decimate(cells, 8, True, P)
    got = mapviews.first_cells(mixed, 40, P).groupBy("frame_id").count().collect()
    assert all(r["count"] == 40 for r in got) and len(got) == 3


def test_lod_takes_a_budget(cells):
    seen = mapviews.viewport_lod(cells, -40, 40, -40, 40, 1000.0, params=P)
    some = mapviews.viewport_lod(cells, -40, 40, -40, 40, 1000.0, params=P, budget=5)
    assert some.count() == 15 and some.select(*seen.columns).exceptAll(seen).isEmpty()
    assert seen.groupBy("frame_id").count().where(F.col("count") > 5).count() == 3
