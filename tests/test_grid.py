import random
import re
from dataclasses import replace

import pytest
import reference_grid
from pyspark.sql import functions as F

from tessgrid.functions import spatial
from tessgrid.operators import grid, quality, stats
from tessgrid.params import GridParams

P = GridParams()
SCHEMA = "frame_id LONG, point_idx LONG, x DOUBLE, y DOUBLE, z DOUBLE, cls INT, conf DOUBLE, source STRING"


def cloud(spark, rows, frame=0):
    """rows: (x, y, z, cls, conf); the position is the index."""
    full = [(frame, i, float(x), float(y), float(z), c, float(k), "t") for i, (x, y, z, c, k) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def expected(rows, **settings):
    return reference_grid.build(
        [dict(point_idx=i, x=x, y=y, z=z, cls=c, conf=k) for i, (x, y, z, c, k) in enumerate(rows)], **settings
    )


def same(cells, want):
    got = sorted((r.asDict() for r in cells.collect()), key=lambda c: c["code"])
    exact = ("code", "level", "driver", "cls", "n_points")
    assert [[c[k] for k in exact] for c in got] == [[c[k] for k in exact] for c in want]
    for a, b in zip(got, want):
        for k in ("z", "z_min", "z_max", "conf"):
            assert a[k] == pytest.approx(b[k], abs=1e-9)


def random_rows(n, seed, spread=1.5, classes=(1, 1, 1, 4, 5, 40)):
    rng = random.Random(seed)
    centres = [(rng.uniform(-95, 95), rng.uniform(-95, 95)) for _ in range(6)]
    rows = []
    for _ in range(n):
        cx, cy = rng.choice(centres)
        x = round((cx + rng.uniform(-spread, spread)) / 0.05) * 0.05 + 0.013
        y = round((cy + rng.uniform(-spread, spread)) / 0.05) * 0.05 + 0.013
        rows.append((x, y, rng.uniform(-2, 1), rng.choice(classes), rng.choice([0.9, 0.95, 0.5])))
    return rows


@pytest.mark.parametrize("run_bits", [2, 5, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_recursive_descent_whatever_the_run_length(spark, seed, run_bits):
    rows = random_rows(1500, seed, spread=0.6)
    same(grid.adaptive_grid(cloud(spark, rows), replace(P, run_bits=run_bits)), expected(rows))


def test_range_only_equals_recursive_descent(spark):
    rows = random_rows(800, 3)
    same(grid.adaptive_grid(cloud(spark, rows), replace(P, risk_adaptive=False)), expected(rows, risk=False))


def test_one_cell_with_nearly_all_points(spark):
    """A hot finest cell is cut into runs; class changes inside and across them must survive."""
    rng = random.Random(9)
    rows = [(60.013, 0.013, rng.random(), rng.choice([1, 1, 1, 1, 4]), 0.9) for _ in range(2000)]
    rows += random_rows(100, 4)
    same(grid.adaptive_grid(cloud(spark, rows), replace(P, run_bits=4)), expected(rows))


def test_scenarios_equal_separate_builds(spark):
    rows = random_rows(700, 5)
    both = grid.scenario_grids(cloud(spark, rows), {"risk": P, "plain": replace(P, risk_adaptive=False)})
    same(both.where("scenario = 'risk'").drop("scenario"), expected(rows))
    same(both.where("scenario = 'plain'").drop("scenario"), expected(rows, risk=False))


def test_overrides_come_from_columns(spark):
    rows = random_rows(500, 6)
    points = cloud(spark, rows).withColumn("t", F.lit(0.4)).withColumn("h", F.lit(2.0))
    cells = grid.adaptive_grid(points, P, {"conf_threshold": "t", "hazard_factor": "h"})
    same(cells, expected(rows, threshold=0.4, hazard_factor=2.0))


def test_risk_switch_from_a_column(spark):
    rows = random_rows(500, 7)
    points = cloud(spark, rows).withColumn("r", F.lit(False))
    same(grid.adaptive_grid(points, P, {"risk_adaptive": "r"}), expected(rows, risk=False))


def test_coarse_leaves_move_the_tile_up(spark):
    p = replace(P, coarse_size_m=6.0, risk_adaptive=False)
    assert p.tile_level <= p.coarsest_leaf < 9
    points = cloud(spark, random_rows(400, 8))
    cells = grid.adaptive_grid(points, p)
    assert quality.check_conservation(points, cells, p).first()["violations"] == 0
    assert cells.agg(F.min("level")).first()[0] < 9


def test_edges_and_assignment_agree_with_cells(spark):
    rows = random_rows(900, 10, spread=0.4)
    points, p = cloud(spark, rows), replace(P, run_bits=3)
    flags = {r.point_idx: r.edge for r in grid.class_edges(points, p).collect()}
    ordered = sorted(
        (reference_grid.interleave(int((x + 102.4) / 0.05), int((y + 102.4) / 0.05)), i, c)
        for i, (x, y, _, c, _) in enumerate(rows)
    )
    for i, (_, idx, c) in enumerate(ordered):
        near = ordered[max(i - 1, 0) : i + 2]
        assert flags[idx] == any(q[2] != c for q in near)
    tally = grid.assign_points(points, p).groupBy("level", "node").count()
    cells = grid.adaptive_grid(points, p)
    assert sorted((r["count"]) for r in tally.collect()) == sorted(r.n_points for r in cells.collect())
    assert quality.check_containment(grid.assign_points(points, p), p).first()["violations"] == 0


def test_majority_tie_goes_to_the_smaller_class(spark):
    rows = [(5.013, 5.013, 0, c, 0.9) for c in (3, 3, 1, 1, 2)]
    assert [r.cls for r in grid.adaptive_grid(cloud(spark, rows)).collect()] == [1]


def test_nan_stays_in_its_cell(spark):
    rows = [(5.013, 5.013, float("nan"), 1, 0.9), (6.013, 6.013, 1.0, 1, float("nan")), (7.013, 7.013, 2.0, 1, 0.9)]
    got = {round(r.x): r for r in grid.adaptive_grid(cloud(spark, rows)).collect()}
    assert got[5].z != got[5].z and got[7].z == 2.0 and got[7].conf == 0.9 and got[6].z == 1.0


def test_strict_crop(spark):
    rows = [(102.4, 0, 0, 1, 0.9), (-102.4, 0, 0, 1, 0.9), (102.38, -102.38, 0, 1, 0.9), (float("nan"), 0, 0, 1, 0.9)]
    assert grid.adaptive_grid(cloud(spark, rows)).count() == 1


def test_both_rules_and_an_edge(spark):
    """A hazard that is also uncertain counts as hazard; an uncertain edge point keeps its reason."""
    both = grid.required_levels(cloud(spark, [(70.013, 0.013, 0, 40, 0.1)])).first()
    assert (both.level, both.priority) == (12, 3)
    pair = [(90.013, 0.013, 0, 1, 0.1), (90.063, 0.013, 0, 4, 0.9)]
    got = {r.point_idx: r for r in grid.required_levels(cloud(spark, pair)).collect()}
    assert (got[0].level, got[0].priority) == (11, 2)
    assert (got[1].level, got[1].priority) == (10, 1)


def test_a_fine_point_splits_its_siblings(spark):
    near, far = (90.013, 0.013), (90.263, 0.263)
    rows = [(*near, 0, 40, 0.9), (*far, 0, 40, 0.9), (90.063, 0.063, 0, 40, 0.9)]
    same(grid.adaptive_grid(cloud(spark, rows)), expected(rows))


def test_empty_input(spark):
    none = cloud(spark, [(200, 0, 0, 1, 0.9)])
    cells = grid.adaptive_grid(none)
    assert cells.count() == 0
    row = stats.frame_stats(cells, P, frames=none).first()
    assert row.n_cells == 0 and row.cells_by_level == {} and row.cell_size_min_m is None
    assert row.memory.reduction_vs_dense is None and row.memory.adaptive_bytes == 0


def test_an_index_out_of_range_is_an_error(spark):
    bad = cloud(spark, random_rows(5, 1)).withColumn("point_idx", F.col("point_idx") - 1)
    with pytest.raises(Exception, match="point_idx"):
        grid.adaptive_grid(bad).collect()


def test_frame_stats_maps(spark):
    cells = grid.adaptive_grid(cloud(spark, random_rows(600, 11, classes=(1, 40, 77))))
    row = stats.frame_stats(cells, P).first()
    assert sum(row.cells_by_level.values()) == row.n_cells == sum(row.cells_by_driver.values())
    assert set(row.cells_by_class) <= {"drivable", "pothole", "77"}
    assert row.memory.dense_uniform_cells == 16_000_000


def test_morton_against_a_bit_loop(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(4096), rng.randrange(4096)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "ix LONG, iy LONG")
    coded = df.withColumn("code", spatial.morton_encode(F.col("ix"), F.col("iy"), 12))
    x, y = spatial.morton_decode(F.col("code"), 12)
    for r in coded.select("*", x.alias("bx"), y.alias("by")).collect():
        assert r.code == reference_grid.interleave(r.ix, r.iy) and (r.bx, r.by) == (r.ix, r.iy)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_points_are_read_and_moved_once(spark, small):
    """Points are shuffled by run, runs by tile, and the tile summary twice (small). The summary and the
    cells read the same shuffle by tile, whatever columns a query goes on to use."""
    from tessgrid.plans.queries import QUERIES

    for name in ("adaptive_grid", "frame_stats", "ab_compare"):
        plan = final_plan(QUERIES[name](spark, small))
        assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1, name
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    plan = final_plan(QUERIES["adaptive_grid"](spark, small))
    # the reused shuffle is printed with what it reads
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 5
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_medians_and_checks_need_no_sort(spark, small):
    from tessgrid.plans.queries import QUERIES

    for name in ("ab_compare", "tier_matrix", "check_points"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, name


def test_generated_code_stays_small_enough_to_be_compiled(spark, small):
    """The JVM never compiles a method of more than 8,000 bytes; one such method makes a scan ten times
    slower."""
    import re

    from tessgrid.plans.queries import QUERIES

    debug = spark._jvm.org.apache.spark.sql.execution.debug
    codegen = getattr(getattr(debug, "package$"), "MODULE$")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("adaptive_grid", "class_edges", "ab_compare", "tier_matrix", "viewport_lod"):
            plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan()
            sizes = map(int, re.findall(r"maxMethodCodeSize:(\d+)", codegen.codegenString(plan)))
            assert max(sizes) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_one_sort_serves_every_window_of_a_tile(spark, small):
    from tessgrid.plans.inputs import points

    plan = grid.adaptive_grid(points(spark, small))._jdf.queryExecution().executedPlan().toString()
    by_tile = [line for line in plan.splitlines() if "Sort [frame_id" in line and "tile#" in line and "node_" in line]
    assert len(by_tile) == 1


def test_tasks_grow_with_the_points(spark, monkeypatch):
    from tessgrid.operators import compare, decimate, layout

    monkeypatch.setattr(layout, "POINTS_PER_TASK", 50)
    points = cloud(spark, random_rows(1000, 51))
    tasks = layout.tasks_for(points)
    assert tasks == 20 and layout.tasks_for(points.limit(400)) is None
    cells = grid.adaptive_grid(points, P, keep_tile=True, tasks=tasks)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(frame_id#\d+L?, tile#\d+L?, 20\)", plan)) >= 1
    assert re.search(r"hashpartitioning\(frame_id#\d+L?, code#\d+L?, run#\d+L?, 20\)", plan)

    def told(df):
        return sorted(map(str, df.select("frame_id", "code", "level", "cls", "driver", "n_points").collect()))

    assert told(cells) == told(grid.adaptive_grid(points, P))
    plain = replace(P, risk_adaptive=False)
    assert told(grid.adaptive_grid(points, plain, tasks=tasks)) == told(grid.adaptive_grid(points, plain))
    both = compare.ab_compare(points, P, tasks)
    assert sorted(map(str, both.collect())) == sorted(map(str, compare.ab_compare(points, P).collect()))
    # every tier from one pass, in the partitions the cells have
    tiers = decimate.link_tiers()
    every = decimate.decimate_tiers(cells, tiers, P)
    assert "square" not in every._jdf.queryExecution().executedPlan().toString()
    found = every.cache()
    for t in tiers[1:7:3]:
        assert told(found.where(F.col("tier") == t.name)) == told(decimate.decimate(cells, t.max_level, t.preserve_risk, P))


def test_frames_of_tile_edges_are_dealt_to_as_many_tasks(spark):
    points = cloud(spark, random_rows(300, 52))
    for found in (grid.adaptive_grid(points, P, tasks=21), grid.class_edges(points, P, 21)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(frame_id#\d+L?, 21\)", plan)
    told = [sorted(map(str, grid.class_edges(points, P, n).collect())) for n in (21, None)]
    assert told[0] == told[1]
