from collections import Counter, defaultdict

import pytest
from test_grid import P, cloud, random_rows

from tessgrid.operators import compare, decimate, grid

CELL = (
    "frame_id LONG, code LONG, level INT, x DOUBLE, y DOUBLE, z DOUBLE, z_min DOUBLE, z_max DOUBLE, cls INT, "
    "conf DOUBLE, driver INT, n_points LONG"
)


def cell(code, level, cls=1, driver=0, n=1, z=0.0, conf=1.0):
    return (0, code, level, 0.0, 0.0, z, z, z, cls, conf, driver, n)


def by_hand(cells, max_level, preserve):
    kept, groups = [], defaultdict(list)
    for c in cells:
        if c.level <= max_level or (preserve and c.driver != 0):
            kept.append((c.code, c.level, c.cls, c.driver, c.n_points, c.z))
        else:
            groups[c.code >> 2 * (12 - max_level)].append(c)
    for up, members in groups.items():
        votes = Counter()
        for c in members:
            votes[c.cls] += c.n_points
        n = sum(c.n_points for c in members)
        z = sum(c.z * c.n_points for c in members) / n
        cls = min(votes, key=lambda k: (-votes[k], k))
        kept.append((up << 2 * (12 - max_level), max_level, cls, 0, n, z))
    return sorted(kept)


@pytest.mark.parametrize("max_level", [11, 9, 8, 5, 2])
@pytest.mark.parametrize("preserve", [True, False])
def test_equals_merging_by_hand(spark, max_level, preserve):
    cells = grid.adaptive_grid(cloud(spark, random_rows(900, 21, spread=0.8)), P, keep_tile=True)
    got = decimate.decimate(cells, max_level, preserve, P).collect()
    want = by_hand(cells.collect(), max_level, preserve)
    assert len(got) == len(want)
    for c, w in zip(sorted((c.code, c.level, c.cls, c.driver, c.n_points, c.z) for c in got), want):
        assert c[:5] == w[:5] and c[5] == pytest.approx(w[5])


def test_weighted_tie_goes_to_the_smaller_class(spark):
    cells = spark.createDataFrame([cell(0, 12, cls=8, n=5), cell(1, 12, cls=3, n=5)], CELL)
    (only,) = decimate.decimate(cells, 11).collect()
    assert (only.cls, only.n_points, only.code, only.level) == (3, 10, 0, 11)


def test_everything_protected_comes_back_unchanged(spark):
    rows = [cell(5, 12, driver=1), cell(9, 12, driver=2), cell(1 << 20, 9)]
    cells = spark.createDataFrame(rows, CELL)
    got = decimate.decimate(cells, 9).select("code", "level", "driver").collect()
    assert sorted(map(tuple, got)) == sorted((r[1], r[2], r[10]) for r in rows)
    report = decimate.decimation_report(cells, 9).first()
    assert (report.merged_into, report.preserved_risk_cells, report.cells_after) == (0, 2, 3)


def test_preserved_cells_lie_inside_merged_ones_and_points_are_conserved(spark):
    cells = spark.createDataFrame([cell(0, 12, driver=1, n=2), cell(1, 12, n=3), cell(2, 12, n=4)], CELL)
    got = decimate.decimate(cells, 9).collect()
    assert sorted((c.level, c.n_points) for c in got) == [(9, 7), (12, 2)]


def test_nothing_finer_is_a_no_op_and_reports_nothing_preserved(spark):
    cells = spark.createDataFrame([cell(0, 9, driver=3), cell(64, 9)], CELL)
    report = decimate.decimation_report(cells, 9).first()
    assert (report.cells_before, report.cells_after, report.preserved_risk_cells) == (2, 2, 0)


def test_tier_per_frame(spark):
    cells = grid.adaptive_grid(cloud(spark, random_rows(300, 22)), P)
    settings = spark.createDataFrame([(0, 9, False)], "frame_id LONG, link_tier INT, preserve_risk BOOLEAN")
    own = decimate.decimate_asof(cells, settings, P)
    assert own.exceptAll(decimate.decimate(cells, 9, False, P)).isEmpty()
    as_built = spark.createDataFrame([(0, None, None)], settings.schema)
    assert decimate.decimate_asof(cells, as_built, P).count() == cells.count()


def test_hazards_get_finer_cells_than_range_alone_would_give(spark, small):
    from tessgrid.plans.inputs import points

    for frame in {r.frame_id for r in compare.ab_compare(points(spark, small), P).collect()}:
        rows = {r.scenario: r for r in compare.ab_compare(points(spark, small), P).where(f"frame_id = {frame}").collect()}
        risk, plain = rows["risk_adaptive"], rows["range_only"]
        assert plain.median_hazard_cell_m / risk.median_hazard_cell_m >= 2.0
        assert plain.cells_range == plain.n_cells
