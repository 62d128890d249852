"""All checks in one pass against the single checks."""

import pytest
from pyspark.sql import functions as F
from test_grid import P, SCHEMA, random_rows

from tessgrid.operators import grid, quality
from tessgrid.params import GridParams


def points(spark, spoil=None):
    rows = [[f, i, *map(float, r[:3]), r[3], float(r[4]), "t"] for f in range(3) for i, r in enumerate(random_rows(250, f))]
    if spoil:
        spoil(rows)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def singles(pts, params):
    cells = grid.adaptive_grid(pts, params)
    found = [
        quality.check_conservation(pts, cells, params), quality.check_points(pts),
        quality.check_containment(grid.assign_points(pts, params), params), quality.check_lattice(cells, params),
        quality.check_sizes(cells, params), quality.check_elevation(cells), quality.check_roundtrip(cells, params),
        quality.check_sparse(cells, params), quality.check_hazard_depth(cells),
    ]
    if not params.risk_adaptive:
        found.append(quality.check_range_only(cells))
    return sorted(tuple(r) for df in found for r in df.select("frame_id", "check", "violations").collect())


def bad_confidence(rows):
    rows[5][6] = 7.0


def two_sources(rows):
    rows[9][7] = "u"


def far_away_frame(rows):
    rows.append([9, 0, 500.0, 0.0, 0.0, 1, 0.5, "t"])


@pytest.mark.parametrize("spoil", [None, bad_confidence, two_sources, far_away_frame])
@pytest.mark.parametrize("risky", [True, False])
def test_one_pass_tells_what_single_checks_tell(spark, tmp_path, spoil, risky):
    params, pts = GridParams(risk_adaptive=risky), points(spark, spoil)
    found = quality.check_all(pts, str(tmp_path / "cells"), params)
    got = sorted(tuple(r) for r in found.violations.select("frame_id", "check", "violations").collect())
    assert got == singles(pts, params)
    assert found.totals["n_points"] == pts.count() and found.totals["unaccounted"] == 0
    assert found.totals["n_cells"] == spark.read.parquet(str(tmp_path / "cells")).count()


def test_points_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    pts = points(spark).where("abs(x) < 100 AND abs(y) < 100")
    counted = pts.mapInPandas(count, pts.schema)
    found = quality.check_all(counted, str(tmp_path / "cells"), P)
    assert found.violations.where("violations > 0 AND check <> 'hazard_depth'").count() == 0
    assert read.value == pts.count()


def test_empty_table(spark, tmp_path):
    found = quality.check_all(points(spark).where("frame_id < 0"), str(tmp_path / "cells"), P)
    assert found.violations.count() == 0 and found.totals["n_points"] == 0


def test_cell_checks_see_what_is_spoilt(spark):
    cells = grid.adaptive_grid(points(spark), P).withColumn("y", F.col("y") + 0.01)
    got = {(r.frame_id, r.check): r.violations for r in quality.cell_checks(cells, P).collect()}
    assert all(got[f, "lattice"] == r["count"] for f, r in ((r.frame_id, r) for r in cells.groupBy("frame_id").count().collect()))
