"""The scan source against the reader that takes whole files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessgrid.sources import scan_source, scans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("scans")
    rng = np.random.default_rng(3)
    for drive in ("a", "b"):
        (at / drive).mkdir()
        for i, n in enumerate((1000, 0, 2500)):
            rng.uniform(-40, 40, (n, 4)).astype("<f4").tofile(at / drive / f"{i:06d}.bin")
    (at / "a" / "notes.txt").write_text("no scan")
    (at / "a" / "unnumbered.bin").write_bytes(np.zeros((3, 4), "<f4").tobytes())
    return str(at)


@pytest.mark.parametrize("split", [700, 10**6])
def test_same_rows_as_whole_files(spark, folder, split):
    got = scan_source.scan_points(spark, folder, split)
    want = scans.read_scans(spark, folder, "path")
    columns = ["frame_id", "point_idx", "x", "y", "z", "intensity", "path", "number"]
    assert got.count() == want.count() == 7003
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty()


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    n = 10_000_000
    np.arange(4 * n, dtype="<f4").tofile(tmp_path / "000001.bin")
    points = scan_source.scan_points(spark, str(tmp_path), 1 << 21)
    sums = points.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("point_idx").alias("low"))
    found = sorted((r.low, r.n) for r in sums.collect())
    assert len(found) == 5 and sum(k for _, k in found) == n
    assert [low for low, _ in found] == [i << 21 for i in range(5)]
    at = points.where("point_idx IN (0, 2097151, 2097152, 9999999)").select("point_idx", "x").collect()
    assert {r.point_idx: r.x for r in at} == {i: float(np.float32(4 * i)) for i in (0, 2097151, 2097152, 9999999)}


def test_filters_choose_files(spark, folder):
    scan_source.register_scans(spark)
    points = spark.read.format(scan_source.NAME).load(folder)
    some = points.where("number >= 1 AND number < 3 AND x > 0")
    assert some.where("number <> 2").count() == 0
    assert some.count() == scans.read_scans(spark, folder, "path").where("number IN (1, 2) AND x > 0").count()
    assert some.rdd.getNumPartitions() == 2, "the empty and the unread files are no partitions"
    one = points.where(F.col("path") == points.where("number = 0").select(F.max("path")).first()[0])
    assert one.count() == 1000
    assert points.where("number = 77").count() == 0


def test_a_broken_file_is_told(spark, tmp_path):
    (tmp_path / "000001.bin").write_bytes(b"x" * 17)
    with pytest.raises(Exception, match="whole number of points"):
        scan_source.scan_points(spark, str(tmp_path)).count()
