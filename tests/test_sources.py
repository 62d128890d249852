import json

import numpy as np
import pytest

from tessgrid import dims
from tessgrid.operators import evidence
from tessgrid.sources import evidence as files
from tessgrid.sources import scans, sinks


@pytest.fixture(scope="module")
def scan_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scans")
    rng = np.random.default_rng(0)
    for name in ("b_000007.bin", "a_000012.bin", "c_000003.bin"):
        rng.uniform(-50, 50, (50, 4)).astype("<f4").tofile(folder / name)
    return folder


def test_scans_are_numbered_by_sorted_path(spark, scan_dir):
    points = scans.read_scans(spark, str(scan_dir))
    rows = points.collect()
    assert len(rows) == 150
    names = {r.frame_id: r.path.rsplit("/", 1)[1] for r in rows}
    assert names == {0: "a_000012.bin", 1: "b_000007.bin", 2: "c_000003.bin"}
    raw = np.fromfile(scan_dir / "b_000007.bin", "<f4").reshape(-1, 4)
    mine = sorted((r for r in rows if r.frame_id == 1), key=lambda r: r.point_idx)
    assert [r.x for r in mine] == raw[:, 0].astype(float).tolist()


def test_scans_identified_by_path(spark, tmp_path):
    for name in ("drive_a/000001.bin", "drive_b/000001.bin", "drive_b/last.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        np.ones((50, 4), "<f4").tofile(tmp_path / name)
    points = scans.read_scans(spark, str(tmp_path), "path")
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    got = points.groupBy("frame_id", "number").count().collect()
    assert sorted((str(r.number), r["count"]) for r in got) == [("1", 50), ("1", 50), ("None", 50)]
    ranked = scans.read_scans(spark, str(tmp_path)).groupBy("frame_id").count().collect()
    assert sorted((r.frame_id, r["count"]) for r in ranked) == [(0, 50), (1, 50), (2, 50)]


def test_no_scans_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scans.read_scans(spark, str(tmp_path))


def test_path_ranks_over_several_partitions(spark):
    paths = spark.createDataFrame([(f"p{i:04d}",) for i in range(500)], "path STRING").repartition(7)
    got = {r.path: r.frame_id for r in scans.path_ranks(paths).collect()}
    assert got == {f"p{i:04d}": i for i in range(500)}


def test_a_named_checkpoint_folder_is_kept(spark):
    scans.ensure_checkpoint_dir(spark)
    held = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    scans.ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == held


@pytest.fixture(scope="module")
def exports(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    full, bare, broken = (root / n for n in ("full", "bare", "broken"))
    for folder in (full, bare, broken):
        folder.mkdir()
    (full / "export.json").write_text(json.dumps({
        "generated": "then", "edge_board": "", "data_caveats": ["few scans"],
        "checks": {"A1.1": {"text": "tiles cover the root", "done": True}, "B2.4": {"text": "sizes stay in range", "done": False}, "A1.7": {"text": "counts add up"}},
        "ledger": [
            {"metric": "m_latency_ms", "value": 9.0, "tag": "edge", "command": "first", "hardware": "h1"},
            {"metric": "m_fps", "value": 11.0, "tag": "edge", "command": "second"},
            {"metric": "m_latency_ms", "value": 8.0, "tag": "edge", "command": "third", "hardware": "h3"},
            {"metric": "a_mIoU_b_mIoU_0-10m", "value": 1.0, "tag": "distance", "command": "d"},
        ],
        "baselines": {"one": {"name": "One", "checkpoint": "/c.pth"}, "two": {"name": "Two", "checkpoint": ""}},
    }))
    (full / "distance_stratified_a.json").write_text(
        json.dumps({"label": "run-a", "n_scans": 3, "command": "go", "summary": {"0-10m": {"mIoU_dataset": 7.5}, "far": {"mIoU_dataset": 4.5}}})
    )
    (full / "distance_stratified_b.json").write_text(json.dumps({"label": "SELFTEST_x", "summary": {"0-10m": {"mIoU_dataset": 99}}}))
    (full / "distance_stratified_c.json").write_text("{not json")
    (full / "ps_category_table_a.json").write_text(json.dumps({"rows": [
        {"ps_category": "walls", "seg_mIoU": 5.0, "seg_constituents": {"wall": "5", "fence": "6"}, "det_constituents": {"fence": "7", "gate": "8"}}
    ]}))
    (bare / "export.json").write_text(json.dumps({"ledger": [{"metric": "nomark", "value": 2.0, "tag": "distance", "command": "c"}]}))
    (broken / "export.json").write_text("][")
    read = files.read_evidence(spark, f"{root}/*/export.json").cache()
    runs = {
        prefix: files.for_exports(files.read_runs(spark, f"{root}/*/", prefix), read)
        for prefix in (files.CLASS_RUNS, files.DISTANCE_RUNS)
    }
    return read, runs


def _folder(path):
    return path.rsplit("/", 2)[1]


def test_evidence_reports(exports):
    read, runs = exports
    ledger = files.ledger_of(read)
    assert {_folder(r.export_path): r.available for r in read.collect()} == {"full": True, "bare": True, "broken": False}
    edge = evidence.edge_report(ledger).first()
    assert (edge.model, edge.latency_ms, edge.fps, edge.peak_mem_mb, edge.hardware, edge.command) == (
        "m", 8.0, 11.0, None, "h3", "third",
    )
    distance = evidence.distance_report(ledger, runs[files.DISTANCE_RUNS]).collect()
    got = {(_folder(r.export_path), r.label, r.band, r.miou) for r in distance}
    assert got == {("full", "run-a", "0-10m", 7.5), ("full", "run-a", "far", 4.5), ("bare", "", "nomark", 2.0)}
    split = evidence.distance_report(ledger).where("label != ''").first()
    assert (split.label, split.band) == ("a_mIoU_b", "0-10m")
    table = evidence.per_class_report(runs[files.CLASS_RUNS]).first()
    assert (table.label, table.category, table.constituents) == ("run", "walls", "wall 5, fence 7, gate 8")
    checks = evidence.checklist_rollup(files.checks_of(read)).collect()
    assert {r.phase: (r.done, r.total) for r in checks} == {"A1": (1, 2), "B2": (0, 1), None: (1, 3)}
    assert [r.key for r in evidence.named_baselines(read).collect()] == ["one"]
    assert {r.board for r in evidence.board(read).collect()} == {evidence.DEFAULT_BOARD}


def test_gaps_stay_gaps(exports):
    read, runs = exports
    proofs = evidence.proofs_of(
        read, runs[files.CLASS_RUNS], runs[files.DISTANCE_RUNS], files.ledger_of(read), files.checks_of(read)
    )
    rows = evidence.evidence_snapshot(read, proofs).collect()
    status = {(_folder(r.export_path), r.block): r.status for r in rows}
    assert {b for (f, b), s in status.items() if f == "full" and s == "measured"} == {
        "per_class", "distance", "edge", "baselines", "checklist",
    }
    assert {b for (f, b), s in status.items() if f == "bare" and s == "measured"} == {"distance"}
    assert status["broken", "edge"] == "not_measured" and status["broken", "checklist"] == "absent"
    assert all((r.missing is None) == (r.status == "measured") for r in rows)
    about = {_folder(r.export_path): r for r in rows}
    assert about["full"].data_caveats == ["few scans"] and about["full"].generated == "then"
    assert about["full"].board == evidence.DEFAULT_BOARD and not about["broken"].available


def test_level_table(spark):
    got = {r.level: (r.size_m, r.range_from_m, r.range_to_m) for r in dims.level_table(spark).collect()}
    assert got[12] == (0.05, 0, 19) and got[11] == (0.1, 20, 39) and got[10] == (0.2, 40, 79) and got[9] == (0.4, 80, 100)
    assert got[8] == (0.8, None, None) and got[7] == (1.6, None, None) and len(got) == 6


def test_cells_are_written_by_block_of_frames(spark, tmp_path):
    df = spark.range(10).selectExpr("id * 1000 AS frame_id")
    sinks.write_cells(df, str(tmp_path / "cells"), frames_per_folder=4096)
    assert sorted(p.name for p in (tmp_path / "cells").glob("frame_block=*")) == [f"frame_block={i}" for i in range(3)]
    many = spark.range(40_000, numPartitions=16).selectExpr("id % 8192 AS frame_id", "id AS code")
    sinks.write_cells(many, str(tmp_path / "many"), frames_per_folder=4096)
    assert len(list((tmp_path / "many").glob("frame_block=*/*.parquet"))) <= 4
