import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_grid import P, SCHEMA, random_rows

from tessgrid.operators import decimate, grid, telemetry
from tessgrid.sources import frames, scans
from tessgrid.streaming import grid_stream, keyed_state, telemetry_stream, versions


@pytest.fixture(scope="module")
def frame_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("points")
    for frame in range(3):
        rows = [(frame, i, *map(float, r[:3]), r[3], float(r[4]), "t") for i, r in enumerate(random_rows(300, 50 + frame))]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def run(spark, arriving, out, tmp, **options):
    query = grid_stream.start_grid_stream(arriving, out, str(tmp / "checkpoint"), P, once=True, **options)
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, frame_files, tmp_path):
    source = grid_stream.stream_points(spark, frame_files, files_per_batch=1)
    got = run(spark, source, str(tmp_path / "out"), tmp_path, link_tier=9)
    want = decimate.decimate(grid.adaptive_grid(spark.read.parquet(frame_files), P), 9, True, P)
    assert got.select("batch_id").distinct().count() == 3
    shown = ["frame_id", "code", "level", "cls", "driver", "n_points"]
    assert got.count() == want.count() and got.select(*shown).exceptAll(want.select(*shown)).isEmpty()


def test_scan_stream_with_a_model_packs_frames(spark, tmp_path):
    folder = tmp_path / "scans"
    folder.mkdir()
    rng = np.random.default_rng(1)
    for i in range(3):
        rng.uniform(-40, 40, (50, 4)).astype("<f4").tofile(folder / f"{i:06d}.bin")
    raw = grid_stream.stream_scans(spark, str(folder), files_per_batch=1)
    labelled = raw.withColumn("cls", F.lit(1)).withColumn("conf", F.lit(0.9))
    labelled = labelled.withColumn("frame_id", F.col("number"))  # one folder: numbers identify frames
    commands = spark.createDataFrame([(1, "compress", 0.0), (2, "hz", 4.0)], "seq LONG, setting STRING, value DOUBLE")
    packed = run(spark, labelled, str(tmp_path / "out"), tmp_path, pack=True, commands=lambda: commands)
    got = {r.frame_id: r for r in packed.collect()}
    assert set(got) == {0, 1, 2}
    assert [got[i].wire_bytes < got[i].raw_bytes for i in range(3)] == [True, False, False]
    assert [got[i].hz for i in range(3)] == [10.0, 10.0, 4.0]
    heads = {r.frame_id: json.loads(r.tail) for r in frames.frame_headers(packed).collect()}
    assert all(heads[i]["link"]["n_cells"] == got[i].n_cells == heads[i]["onboard"]["n_cells"] for i in got)
    assert got[2].kbps == round(got[2].wire_bytes * 32 / 1000, 1)
    batch = scans.read_scans(spark, str(folder), "rank").withColumn("cls", F.lit(1)).withColumn("conf", F.lit(0.9))
    assert frames.unpack_frames(packed).count() == grid.adaptive_grid(batch, P).count()


def test_settings_in_force_per_frame(spark, frame_files, tmp_path):
    commands = spark.createDataFrame(
        [(1, "risk_adaptive", 0.0), (2, "risk_adaptive", 1.0), (2, "link_tier", 9.0)],
        "seq LONG, setting STRING, value DOUBLE",
    )
    source = grid_stream.stream_points(spark, frame_files, files_per_batch=3)
    got = run(spark, source, str(tmp_path / "out"), tmp_path, commands=lambda: commands)
    points = spark.read.parquet(frame_files)
    built = grid.adaptive_grid(points, P)
    plain = grid.adaptive_grid(points, grid.GridParams(risk_adaptive=False))
    want = (
        built.where("frame_id = 0")
        .unionByName(plain.where("frame_id = 1"))
        .unionByName(decimate.decimate(built.where("frame_id = 2"), 9, True, P))
    )
    shown = ["frame_id", "code", "level", "cls", "driver", "n_points"]
    assert got.count() == want.count() and got.select(*shown).exceptAll(want.select(*shown)).isEmpty()


def test_a_frame_in_two_files_is_rebuilt_whole(spark, tmp_path):
    folder = str(tmp_path / "points")
    rows = [(i % 2, i, *map(float, r[:3]), r[3], float(r[4]), "t") for i, r in enumerate(random_rows(300, 61))]
    for part in (rows[:170], rows[170:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    arriving = grid_stream.stream_points(spark, folder, files_per_batch=1)
    out = str(tmp_path / "out")
    run(spark, arriving, out, tmp_path, source=lambda: spark.read.parquet(folder))
    got = grid_stream.latest(spark, out)
    want = grid.adaptive_grid(spark.read.parquet(folder), P)
    shown = ["frame_id", "code", "level", "cls", "driver", "n_points"]
    assert got.count() == want.count() and got.select(*shown).exceptAll(want.select(*shown)).isEmpty()


def finished(query):
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def label(raw):
    """Stands for a model: depends on a point alone."""
    return raw.withColumns({"cls": F.when(F.col("z") > 20, 7).otherwise(1), "conf": F.lit(0.5) + F.col("intensity") / 100})


def write_scans(folder, numbers, seed):
    folder.mkdir(parents=True, exist_ok=True)
    rng = np.random.default_rng(seed)
    for i in numbers:
        rng.uniform(-40, 40, (60, 4)).astype("<f4").tofile(folder / f"{i:06d}.bin")


def batch_packed(spark, folder, commands):
    """Packed frames of a folder by the batch operators, numbered by sorted path."""
    raw = scans.read_scans(spark, str(folder), "rank").drop("path", "number")
    held = grid_stream.settings_of_frames(raw.select("frame_id").distinct(), commands, P)
    full, link = grid_stream.build_cells(label(raw), P, held=held)
    return grid_stream.packed_link(full, link, grid_stream.frame_tails(full, link, P, held), P)


COMMANDS = "drive STRING, seq LONG, setting STRING, value DOUBLE"


def test_raw_scans_to_packed_frames_over_batches_and_a_restart(spark, tmp_path):
    scans_at, commands_at = tmp_path / "scans" / "a", str(tmp_path / "commands")
    drive = f"file:{scans_at}"
    given = [(1, "link_tier", 6.0), (3, "link_tier", None), (2, "risk_adaptive", 0.0), (4, "compress", 0.0), (4, "hz", 4.0)]
    rows = spark.createDataFrame([(drive, *c) for c in given], COMMANDS)
    rows.coalesce(1).write.parquet(commands_at)
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "checkpoint"))

    def run_once():
        commands = spark.readStream.schema(COMMANDS).parquet(commands_at)
        return finished(grid_stream.start_scan_stream(
            spark, str(tmp_path / "scans"), out, state, checkpoint, label, P, commands, files_per_batch=2, once=True
        ))

    write_scans(scans_at, range(3), 1)
    run_once()
    write_scans(scans_at, range(3, 6), 2)
    run_once()
    got = {r.frame_id: r for r in spark.read.parquet(out).collect()}
    want = {r.frame_id: r for r in batch_packed(spark, tmp_path / "scans", rows).collect()}
    assert set(got) == set(want) == set(range(6))
    assert len({r.batch_id for r in got.values()}) >= 3
    for i, row in want.items():
        assert bytes(got[i].wire) == bytes(row.wire) and got[i].kbps == row.kbps and got[i].error is None
    assert got[4].kbps != got[3].kbps


def test_drives_are_numbered_apart(spark, tmp_path):
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "checkpoint"))
    for name, n in (("b", 2), ("a", 1), ("c", 3)):
        write_scans(tmp_path / "scans" / name, range(n), 3)

    def run_once():
        finished(grid_stream.start_scan_stream(
            spark, str(tmp_path / "scans"), out, state, checkpoint, label, P, pack=False, once=True
        ))

    run_once()
    write_scans(tmp_path / "scans" / "aa", range(2), 4)
    write_scans(tmp_path / "scans" / "c", range(3, 5), 5)
    run_once()
    found = {(r.drive.rsplit("/", 1)[1], r.path.rsplit("/", 1)[1]): r for r in grid_stream.frames_of(spark, state).collect()}
    numbers = {k: (r.frame_id >> grid_stream.FRAME_BITS, r.number) for k, r in found.items()}
    assert [numbers[n, "000000.bin"][0] for n in ("a", "b", "c", "aa")] == [0, 1, 2, 3]
    assert all(number == int(path[:6]) for (_, path), (_, number) in numbers.items()) and len(numbers) == 10
    cells = spark.read.parquet(out).select("frame_id").distinct().collect()
    assert {r.frame_id for r in cells} == {r.frame_id for r in found.values()}


def test_settings_of_any_frame_number(spark):
    """Frame ids hashed from paths fill 64 bits."""
    ids = [-(2**63), -5, 2**62, 2**63 - 1]
    frames = spark.createDataFrame([(i,) for i in ids], "frame_id LONG")
    commands = spark.createDataFrame([(-5, "link_tier", 9.0), (2**63 - 1, "link_tier", None)], "seq LONG, setting STRING, value DOUBLE")
    held = {r.frame_id: r.link_tier for r in grid_stream.settings_of_frames(frames, commands, P).collect()}
    assert held == {ids[0]: None, ids[1]: 9, ids[2]: 9, ids[3]: None}


LOG = "stream_id LONG, seq LONG, setting STRING, value DOUBLE"


def settings_stream(spark, folder, out, checkpoint, defaults):
    keyed_state.use_keyed_state(spark)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    schema = "stream_id long, seq long, " + ", ".join(f"{s} double" for s in telemetry.SETTINGS)
    told = log.groupBy("stream_id").transformWithState(
        keyed_state.Settings(telemetry.SETTINGS, defaults), schema, "Append", "None"
    )
    writer = told.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return finished(writer.trigger(availableNow=True).start(out))


def test_settings_state_does_not_grow_with_the_log(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    old = spark.range(100_000).selectExpr(
        "0L AS stream_id", "id * 2 AS seq",
        "CASE id % 3 WHEN 0 THEN 'hz' WHEN 1 THEN 'link_tier' ELSE 'compress' END AS setting",
        "CASE WHEN id % 6 = 1 THEN NULL ELSE CAST(id AS DOUBLE) END AS value",
    )
    frames = [(0, 2 * k + 1, None, None) for k in (0, 500, 99_000, 99_999)]
    frames_later = [(0, 200_001 + k, None, None) for k in range(5)] + [(0, 200_003, "hz", 7.5), (1, 9, None, None)]
    far = [(0, 10**12, "hz", 1.0)]
    schema = LOG
    batches = [old.unionByName(spark.createDataFrame(frames, schema)), spark.createDataFrame(frames_later + far, schema)]
    progress = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
        query = settings_stream(spark, folder, out, checkpoint, {"hz": 10.0})
        progress += [p for p in query.recentProgress if p["numInputRows"]]
    assert progress[-1]["numInputRows"] == 8
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 10
    got = spark.read.parquet(out)
    want = telemetry.settings_asof(spark.read.parquet(folder), telemetry.SETTINGS, {"hz": 10.0})
    assert got.count() == want.count() == 10
    assert got.select(*want.columns).exceptAll(want).isEmpty()


def test_a_command_that_comes_late_counts_from_the_next_frame(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    batches = [
        [(0, 1, None, None), (0, 5, None, None), (0, 4, "link_tier", 9.0)],
        [(0, 2, "hz", 5.0), (0, 3, "link_tier", 1.0), (0, 6, None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        settings_stream(spark, folder, out, checkpoint, {})
    got = {r.seq: (r.hz, r.link_tier) for r in spark.read.parquet(out).collect()}
    assert got == {1: (None, None), 5: (None, 9.0), 6: (5.0, 9.0)}


def rolling(spark, folder, schema, tmp_path, **options):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, checkpoint = (str(tmp_path / n) for n in ("out", "checkpoint"))
    return out, finished(telemetry_stream.start_rolling_stream(source, out, checkpoint, once=True, **options))


def same_figures(got, want):
    shown = [
        "stream_id", "frame_id", "fps", "frame_ms_mean", "frame_ms_p95", "perception_ms_mean", "grid_ms_mean",
        "codec_ms_mean", "wire_bytes_mean", "samples",
    ]
    got, want = (df.select(*shown).toPandas().sort_values(shown[:2], ignore_index=True) for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_exact=True, check_dtype=False)


def test_rolling_stream_equals_batch_whatever_the_order_of_arrival(spark, tmp_path):
    from test_ordered import timings

    _, df = timings(spark, 120)
    df = df.withColumn("frame_ms", F.when(F.col("frame_id") % 5 != 0, F.col("frame_ms")))
    rows = df.collect()
    np.random.default_rng(8).shuffle(rows)
    folder = str(tmp_path / "timings")
    for part in (rows[:70], rows[70:71], rows[71:160], rows[160:]):
        spark.createDataFrame([tuple(r) for r in part], df.schema).coalesce(1).write.mode("append").parquet(folder)
    out, _ = rolling(spark, folder, df.schema, tmp_path, late=200)
    same_figures(telemetry_stream.newest(spark, out), telemetry.rolling_stats(df, history=False))


def test_a_batch_touches_the_streams_it_brings(spark, tmp_path):
    from test_ordered import timings

    _, df = timings(spark, 200, streams=6)
    folder = str(tmp_path / "timings")
    df.where("frame_id < 1330").coalesce(1).write.mode("append").parquet(folder)
    rolling(spark, folder, df.schema, tmp_path, late=10)
    df.where("frame_id >= 1330 AND stream_id = 2").coalesce(1).write.mode("append").parquet(folder)
    out, query = rolling(spark, folder, df.schema, tmp_path, late=10)
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    told = spark.read.parquet(out).where(f"batch_id = {last['batchId']}")
    assert [r.stream_id for r in told.select("stream_id").distinct().collect()] == [2]
    assert last["stateOperators"][0]["numRowsUpdated"] <= 72
    want = telemetry.rolling_stats(df.where("frame_id < 1330 OR stream_id = 2"), history=False)
    same_figures(telemetry_stream.newest(spark, out), want)


def test_frames_too_late_have_no_figures(spark, tmp_path):
    from test_ordered import timings

    _, df = timings(spark, 100, streams=1)
    folder = str(tmp_path / "timings")
    for rows in (df.where("frame_id <> 7 AND frame_id <> 665"), df.where("frame_id = 7"), df.where("frame_id = 665")):
        rows.coalesce(1).write.mode("append").parquet(folder)
    out, _ = rolling(spark, folder, df.schema, tmp_path, late=8)
    got = {r.frame_id: r for r in telemetry_stream.newest(spark, out).collect()}
    want = {r.frame_id: r for r in telemetry.rolling_stats(df, history=False).collect()}
    assert got[7].samples is None and got[7].fps is None
    assert all(got[f].frame_ms_mean == want[f].frame_ms_mean for f in (665, 672, 693))


SHOWN = ["frame_id", "code", "level", "cls", "driver", "n_points"]


@pytest.mark.parametrize("risky", [True, False])
def test_a_frame_in_five_files_over_five_batches(spark, tmp_path, risky):
    folder, out, params = str(tmp_path / "points"), str(tmp_path / "out"), grid.GridParams(risk_adaptive=risky)
    rows = []
    for frame in range(3):
        rows += [(frame, i, *map(float, r[:3]), r[3], float(r[4]), "t") for i, r in enumerate(random_rows(500, 70 + frame))]
    # Frame 0 comes in five files, frame 1 in two, frame 2 in one.
    cut = {0: 100, 1: 250, 2: 500}
    for part in range(5):
        some = [r for r in rows if r[1] // cut[r[0]] == part]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    arriving = grid_stream.stream_points(spark, folder, files_per_batch=1)
    query = grid_stream.start_grid_stream(
        arriving, out, str(tmp_path / "checkpoint"), params, once=True, parts=str(tmp_path / "parts")
    )
    finished(query)
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(rows)
    got = grid_stream.latest(spark, out)
    want = grid.adaptive_grid(spark.read.parquet(folder), params)
    assert got.count() == want.count() and got.select(*SHOWN).exceptAll(want.select(*SHOWN)).isEmpty()
    sums = [df.groupBy("frame_id").agg(F.round(F.sum(F.col("z") * F.col("n_points")), 6).alias("z")) for df in (got, want)]
    assert sums[0].exceptAll(sums[1]).isEmpty()


def test_parts_that_overlap_are_refused(spark):
    rows = [(0, i, 1.0, 1.0, 0.0, 1 + i % 2, 0.9, "t") for i in range(10)]
    odd, even = (spark.createDataFrame([r for r in rows if r[1] % 2 == k], SCHEMA) for k in (1, 0))
    parts = grid.part_runs(odd, P).unionByName(grid.part_runs(even, P))
    with pytest.raises(Exception, match="overlap in point_idx"):
        grid.grid_of_parts(parts, P).collect()


def frames_written(spark, out, batches, n=12):
    for batch_id in batches:
        rows = [(f, batch_id * 1000 + f) for f in range(n) if (f + batch_id) % 5 == 0 or batch_id == 0]
        versions.write_version(spark.createDataFrame(rows, "frame_id long, v long"), out, batch_id)


def expected(batches, n=12):
    return {f: max(b for b in batches if (f + b) % 5 == 0 or b == 0) for f in range(n)}


def read_back(spark, out):
    rows = versions.newest_frames(spark, out).collect()
    assert all(r.v == r.batch_id * 1000 + r.frame_id for r in rows) and len({r.frame_id for r in rows}) == len(rows)
    return {r.frame_id: r.batch_id for r in rows}


def test_reading_opens_the_folders_that_count(spark, tmp_path):
    out = str(tmp_path / "out")
    frames_written(spark, out, range(30))
    assert read_back(spark, out) == expected(range(30))
    opened = {f.split("/batch_id=")[1].split("/")[0] for f in versions.newest_frames(spark, out).inputFiles() if "/batch_id=" in f}
    assert len([f for f in opened if "_frames" not in f]) <= 30
    used = {r.folder for r in versions.places(spark, out).collect()}
    assert len(used) <= 5 and len(versions.unused_folders(spark, out)) == 30 - len(used)
    data = [f for f in versions.newest_frames(spark, out).inputFiles() if "_frames" not in f and "_manifest" not in f]
    assert all(any(f"/{u}/" in f for u in used) for f in data)
    # A replay of a batch changes nothing.
    frames_written(spark, out, [29])
    assert read_back(spark, out) == expected(range(30))


def test_compaction_and_one_that_fails(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    frames_written(spark, out, range(8))
    assert versions.compact(spark, out) == 1
    assert read_back(spark, out) == expected(range(8))
    assert {r.folder[:8] for r in versions.places(spark, out).collect()} == {"compact-"}
    frames_written(spark, out, [8, 9])
    assert read_back(spark, out) == expected(range(10))
    # One that breaks off after its rows, and one that breaks off within its manifest.
    with monkeypatch.context() as broken:
        broken.setattr(versions, "_version", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.compact(spark, out)
    half = spark.createDataFrame([(0, "nowhere", 99, 99)], versions._PLACES)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/_manifest/version=2")
    assert read_back(spark, out) == expected(range(10))
    assert versions.compact(spark, out) == 2
    assert read_back(spark, out) == expected(range(10))
