import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decimate import CELL, cell
from test_grid import P, cloud, random_rows

from tessgrid.functions import wire
from tessgrid.operators import grid, quality
from tessgrid.sources import frames


@pytest.fixture(scope="module")
def cells(spark):
    return grid.adaptive_grid(cloud(spark, random_rows(600, 31)), P)


def test_bytes_are_laid_out_as_documented(spark, cells):
    tails = spark.createDataFrame([(0, json.dumps({"source": "t"}))], "frame_id LONG, tail STRING")
    row = frames.pack_frames(cells, tails, compress=False, params=P).first()
    wire_bytes = bytes(row.wire)
    magic, version, flags, frame, n, quant, root, tail_len = struct.unpack_from("<4sBBIIffI", wire_bytes)
    assert (magic, version, flags, frame, n) == (b"PRH1", 1, 0, 0, cells.count())
    assert quant == pytest.approx(0.025) and root == pytest.approx(204.8)
    assert row.raw_bytes == row.wire_bytes == len(wire_bytes) == 26 + 10 * n + tail_len
    assert json.loads(wire_bytes[26 + 10 * n :]) == {"source": "t"}
    ordered = cells.orderBy("code").collect()
    x = np.frombuffer(wire_bytes, "<i2", n, 26)
    assert x.tolist() == [round(c.x / 0.025) for c in ordered]
    level = np.frombuffer(wire_bytes, "u1", n, 26 + 6 * n)
    assert level.tolist() == [c.level for c in ordered]


def test_deflated_frames_are_smaller_and_decode_alike(spark, cells):
    small, plain = (frames.pack_frames(cells, compress=c, params=P) for c in (True, False))
    assert small.first().wire_bytes < plain.first().wire_bytes
    assert small.first().compression_ratio > 1.5
    assert frames.unpack_frames(small).exceptAll(frames.unpack_frames(plain)).isEmpty()


def test_round_trip_error(spark, cells):
    assert quality.check_roundtrip(cells, P).first().violations == 0
    back = frames.unpack_frames(frames.pack_frames(cells, params=P))
    key = ["level", "x", "y"]
    both = cells.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3)).join(
        back.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3)).select(*key, F.col("z").alias("bz"), F.col("cls").alias("bc")), key
    )
    assert both.count() == cells.count()
    assert both.where((F.abs(F.col("z") - F.col("bz")) > 0.0050001) | (F.col("cls") != F.col("bc"))).isEmpty()


def test_halves_round_to_even_and_values_clip(spark):
    rows = [cell(0, 12, z=0.005), cell(1, 12, z=0.015), cell(2, 12, z=999.0), cell(3, 12, conf=1.5)]
    got = {r.code: r for r in wire.quantise_cells(spark.createDataFrame(rows, CELL), P).collect()}
    assert [got[i].zq for i in range(3)] == [0, 2, 32767] and got[3].confq == 255


def test_bad_frames_are_quarantined_with_a_reason(spark, cells):
    good = bytes(frames.pack_frames(cells, params=P).first().wire)
    plain = bytes(frames.pack_frames(cells, compress=False, params=P).first().wire)
    rows = [
        (1, b"XXXX" + good[4:]),
        (2, good[:4] + b"\x09" + good[5:]),
        (3, plain[:-40]),
        (4, good[:10]),
        (5, good[:60]),
        (6, good),
    ]
    df = spark.createDataFrame(rows, "frame_id LONG, wire BINARY")
    reasons = {r.frame_id: r.error for r in frames.quarantine(df).collect()}
    assert set(reasons) == {1, 2, 3, 4, 5}
    assert reasons[1].startswith("foreign_magic") and reasons[2] == "unknown_version:9"
    assert [reasons[i] for i in (3, 4, 5)] == ["short_body", "short_header", "body_not_deflated"]
    back = frames.unpack_frames(df)
    assert back.where("error IS NULL").count() == cells.count()
    assert {r.frame_id: r.error for r in back.where("error IS NOT NULL").collect()} == reasons


def test_a_number_beyond_the_header_is_told_not_raised(spark, cells):
    moved = cells.withColumn("frame_id", F.lit(2**32 + 5)).unionByName(cells)
    got = {r.frame_id: r for r in frames.pack_frames(moved, params=P).collect()}
    assert got[2**32 + 5].error == "frame_id_too_large" and got[2**32 + 5].wire is None
    assert got[0].error is None and got[0].n_cells == cells.count()


def test_tails_without_a_variant_go_to_every_variant(spark, cells):
    both = cells.crossJoin(spark.createDataFrame([("a",), ("b",)], "variant STRING"))
    tails = spark.createDataFrame([(0, '{"k":1}')], "frame_id LONG, tail STRING")
    assert [r.tail_bytes for r in frames.pack_frames(both, tails, params=P).collect()] == [7, 7]


def test_a_frame_with_a_tail_but_no_cells(spark):
    none = spark.createDataFrame([], CELL)
    tails = spark.createDataFrame([(7, "{}")], "frame_id LONG, tail STRING")
    row = frames.pack_frames(none, tails, params=P).first()
    assert (row.frame_id, row.n_cells, row.bytes_per_cell_wire) == (7, 0, None)
    assert zlib.decompress(bytes(row.wire)[26:]) == b"{}"


def test_tail_check_finds_a_wrong_count(spark, cells):
    tails = spark.createDataFrame(
        [(0, json.dumps({"n_cells": 1, "cell_size_min_m": 0.05, "cell_size_max_m": 0.4}))], "frame_id LONG, tail STRING"
    )
    packed = frames.pack_frames(cells, tails, params=P)
    assert quality.check_tail(frames.frame_headers(packed), frames.unpack_frames(packed)).first().violations == 1


def test_link_budget(spark):
    df = spark.createDataFrame([(3200,), (3201,), (12500,), (12501,)], "wire_bytes LONG")
    got = wire.link_budget(df, 10.0).orderBy("wire_bytes").collect()
    assert [r.fits_256kbps_link for r in got] == [True, False, False, False]
    assert [r.fits_1mbps_link for r in got] == [True, True, True, False]
    assert got[2].mbps == 1.0 and got[0].kbps == 256.0


def test_tiers_cost_less_the_coarser_they_are(spark, cells):
    from tessgrid.operators import decimate

    got = {r.tier: r for r in decimate.tier_wire(cells, params=P).collect()}
    counted = {r.tier: r.n_cells for r in decimate.tier_matrix(cells, params=P).collect()}
    assert {t: r.n_cells for t, r in got.items()} == counted and len(got) == 8
    assert all(r.raw_bytes == 28 + 10 * r.n_cells for r in got.values())
    assert got["level8_plain"].wire_bytes <= got["level11_plain"].wire_bytes
    assert got["level9_plain"].wire_bytes <= got["level9_risk_preserved"].wire_bytes
    assert all(abs(r.mbps - r.wire_bytes * 80 / 1e6) < 0.001 for r in got.values())


def test_many_frames_are_packed_from_one_shuffle(spark):
    import zlib

    sizes = {(v, f): 1 + (7 * f + len(v)) % 60 for f in range(90) for v in ("a", "bb", "ccc")}
    rows = [(v, f, c << 4, 10, c * 0.2, 0.1, c * 0.01, 1, 0.5, 0) for (v, f), n in sizes.items() for c in range(n)]
    cells = spark.createDataFrame(
        rows, "variant STRING, frame_id LONG, code LONG, level INT, x DOUBLE, y DOUBLE, z DOUBLE, cls INT, conf DOUBLE, driver INT"
    )
    packed = frames.pack_frames(cells.repartition(7), params=P, tasks=5)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    # the cells meet Python once, frame by frame, not first as fragments of as many frames as a batch holds
    assert "FlatMapGroups" not in plan and "MapInPandas" not in plan and plan.count("MapInArrow") == 1
    assert ", 5)" in plan
    got = {(r.variant, r.frame_id): r for r in packed.collect()}
    assert {k: r.n_cells for k, r in got.items()} == sizes
    for (_, f), r in got.items():
        body = zlib.decompress(bytes(r.wire)[frames.HEADER_BYTES :])
        xq = list(memoryview(body[: 2 * r.n_cells]).cast("h"))
        assert xq == [round(c * 0.2 / P.quant_m) for c in range(r.n_cells)]
        assert r.raw_bytes == frames.HEADER_BYTES + len(body) and r.wire_bytes == len(r.wire)
