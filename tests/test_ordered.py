import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessgrid.operators import attach, layout, mapviews, ordered, telemetry
from tessgrid.params import GridParams


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    seqs = {s: sorted(rng.sample(range(5000), 300 if s == 0 else 40)) for s in range(3)}
    rows = [(s, q, rng.choice([None, None, float(rng.randrange(9))])) for s, qs in seqs.items() for q in qs]
    return rows, spark.createDataFrame(rows, "k LONG, at LONG, v DOUBLE")


@pytest.mark.parametrize("rows_per_block", [1, 3, 8, 10**6])
def test_rank_is_dense_whatever_the_block(log, rows_per_block):
    rows, df = log
    for r in ordered.ranked(df, ["k"], "at", rows_per_block, "n").collect():
        assert r.n == sum(1 for k, at, _ in rows if k == r.k and at < r.at)


@pytest.mark.parametrize("rows_per_block", [1, 3, 8, 10**6])
def test_last_value_carries_across_blocks(log, rows_per_block):
    rows, df = log
    held = {}
    for k, at, v in sorted(rows, key=lambda r: (r[0], r[1])):
        held[k, at] = v if v is not None else next(
            (w for j, b, w in sorted(rows, key=lambda r: -r[1]) if j == k and b < at and w is not None), None
        )
    for r in ordered.carried_forward(df, ["k"], "at", {"last": F.col("v")}, rows_per_block).collect():
        assert r["last"] == held[r.k, r["at"]]


def test_blocks_follow_row_counts_not_order_values(spark):
    """One stream in microseconds holds most rows, another is dense: blocks stay near their row count."""
    micros = spark.range(20_000).selectExpr("0L AS k", "id * 1000003L + id % 977 AS at")
    dense = spark.range(500).selectExpr("1L AS k", "id AS at")
    df = micros.unionByName(dense)
    sizes = ordered._in_blocks(df, ["k"], "at", 256).groupBy("k", "__block").count()
    got = {r.k: (r.n, r.most) for r in sizes.groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert got[0][0] <= 2 * 20_000 / 256 and got[0][1] <= 2 * 256 and got[1][1] <= 2 * 256
    ranks = ordered.ranked(df, ["k"], "at", 256, "n").where("k = 0").selectExpr("n = at DIV 1000003 AS ok")
    assert ranks.where("ok").count() == 20_000


def test_an_outlier_and_a_burst_do_not_fill_a_block(spark):
    """A stream in microseconds with one stamp at 0, and half of its rows within a millisecond."""
    spread = spark.range(9_000).selectExpr("0L AS k", "1700000000000000L + id * 1000003L AS at")
    burst = spark.range(1_000_000, 1_009_000).selectExpr("0L AS k", "1700000004000000L + id AS at")
    outlier = spark.sql("SELECT 0L AS k, 0L AS at")
    small = spark.range(90).selectExpr("1L AS k", "id AS at")
    df = spread.unionByName(burst).unionByName(outlier).unionByName(small).distinct()
    rows = 100  # 181 blocks: more than one summary can cut
    sizes = ordered._in_blocks(df, ["k"], "at", rows).groupBy("k", "__block").agg(
        F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")
    )
    found = sorted((r for r in sizes.collect() if r.k == 0), key=lambda r: r["__block"])
    assert max(r.n for r in found) <= 1.2 * rows and len(found) <= 4 * df.count() / rows
    assert all(x.b < y.a for x, y in zip(found, found[1:]))
    assert sizes.where("k = 1").count() == 1
    ranks = ordered.ranked(df, ["k"], "at", rows, "n").where("k = 0").orderBy("at").select("n").collect()
    assert [r.n for r in ranks] == list(range(len(ranks)))


def test_keys_of_usual_size_are_not_joined(spark):
    df = spark.range(500).selectExpr("id % 7 AS k", "id AS at")
    plan = ordered._in_blocks(df, ["k"], "at", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def timings(spark, n, streams=2):
    rng = random.Random(5)
    rows = [
        (s, 7 * i, float(rng.randrange(10, 99)), 1.0 + i % 3, 2.0, 3.0, 1000 + i) for s in range(streams) for i in range(n)
    ]
    schema = (
        "stream_id LONG, frame_id LONG, frame_ms DOUBLE, perception_ms DOUBLE, grid_ms DOUBLE, codec_ms DOUBLE, "
        "wire_bytes LONG"
    )
    return rows, spark.createDataFrame(rows, schema)


def test_rolling_figures_by_hand_with_short_spans(spark):
    rows, df = timings(spark, 200)
    got = telemetry.rolling_stats(df, window=60, span=64).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [x[2] for x in rows if x[0] == r.stream_id and x[1] < r.frame_id][-60:]
        assert r.samples == len(past) and r.history_ms == past
        if not past:
            assert r.fps is None and r.frame_ms_p95 is None
            continue
        assert r.frame_ms_mean == pytest.approx(np.mean(past), abs=0.0051)
        assert r.frame_ms_p95 == pytest.approx(np.percentile(past, 95), abs=0.0051)
        assert r.fps == pytest.approx(1000 / r.frame_ms_mean, abs=0.0051)


def test_settings_stick_and_an_explicit_null_is_a_value(spark):
    rows = [
        (1, 1, None, None), (1, 2, "link_tier", 9.0), (1, 3, None, None), (1, 4, "link_tier", None), (1, 5, None, None),
        (1, 6, "conf_threshold", 0.5), (1, 7, None, None), (2, 8, None, None),
    ]
    df = spark.createDataFrame(rows, "stream_id LONG, seq LONG, setting STRING, value DOUBLE")
    got = {
        r.seq: (r.link_tier, r.conf_threshold)
        for r in telemetry.settings_asof(df, ("link_tier", "conf_threshold"), {"link_tier": 8.0, "conf_threshold": 0.6}).collect()
    }
    assert got == {1: (8.0, 0.6), 3: (9.0, 0.6), 5: (None, 0.6), 7: (None, 0.5), 8: (8.0, 0.6)}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    small = spark.createDataFrame([(0, "a")], "k LONG, name STRING")
    got = ordered.salted_join(big, small, ["k"], F.col("id"), 5)
    assert got.count() == 1000 and got.where("name = 'a'").count() == 500


def test_image_lookup_by_hand(spark):
    import math

    rng = random.Random(8)
    rows = [(0, i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-3, 1)) for i in range(200)]
    points = spark.createDataFrame(rows, "frame_id LONG, point_idx LONG, x DOUBLE, y DOUBLE, z DOUBLE")
    pixels = [(0, h, [h * 100.0 + w for w in range(32)]) for h in range(16)]
    image = spark.createDataFrame(pixels, "frame_id LONG, h INT, pixels ARRAY<DOUBLE>")
    got = {r.point_idx: r.image_conf for r in attach.range_image_lookup(points, image, 16, 32).collect()}
    for _, i, x, y, z in rows:
        w = min(int((math.degrees(math.atan2(y, x)) + 180) % 360 / 360 * 32), 31)
        el = math.degrees(math.atan2(z, max(math.hypot(x, y), 1e-6)))
        h = min(max(int((2.0 - el) / 26.8 * 15), 0), 15)
        assert got[i] == h * 100.0 + w


def _on_a_line(spark, n):
    return spark.range(n).select(
        F.lit(0).cast("long").alias("frame_id"), F.col("id").alias("point_idx"), F.col("id").cast("double").alias("x"),
        F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )


def test_pointwise_model_shuffles_nothing(spark):
    import pandas as pd

    def model(block):
        return pd.DataFrame({"cls": block["x"].astype(int), "conf": [None] * len(block)})

    found = attach.predict_points(_on_a_line(spark, 100), model)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 100 and all(r.cls == r.point_idx and r.conf == 1.0 for r in got)


def test_context_model_sees_a_whole_square_in_index_order(spark):
    import pandas as pd

    def model(block):
        assert block["x"].is_monotonic_increasing
        return pd.DataFrame({"cls": [len(block)] * len(block), "conf": [0.5] * len(block)})

    # squares of 12.8 m, the first border at 0: 13 whole metres, then 13, 13, ...
    got = attach.predict_tiles(_on_a_line(spark, 100), model, tile_level=4).collect()
    want = {i: sum(int(j / 12.8) == int(i / 12.8) for j in range(100)) for i in range(100)}
    assert {r.point_idx: r.cls for r in got} == want


def test_many_squares_go_into_one_call(spark, tmp_path):
    import uuid

    import pandas as pd

    def model(block, batched=True):
        (tmp_path / uuid.uuid4().hex).touch()
        square = block["square"] if batched else pd.Series(0, index=block.index)
        low = block["z"] - block["z"].groupby(square).transform("min")
        size = square.groupby(square).transform("size")
        return pd.DataFrame({"cls": size, "conf": low.where(low > 0)})

    rows = [(f, i, -70.0 + (i * 7 % 100), -3.0 + i % 5, i * 0.01) for f in (None, 3, 4) for i in range(100)]
    points = spark.createDataFrame(rows, "frame_id LONG, point_idx LONG, x DOUBLE, y DOUBLE, z DOUBLE").repartition(5)
    calls = []
    for batched in (True, False):
        got = attach.predict_tiles(
            points, lambda b: model(b, batched), tile_level=5, batched=batched, tasks=3
        ).collect()
        calls.append(len(list(tmp_path.iterdir())))
        if batched:
            want = sorted(map(str, got))
    assert sorted(map(str, got)) == want and len(got) == 300
    # 3 frames of 16 squares of 6.4 m each way; three tasks, a call each
    assert calls[0] <= 3 and calls[1] - calls[0] > 30
    squares = {}
    for f, i, x, y, z in rows:
        squares.setdefault((f, x // 6.4, y // 6.4), []).append(z)
    found = {(r.frame_id, r.point_idx): (r.cls, r.conf) for r in got}
    for f, i, x, y, z in rows:
        own = squares[f, x // 6.4, y // 6.4]
        assert found[f, i] == (len(own), z - min(own) or 1.0)


def test_squares_larger_than_a_batch_stay_whole():
    import pyarrow as pa

    sizes = [3, 200_000, 1, 150_000, 5, 5]
    tile = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"frame_id": pa.array(tile // 2), "tile": pa.array(tile)})
    seen = []
    for part, starts in layout.whole_groups(iter(table.to_batches(max_chunksize=10_000)), ("frame_id", "tile"), 2**17):
        ends = [*starts[1:], part.num_rows]
        seen += [(part["tile"][int(a)].as_py(), int(b - a)) for a, b in zip(starts, ends)]
    assert seen == list(enumerate(sizes))


def test_all_readable_cells_are_shown(spark):
    from test_grid import cloud, random_rows

    from tessgrid.operators import grid

    cells = grid.adaptive_grid(cloud(spark, random_rows(400, 41)))
    shown = mapviews.viewport_lod(cells, -200, 200, -200, 200, pixels_per_m=1000.0)
    assert shown.count() == cells.count() > 25
    assert GridParams().dense_cells == 16_000_000


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()

    def loader(shift):
        def load():
            import os
            import uuid

            (log / f"{os.getpid()}-{shift}-{uuid.uuid4().hex}").touch()
            return lambda xyz: xyz.assign(cls=(xyz["x"].astype("int64") % 3) + shift, conf=0.5)

        return load

    points = spark.range(4000).selectExpr("0L AS frame_id", "id AS point_idx", "double(id) AS x", "0d AS y", "0d AS z").repartition(16)
    for _ in range(3):
        got = attach.predict_loaded(points, loader(1), "first").groupBy("cls").count().collect()
        assert {r.cls: r["count"] for r in got} == {1: 1334, 2: 1333, 3: 1333}
    loads = [p.name.split("-")[:2] for p in log.iterdir()]
    assert len(loads) == len({pid for pid, _ in loads}) <= 16, "one load per worker process"
    attach.predict_loaded(points, loader(2), "second").where("cls = 2").count()
    assert {shift for _, shift in (p.name.split("-")[:2] for p in log.iterdir())} == {"1", "2"}
