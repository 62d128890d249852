"""Point clouds, timings, commands, ledgers and tracks derived from the star-schema tables.

Each view is one stateless projection, written once as SQL text that Spark and DuckDB both run, so
deriving it costs no shuffle and its work grows with the table. `{name}` marks a source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A supplier is an object of about 2.5 x 2 m; coordinates sit 13 mm inside a finest cell, so nothing
# depends on rounding at a cell edge, and the odd thousandths keep means of few points off thresholds. 4,096 consecutive orders make one frame. The point index packs
# (order, line, price, part), which is unique in a frame and follows the order of the table.
POINTS = """
SELECT frame_id,
       ((pos * 16777216 + cents) * 16384 + part) AS point_idx,
       (ix * 50 + 13 - 102400) / 1000e0 AS x,
       (iy * 50 + 13 - 102400) / 1000e0 AS y,
       z, cls, conf, 'derived' AS source
FROM (
  SELECT CAST(floor(l_orderkey / 4096e0) AS BIGINT) AS frame_id,
         CAST((l_orderkey % 4096) * 8 + l_linenumber AS BIGINT) AS pos,
         CAST(round(l_extendedprice * 100e0, 0) AS BIGINT) AS cents,
         CAST(l_partkey % 16384 AS BIGINT) AS part,
         (l_suppkey * 1237) % (1000 * (1 + l_suppkey % 4)) - 500 * (1 + l_suppkey % 4)
           + 2023 + CAST(l_quantity AS INT) AS ix,
         (l_suppkey * 2917) % (1000 * (1 + l_suppkey % 4)) - 500 * (1 + l_suppkey % 4)
           + 2028 + l_partkey % 40 AS iy,
         l_tax * 10e0 - 1.731e0 AS z,
         CASE l_suppkey % 10 WHEN 0 THEN 40 WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 7
              ELSE CASE WHEN l_linenumber = 7 THEN 5 ELSE 1 END END AS cls,
         0.953e0 - l_discount * 4e0 AS conf
  FROM {lineitem}
  WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL
    AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
    AND l_discount IS NOT NULL AND l_tax IS NOT NULL
) p
"""

# A model's answers, one row per order line, keyed like the points; points of other origin have none.
PREDICTIONS = POINTS.replace("z, cls, conf, 'derived' AS source", "CASE WHEN conf < 0.7e0 THEN NULL ELSE cls + 1 END AS pred_cls, 1e0 - conf / 2e0 AS pred_conf")

# The measures other than the frame time are multiples of 1/4, whose sums are exact in any order.
TIMINGS = """
SELECT user_id AS stream_id, event_id AS frame_id, value AS frame_ms,
       (event_id % 37) * 0.25e0 AS perception_ms, (event_id % 53) * 0.5e0 AS grid_ms,
       (event_id % 11) * 0.25e0 AS codec_ms, CAST(1000 + event_id % 997 AS BIGINT) AS wire_bytes
FROM {events}
"""

# Rows with a key are `set` commands, all others are frames. Half of the link_tier commands carry an
# explicit null.
COMMANDS = """
SELECT user_id AS stream_id, event_id AS seq,
       CASE WHEN event_type = 'signup' THEN
         CASE event_id % 7 WHEN 0 THEN 'conf_threshold' WHEN 1 THEN 'hazard_factor' WHEN 2 THEN 'link_tier'
           WHEN 3 THEN 'risk_adaptive' WHEN 4 THEN 'compress' WHEN 5 THEN 'hz' ELSE 'preserve_risk_on_link' END
       END AS setting,
       CASE WHEN event_type = 'signup' AND NOT (event_id % 7 = 2 AND event_id % 2 = 0)
            THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS value
FROM {events}
"""

LEDGER_TAG = "CASE event_id % 7 WHEN 3 THEN 'distance' WHEN 5 THEN 'segmentation' ELSE 'edge' END"

LEDGER = f"""
SELECT concat('run', CAST(event_id % 5 AS VARCHAR(4))) AS export_path, event_id AS seq,
       {LEDGER_TAG} AS tag,
       concat(event_type,
              CASE WHEN event_id % 7 = 3
                   THEN CASE event_id % 3 WHEN 0 THEN '_mIoU_0-10m' WHEN 1 THEN '_v_mIoU_10-30m'
                        ELSE '_plain' END
                   ELSE CASE user_id % 4 WHEN 0 THEN '_latency_ms' WHEN 1 THEN '_fps'
                        WHEN 2 THEN '_peak_mem_MB' ELSE '_other' END END) AS metric,
       value, CASE WHEN user_id % 2 = 0 THEN 'board-a' ELSE 'board-b' END AS hardware,
       concat('cmd-', CAST(event_id % 13 AS VARCHAR(4))) AS command
FROM {{events}}
"""

CHECKS = """
SELECT concat('run', CAST(user_id % 7 AS VARCHAR(4))) AS export_path,
       concat('P', CAST(user_id % 4 AS VARCHAR(4)), '.', CAST(event_id AS VARCHAR(20))) AS check_id,
       event_type AS text, event_id % 3 = 0 AS done
FROM {events}
"""

TRACKS = """
SELECT s_suppkey AS object_id,
       CASE s_suppkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE 5 END AS cls,
       (s_suppkey * 37) % 240 - 120e0 AS x0, (s_suppkey * 53) % 160 - 80e0 AS y0,
       (s_nationkey % 7 - 3) * 0.5e0 AS vx, (s_nationkey % 5 - 2) * 0.25e0 AS vy,
       0.25e0 + s_nationkey * 0.0625e0 AS radius, 1.5e0 AS height
FROM {supplier}
"""

# One confidence image per group of 64 vectors, a row of pixels per vector.
IMAGE_ROWS = """
SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS frame_id, CAST(vec_id % 64 AS INT) AS h, embedding
FROM {embeddings}
"""

TABLES = ("lineitem", "events", "supplier", "embeddings", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **used)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, POINTS)
