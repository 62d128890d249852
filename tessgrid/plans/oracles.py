"""SQL for each registered query, written for DuckDB and independent of how Spark gets there: edges by one
window over a whole frame, leaves by a node maximum at all 13 levels."""

from __future__ import annotations

from tessgrid.plans import inputs

ORACLES: dict[str, str] = {}
DEPTH = 12
HAZARD = "cls IN (40, 41, 42, 43, 44)"
SIZE = "(204.8e0 / power(2e0, level))"
FAR = f"({HAZARD} AND sqrt(x * x + y * y) > 10e0)"
TABLES = {name: name for name in inputs.TABLES}


def _spoilt(column: str, value: str, every: int, source: str = "cells", key: str = "code") -> str:
    """Subquery of `source` with one column changed where `key` is a multiple of `every`."""
    return (
        f"(SELECT * REPLACE (CASE WHEN {key} % {every} = 0 THEN {value} ELSE {column} END AS {column}) FROM {source}) s"
    )


def _sql(text: str) -> str:
    return text.format(**TABLES)


def _spread(v: str, first: int) -> str:
    return " + ".join(f"((({v} >> {i}) & 1) << {2 * i + first})" for i in range(DEPTH))


def _compact(v: str, first: int) -> str:
    return " + ".join(f"((({v} >> {2 * i + first}) & 1) << {i})" for i in range(DEPTH))


def _per_level(pick: str) -> str:
    whens = " ".join(f"WHEN (k{n} >> 3) <= {n} THEN {pick.format(n=n)}" for n in range(DEPTH + 1))
    return f"CASE {whens} END"


PTS = f"pts AS ({_sql(inputs.POINTS)})"
INDEXED = f"""{PTS}, indexed AS (
  SELECT *, sqrt(x * x + y * y) AS range_m,
         greatest(0, least(4095, CAST(floor((x + 102.4e0) / 0.05e0) AS BIGINT))) AS ix,
         greatest(0, least(4095, CAST(floor((y + 102.4e0) / 0.05e0) AS BIGINT))) AS iy
  FROM pts WHERE abs(x) < 102.4e0 AND abs(y) < 102.4e0)"""
CODED = f"""{INDEXED}, coded AS (
  SELECT *, {_spread("ix", 1)} + {_spread("iy", 0)} AS code,
         CASE WHEN range_m <= 10e0 THEN 0.05e0
              ELSE 0.05e0 + (range_m - 10e0) / 90e0 * 0.45e0 END AS target_m
  FROM indexed)"""
EDGED = f"""{CODED}, edged AS (
  SELECT *, coalesce(lag(cls) OVER w <> cls, false) OR coalesce(lead(cls) OVER w <> cls, false) AS edge
  FROM coded WINDOW w AS (PARTITION BY frame_id ORDER BY code, point_idx))"""


def _level(target: str) -> str:
    return f"least(12, greatest(0, CAST(ceil(log2(204.8e0 / greatest({target}, 0.05e0)) - 1e-9) AS INT)))"


def _grid(risk: bool, name: str = "cells") -> str:
    """CTEs from `edged` to `{name}`; intermediate names end in the same suffix."""
    s = name
    if risk:
        wanted = f"""CASE WHEN {HAZARD} THEN least(CASE WHEN conf < 0.6e0 THEN target_m / 2e0
                       ELSE target_m END, target_m / 4e0)
                     WHEN conf < 0.6e0 THEN target_m / 2e0 ELSE target_m END"""
        priority = f"CASE WHEN {HAZARD} THEN 3 WHEN conf < 0.6e0 THEN 2 ELSE 0 END"
        key = """CASE WHEN edge AND level0 < 11 THEN (level0 + 1) * 8 + greatest(priority0, 1)
                      ELSE level0 * 8 + priority0 END"""
    else:
        wanted, priority, key = "target_m", "0", "level0 * 8"
    maxima = ", ".join(
        f"max(pkey) OVER (PARTITION BY frame_id, code >> {2 * (DEPTH - n)}) AS k{n}" for n in range(DEPTH + 1)
    )
    return f"""asked_{s} AS (SELECT *, {_level(wanted)} AS level0, {priority} AS priority0 FROM edged),
keyed_{s} AS (SELECT *, {key} AS pkey FROM asked_{s}),
nodes_{s} AS (SELECT *, {maxima} FROM keyed_{s}),
leaves_{s} AS (SELECT *, {_per_level("{n}")} AS level, {_per_level("k{n}")} AS gkey FROM nodes_{s}),
tagged_{s} AS (SELECT *, code >> (2 * (12 - level)) AS node,
    CASE gkey & 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS driver FROM leaves_{s}),
votes_{s} AS (SELECT frame_id, level, node, cls, count(*) AS n FROM tagged_{s} GROUP BY ALL),
major_{s} AS (SELECT frame_id, level, node, cls FROM votes_{s}
    QUALIFY row_number() OVER (PARTITION BY frame_id, level, node ORDER BY n DESC, cls) = 1),
sums_{s} AS (SELECT frame_id, level, node, min(code) AS code, avg(z) AS z, min(z) AS z_min, max(z) AS z_max,
    avg(conf) AS conf, max(driver) AS driver, count(*) AS n_points FROM tagged_{s} GROUP BY ALL),
{name} AS (SELECT s.frame_id, s.code, s.level, s.node,
    -102.4e0 + (({_compact("s.node", 1)}) + 0.5e0) * (204.8e0 / power(2e0, s.level)) AS x,
    -102.4e0 + (({_compact("s.node", 0)}) + 0.5e0) * (204.8e0 / power(2e0, s.level)) AS y,
    s.z, s.z_min, s.z_max, m.cls, s.conf, s.driver, s.n_points
  FROM sums_{s} s JOIN major_{s} m ON s.frame_id = m.frame_id AND s.level = m.level AND s.node = m.node)"""


GRID = f"WITH {EDGED}, {_grid(True)}"
TIDY = """frame_id, code, level, x, y, round(z, 9) AS z, z_min, z_max, cls, round(conf, 9) AS conf, driver,
  n_points"""


def _decimated(max_level: int, preserve: bool, name: str) -> str:
    """CTE `{name}`: kept cells united with merged ones; `merged_from` counts what went in."""
    keep = f"level <= {max_level}" + (" OR driver <> 0" if preserve else "")
    shift = 2 * (DEPTH - max_level)
    return f"""in_{name} AS (SELECT *, code >> {shift} AS up FROM cells WHERE NOT ({keep})),
votes_{name} AS (SELECT frame_id, up, cls, sum(n_points) AS n FROM in_{name} GROUP BY ALL),
major_{name} AS (SELECT frame_id, up, cls FROM votes_{name}
    QUALIFY row_number() OVER (PARTITION BY frame_id, up ORDER BY n DESC, cls) = 1),
{name} AS (
  SELECT frame_id, code, level, x, y, z, z_min, z_max, cls, conf, driver, n_points, true AS kept,
         1 AS merged_from FROM cells WHERE {keep}
  UNION ALL
  SELECT s.frame_id, s.up << {shift}, {max_level},
         -102.4e0 + (({_compact("s.up", 1)}) + 0.5e0) * {204.8 / 2**max_level!r}e0,
         -102.4e0 + (({_compact("s.up", 0)}) + 0.5e0) * {204.8 / 2**max_level!r}e0,
         s.z, s.z_min, s.z_max, m.cls, s.conf, 0, s.n_points, false, s.n_in
  FROM (SELECT frame_id, up, sum(z * n_points) / sum(n_points) AS z, min(z_min) AS z_min,
               max(z_max) AS z_max, sum(conf * n_points) / sum(n_points) AS conf,
               CAST(sum(n_points) AS BIGINT) AS n_points, count(*) AS n_in
        FROM in_{name} GROUP BY ALL) s
  JOIN major_{name} m ON s.frame_id = m.frame_id AND s.up = m.up)"""


def _memory(n: str, points: str) -> dict[str, str]:
    return {
        "adaptive_bytes": f"CAST({n} * 6 AS BIGINT)",
        "dense_uniform_bytes": "CAST(96000000 AS BIGINT)",
        "dense_uniform_cells": "CAST(16000000 AS BIGINT)",
        "dense_3d_voxel_bytes": "CAST(3200000000 AS BIGINT)",
        "dense_3d_voxels": "CAST(3200000000 AS BIGINT)",
        "reduction_vs_dense_3d": f"round_even(3200000000e0 / ({n} * 6), 1)",
        "raw_cloud_bytes": f"CAST({points} * 16 AS BIGINT)",
        "reduction_vs_dense": f"round_even(96000000e0 / ({n} * 6), 1)",
        "reduction_vs_cloud": f"round_even(CAST({points} * 16 AS DOUBLE) / ({n} * 6), 2)",
        "bytes_per_cell": "6",
    }


def _listed(columns: dict[str, str], *names: str) -> str:
    return ", ".join(f"{columns[c]} AS {c}" for c in (names or columns))


# ------------------------------------------------------------- points and expressions
ORACLES["crop_root"] = f"""WITH {PTS}
SELECT frame_id, point_idx, round(x + 20e0, 9) AS x, round(y, 9) AS y FROM pts
WHERE abs(x + 20e0) < 102.4e0 AND abs(y) < 102.4e0"""
ORACLES["morton_codes"] = f"WITH {CODED} SELECT frame_id, point_idx, ix, iy, code FROM coded"
ORACLES["morton_roundtrip"] = f"WITH {INDEXED} SELECT frame_id, point_idx, ix, iy FROM indexed"
ORACLES["target_size_schedule"] = f"""WITH {CODED}
SELECT frame_id, point_idx, round(range_m, 9) AS range_m, round(target_m, 9) AS target_m,
       {_level("target_m")} AS level FROM coded"""
ORACLES["required_level"] = f"""WITH {EDGED}, {_grid(True)}
SELECT frame_id, point_idx, code, pkey >> 3 AS level, pkey & 7 AS priority FROM keyed_cells"""
ORACLES["class_edges"] = f"WITH {EDGED} SELECT frame_id, point_idx, code, cls, edge FROM edged"
ORACLES["conf_default"] = f"""WITH {PTS}
SELECT frame_id, point_idx, CASE WHEN cls IN (7, 8) THEN 1e0 ELSE round(conf, 9) END AS conf FROM pts"""
ORACLES["sector_confidence"] = f"""WITH {PTS}, placed AS (
  SELECT *, abs((degrees(atan2(y, x)) - 37.7e0 + 180e0 + 360e0) % 360e0 - 180e0) < 52.3e0 AS inside FROM pts)
SELECT frame_id, inside, count(*) AS n_points, round(avg(conf), 9) AS mean_conf FROM placed GROUP BY ALL"""
_CLASSES = """classes(cls, name, class_group, hazard) AS (VALUES
  (0, 'unknown', 'unknown', false), (1, 'drivable', 'terrain', false), (2, 'rough-ground', 'terrain', false),
  (3, 'vegetation', 'terrain', false), (4, 'wall', 'static', false), (5, 'pole', 'static', false),
  (6, 'barrier', 'static', false), (7, 'pedestrian', 'dynamic', false), (8, 'vehicle', 'dynamic', false),
  (9, 'two-wheeler', 'dynamic', false), (40, 'pothole', 'hazard', true), (41, 'ditch', 'hazard', true),
  (42, 'loose-rock', 'hazard', true), (43, 'water-crossing', 'hazard', true), (44, 'snow-drift', 'hazard', true))"""
ORACLES["class_dim_lookup"] = f"""WITH {PTS}, {_CLASSES},
moved AS (SELECT frame_id, point_idx, CAST(cls + frame_id % 3 AS INT) AS cls FROM pts)
SELECT frame_id, point_idx, m.cls, coalesce(name, CAST(m.cls AS VARCHAR)) AS name, class_group,
       coalesce(hazard, false) AS hazard FROM moved m LEFT JOIN classes c ON m.cls = c.cls"""
ORACLES["range_image_lookup"] = f"""WITH {PTS}, image AS (
  SELECT frame_id, h, generate_subscripts(embedding, 1) - 1 AS w,
         (CAST(unnest(embedding) AS DOUBLE) + 1e0) / 2e0 AS conf
  FROM ({_sql(inputs.IMAGE_ROWS)}) q),
binned AS (SELECT *,
  least(63, greatest(0, CAST(trunc((2e0 - degrees(atan2(z, greatest(sqrt(x * x + y * y), 1e-6)))) / 26.8e0 * 63e0) AS INT))) AS h,
  least(63, greatest(0, CAST(trunc(((degrees(atan2(y, x)) + 180e0) % 360e0) / 360e0 * 64e0) AS INT))) AS w
  FROM pts)
SELECT b.frame_id, count(*) AS n_points, count(i.conf) AS n_found, round(avg(i.conf), 6) AS mean_conf
FROM binned b LEFT JOIN image i ON b.frame_id = i.frame_id AND b.h = i.h AND b.w = i.w GROUP BY ALL"""
ORACLES["attach_predictions"] = f"""WITH {PTS}, told AS ({_sql(inputs.PREDICTIONS)})
SELECT p.frame_id, p.point_idx, CAST(coalesce(pred_cls, 0) AS INT) AS cls,
       round(coalesce(pred_conf, 1e0), 9) AS conf, 'model' AS source, pred_cls IS NOT NULL AS matched
FROM pts p LEFT JOIN told t ON p.frame_id = t.frame_id AND p.point_idx = t.point_idx"""
ORACLES["predict_hook"] = f"""WITH {PTS}
SELECT frame_id, point_idx, CASE WHEN z < -1.4e0 THEN 1 ELSE 4 END AS cls,
       round(1e0 - sqrt(x * x + y * y) / 200e0, 9) AS conf, 'height-model' AS source FROM pts"""
ORACLES["predict_tiles"] = f"""WITH {CODED}, risen AS (
  SELECT *, z - min(z) OVER (PARTITION BY frame_id, code >> 10) AS rise FROM coded)
SELECT frame_id, point_idx, CASE WHEN rise < 0.25e0 THEN 1 ELSE 4 END AS cls,
       round(1e0 / (1e0 + rise), 9) AS conf, 'step-model' AS source FROM risen"""
ORACLES["point_cell_assignment"] = f"{GRID} SELECT frame_id, point_idx, level, node, driver FROM tagged_cells"

# ------------------------------------------------------------- grid and statistics
ORACLES["adaptive_grid"] = f"{GRID} SELECT {TIDY} FROM cells"
ORACLES["leaf_extraction"] = f"""{GRID}
SELECT frame_id, level, node, max(driver) AS driver, count(*) AS n_points FROM tagged_cells GROUP BY ALL"""
ORACLES["majority_class"] = f"{GRID} SELECT frame_id, level, code, cls FROM cells"
ORACLES["level_usage"] = f"""{GRID}, levels AS (
  SELECT level, 204.8e0 / power(2e0, level) AS size FROM (SELECT CAST(unnest(range(13)) AS INT) AS level) q),
bands AS (
  SELECT m AS metre, (SELECT min(level) FROM levels l WHERE l.level = 12
         OR l.size <= CASE WHEN m <= 10 THEN 0.05e0 ELSE 0.05e0 + (m - 10) / 90e0 * 0.45e0 END) AS level
  FROM (SELECT unnest(range(101)) AS m) q),
used AS (SELECT level, count(*) AS n_cells FROM cells GROUP BY ALL)
SELECT l.level, round_even(l.size, 4) AS size_m, min(metre) AS range_from_m, max(metre) AS range_to_m,
       coalesce(max(n_cells), 0) AS n_cells
FROM levels l LEFT JOIN bands b ON l.level = b.level LEFT JOIN used u ON l.level = u.level
WHERE l.size <= 2e0 GROUP BY ALL"""
ORACLES["cells_by_level"] = f"{GRID} SELECT frame_id, level, count(*) AS n_cells FROM cells GROUP BY ALL"
ORACLES["cells_by_driver"] = f"""{GRID} SELECT frame_id, driver, count(*) AS n_cells,
  CASE driver WHEN 0 THEN 'range' WHEN 1 THEN 'hazard' WHEN 2 THEN 'low confidence' ELSE 'class boundary' END
  AS name FROM cells GROUP BY ALL"""
ORACLES["cells_by_class"] = f"""{GRID}, {_CLASSES}
SELECT frame_id, c.cls, count(*) AS n_cells, coalesce(max(name), CAST(c.cls AS VARCHAR)) AS name
FROM cells c LEFT JOIN classes d ON c.cls = d.cls GROUP BY frame_id, c.cls"""
for _key, _name in (("level", "level_legend"), ("cls", "class_legend")):
    ORACLES[_name] = f"""{GRID} SELECT frame_id, {_key}, count(*) AS n_cells,
  dense_rank() OVER (PARTITION BY frame_id ORDER BY {_key}) - 1 AS rank FROM cells GROUP BY frame_id, {_key}"""
_MEM = _memory("count(*)", "sum(n_points)")
ORACLES["frame_stats"] = f"""{GRID} SELECT frame_id, CAST(sum(n_points) AS BIGINT) AS n_points,
  count(*) AS n_cells, round_even(min({SIZE}), 4) AS cell_size_min_m,
  round_even(max({SIZE}), 4) AS cell_size_max_m, count(driver <> 0 OR NULL) AS risk_driven_cells,
  count({HAZARD} OR NULL) AS hazard_cells, count({FAR} OR NULL) AS hazard_cells_beyond_fovea,
  count(conf < 0.6e0 OR NULL) AS degraded_cells, round_even(min(z), 2) AS z_low, round_even(max(z), 2) AS z_high,
  {", ".join(f"count(level = {n} OR NULL) AS level_{n}" for n in range(9, 13))},
  count(driver = 3 OR NULL) AS boundary_cells, count(cls = 40 OR NULL) AS pothole_cells,
  {_listed(_MEM, "adaptive_bytes", "reduction_vs_dense")} FROM cells GROUP BY frame_id"""
ORACLES["memory_reduction"] = f"""{GRID} SELECT frame_id, count(*) AS n_cells,
  CAST(sum(n_points) AS BIGINT) AS n_points, {_listed(_MEM)} FROM cells GROUP BY frame_id"""

# ------------------------------------------------------------- coarsening and comparison
ORACLES["decimate_l9"] = f"{GRID}, {_decimated(9, True, 'link')} SELECT {TIDY} FROM link"
ORACLES["decimate_l9_plain"] = f"{GRID}, {_decimated(9, False, 'link')} SELECT {TIDY} FROM link"
ORACLES["decimation_report"] = f"""{GRID}, {_decimated(9, True, 'link')}
SELECT frame_id, 9 AS max_level, 0.4e0 AS max_cell_m, CAST(sum(merged_from) AS BIGINT) AS cells_before,
  count(*) AS cells_after, CAST(sum(CASE WHEN kept THEN 0 ELSE merged_from END) AS BIGINT) AS merged_from,
  count(NOT kept OR NULL) AS merged_into, count(kept AND driver <> 0 OR NULL) AS preserved_risk_cells,
  true AS preserve_risk,
  {_listed(_MEM, "adaptive_bytes", "reduction_vs_dense", "reduction_vs_cloud", "reduction_vs_dense_3d")}
FROM link GROUP BY frame_id"""
_AB = f"""SELECT frame_id, '{{name}}' AS scenario, count(*) AS n_cells,
  CAST(sum(n_points) AS BIGINT) AS n_points, count(driver = 0 OR NULL) AS cells_range,
  count(driver = 1 OR NULL) AS cells_hazard, count(driver = 2 OR NULL) AS cells_low_confidence,
  count(driver = 3 OR NULL) AS cells_class_boundary, count({FAR} OR NULL) AS hazard_cells_beyond_fovea,
  round_even(quantile_cont({SIZE}, 0.5) FILTER (WHERE {FAR}), 3) AS median_hazard_cell_m,
  round_even(min({SIZE}) FILTER (WHERE {FAR}), 3) AS finest_hazard_cell_m,
  count(conf < 0.6e0 OR NULL) AS degraded_cells,
  {_listed(_MEM, "adaptive_bytes", "dense_uniform_bytes", "raw_cloud_bytes", "reduction_vs_dense",
           "reduction_vs_dense_3d", "reduction_vs_cloud")}
FROM {{source}} GROUP BY frame_id"""
ORACLES["ab_compare"] = f"""{GRID}, {_grid(False, "plain")}
{_AB.format(name="risk_adaptive", source="cells")}
UNION ALL {_AB.format(name="range_only", source="plain")}"""
_TIERS = [(n, keep) for n in (11, 10, 9, 8) for keep in (True, False)]
ORACLES["tier_matrix"] = (
    f"{GRID}, "
    + ", ".join(_decimated(n, keep, f"t{n}{'r' if keep else 'p'}") for n, keep in _TIERS)
    + " UNION ALL ".join(
        f""" SELECT frame_id, 'level{n}_{"risk_preserved" if keep else "plain"}' AS tier,
  round_even({204.8 / 2**n!r}e0, 3) AS max_cell_m, count(*) AS n_cells,
  CAST(sum(n_points) AS BIGINT) AS n_points,
  round_even(quantile_cont({SIZE}, 0.5) FILTER (WHERE {FAR}), 3) AS median_hazard_cell_m
FROM t{n}{"r" if keep else "p"} GROUP BY frame_id"""
        for n, keep in _TIERS
    )
)
_SIDE = f"""SELECT frame_id, CAST(sum(n_points) AS BIGINT) AS n_points, count(*) AS n_cells,
  count(driver <> 0 OR NULL) AS risk_driven_cells, count({HAZARD} OR NULL) AS hazard_cells,
  max({SIZE}) AS cell_size_max_m FROM {{source}} GROUP BY frame_id"""
ORACLES["onboard_vs_link"] = f"""{GRID}, {_decimated(9, True, 'link')},
full_side AS ({_SIDE.format(source="cells")}), link_side AS ({_SIDE.format(source="link")})
SELECT f.frame_id, f.n_points, {", ".join(
    f"{a}.{c} AS {tier}_{c}" for a, tier in (("f", "onboard"), ("l", "link"))
    for c in ("n_cells", "risk_driven_cells", "hazard_cells", "cell_size_max_m"))}
FROM full_side f JOIN link_side l ON f.frame_id = l.frame_id"""

# ------------------------------------------------------------- wire
_FIXED = """CAST(round_even(x / 0.025e0, 0) AS BIGINT) AS xq, CAST(round_even(y / 0.025e0, 0) AS BIGINT) AS yq,
  CAST(least(32767, greatest(-32768, round_even(z * 100e0, 0))) AS BIGINT) AS zq,
  CAST(least(255, greatest(0, round_even(conf * 255e0, 0))) AS BIGINT) AS confq"""
_PACKED = f"{GRID}, packed AS (SELECT *, {_FIXED} FROM cells)"
ORACLES["quantise_cells"] = f"{_PACKED} SELECT frame_id, code, level, cls, driver, xq, yq, zq, confq FROM packed"
ORACLES["dequantise_error"] = f"""{_PACKED} SELECT frame_id, count(*) AS n_cells,
  round(max(abs(xq * 0.025e0 - x)), 9) AS x_error, round(max(abs(yq * 0.025e0 - y)), 9) AS y_error,
  round(max(abs(zq / 100e0 - z)), 9) AS z_error, round(max(abs(confq / 255e0 - conf)), 9) AS conf_error
FROM packed GROUP BY frame_id"""
ORACLES["link_budget"] = f"""{GRID}, sized AS (
  SELECT frame_id, CAST(26 + count(*) * 10 AS BIGINT) AS wire_bytes FROM cells GROUP BY frame_id)
SELECT frame_id, wire_bytes, round_even(wire_bytes / 1024e0, 1) AS kb_per_frame,
  round_even(wire_bytes * 80e0 / 1000e0, 1) AS kbps, round_even(wire_bytes * 80e0 / 1e6, 3) AS mbps,
  wire_bytes * 80 <= 256000 AS fits_256kbps_link, wire_bytes * 80 <= 1000000 AS fits_1mbps_link FROM sized"""
ORACLES["unpack_roundtrip"] = f"""{_PACKED} SELECT frame_id, level, round(xq * 0.025e0, 9) AS x,
  round(yq * 0.025e0, 9) AS y, zq / 100e0 AS z, cls, confq / 255e0 AS conf, driver,
  {SIZE} AS size_m, CAST(NULL AS VARCHAR) AS error FROM packed"""

_RAW = "26 + count(*) * 10 + {tail}"
_SIZE_TAIL = """length('{"n_cells":' || count(*) || ',"cell_size_min_m":' || CAST(min(%s) AS VARCHAR)
  || ',"cell_size_max_m":' || CAST(max(%s) AS VARCHAR) || '}')""" % (SIZE, SIZE)


def _proved(keys: str, source: str, tail: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_cells, CAST({tail} AS BIGINT) AS tail_bytes,
  CAST({_RAW.format(tail=tail)} AS BIGINT) AS raw_bytes, true AS smaller FROM {source} GROUP BY frame_id"""


ORACLES["pack_frames"] = f"{GRID} {_proved('frame_id', 'cells', _SIZE_TAIL)}"
ORACLES["ab_wire"] = f"""{GRID}, {_grid(False, "plain")}
{_proved("frame_id, 'risk_adaptive' AS scenario", "cells", "2")}
UNION ALL {_proved("frame_id, 'range_only' AS scenario", "plain", "2")}"""
ORACLES["tier_wire"] = (
    f"{GRID}, "
    + ", ".join(_decimated(n, keep, f"t{n}{'r' if keep else 'p'}") for n, keep in _TIERS)
    + " UNION ALL ".join(
        " " + _proved(
            f"frame_id, 'level{n}_{'risk_preserved' if keep else 'plain'}' AS tier", f"t{n}{'r' if keep else 'p'}", "2"
        )
        for n, keep in _TIERS
    )
)
ORACLES["unpack_damaged"] = f"""{GRID} SELECT frame_id, CASE frame_id % 4 WHEN 1 THEN 'short_header'
    WHEN 2 THEN 'foreign_magic:6e6f6e65' WHEN 3 THEN 'short_body' END AS error,
  CASE WHEN frame_id % 4 = 0 THEN count(*) ELSE 0 END AS n_cells FROM cells GROUP BY frame_id"""

# ------------------------------------------------------------- views
_SEEN = f"""x - {SIZE} / 2 <= 60.01e0 AND x + {SIZE} / 2 >= -40.02e0
  AND y - {SIZE} / 2 <= 45.02e0 AND y + {SIZE} / 2 >= -30.03e0"""
ORACLES["viewport_cells"] = f"{GRID} SELECT {TIDY} FROM cells WHERE {_SEEN}"
ORACLES["viewport_lod"] = f"""{GRID} SELECT frame_id, code, level FROM cells
WHERE {_SEEN} AND {SIZE} * 20e0 >= 4e0"""
ORACLES["viewport_budget"] = f"""{GRID} SELECT frame_id, code, level FROM cells
WHERE {_SEEN} AND {SIZE} * 20e0 >= 4e0
QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY code, level) <= 300"""
ORACLES["elevation_histogram"] = f"""{GRID}, spans AS (
  SELECT frame_id, z, min(z) OVER (PARTITION BY frame_id) AS low, max(z) OVER (PARTITION BY frame_id) AS high
  FROM (SELECT frame_id, round(z, 9) AS z FROM cells) c)
SELECT frame_id, least(23, CAST(floor((z - low) / greatest(high - low, 0.01e0) * 24e0) AS INT)) AS bin,
  count(*) AS n_cells FROM spans GROUP BY ALL"""
ORACLES["confidence_histogram"] = f"""{GRID} SELECT frame_id,
  least(15, CAST(floor(conf * 16e0) AS INT)) AS bin, count(*) AS n_cells FROM cells GROUP BY ALL"""
ORACLES["hazard_clusters"] = f"""{GRID}, binned AS (
  SELECT frame_id, CAST(floor(x / 3e0 + 0.5e0) AS BIGINT) AS bin_x,
         CAST(floor(y / 3e0 + 0.5e0) AS BIGINT) AS bin_y, avg(x) AS x, avg(y) AS y, count(*) AS n_cells
  FROM cells c WHERE {HAZARD} GROUP BY 1, 2, 3)
SELECT frame_id, bin_x, bin_y, round(x, 9) AS x, round(y, 9) AS y, n_cells,
  round(sqrt(x * x + y * y), 9) AS range_m FROM binned"""

# ------------------------------------------------------------- objects and categories
_OBJECTS = f"""WITH tracks AS ({_sql(inputs.TRACKS)}),
times(frame_id, t) AS (VALUES (CAST(0 AS BIGINT), 0e0), (CAST(1 AS BIGINT), 3e0)),
placed AS (SELECT *, x0 + vx * t AS x, y0 + vy * t AS y FROM tracks, times WHERE cls IN (7, 8, 9)),
ranged AS (SELECT *, sqrt(x * x + y * y) AS rm FROM placed),
objects AS (SELECT frame_id, object_id, round_even(x, 2) AS x, round_even(y, 2) AS y,
  round_even(rm, 2) AS r, cls, round_even(radius * 2, 2) AS w, round_even(height, 2) AS h,
  round_even(sqrt(vx * vx + vy * vy), 2) AS speed,
  round_even(least(0.97e0, greatest(0.25e0, 0.95e0 - 0.006e0 * rm)), 3) AS score
  FROM ranged WHERE rm <= 100e0)"""
ORACLES["object_list"] = f"{_OBJECTS} SELECT * FROM objects ORDER BY frame_id, r, object_id"
ORACLES["nearest_objects"] = f"""{_OBJECTS} SELECT frame_id, object_id, r,
  CAST(row_number() OVER (PARTITION BY frame_id ORDER BY r, object_id) AS INT) AS rank FROM objects
QUALIFY rank <= 10"""
ORACLES["object_changes"] = f"""{_OBJECTS}, a AS (SELECT DISTINCT cls, r FROM objects WHERE frame_id = 0),
b AS (SELECT DISTINCT cls, r FROM objects WHERE frame_id = 1)
SELECT cls, r, 'gone' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) q
UNION ALL SELECT cls, r, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) q"""
_BRIDGE = """bridge(category, cls) AS (VALUES ('walls', 4), ('walls', 6), ('poles', 5), ('pedestrians', 7),
  ('pedestrians', 9), ('vehicles', 8))"""
ORACLES["category_coverage"] = f"""WITH {PTS}, {_BRIDGE}, wanted AS (SELECT * FROM bridge UNION ALL
  SELECT 'hazards', unnest([40, 41, 42, 43, 44]))
SELECT category, count(*) AS n_points, count(DISTINCT frame_id) AS n_frames
FROM pts p JOIN wanted w ON p.cls = w.cls GROUP BY category"""
ORACLES["missing_categories"] = f"""WITH {PTS}, {_BRIDGE}, seen AS (
  SELECT DISTINCT frame_id * 4096 + (point_idx >> 41) AS frame_id, cls FROM pts)
SELECT DISTINCT t.frame_id, b.category FROM seen t, bridge b WHERE NOT EXISTS (
  SELECT 1 FROM seen s JOIN bridge c ON s.cls = c.cls
  WHERE s.frame_id = t.frame_id AND c.category = b.category)"""

# ------------------------------------------------------------- telemetry
_ROLLED = f"""WITH timings AS ({_sql(inputs.TIMINGS)}), rolled AS (
  SELECT stream_id, frame_id, round(avg(frame_ms) OVER w, 9) AS frame_ms_mean,
    round(quantile_cont(frame_ms, 0.95) OVER w, 9) AS frame_ms_p95,
    round(avg(perception_ms) OVER w, 9) AS perception_ms_mean, round(avg(grid_ms) OVER w, 9) AS grid_ms_mean,
    round(avg(codec_ms) OVER w, 9) AS codec_ms_mean,
    CAST(floor(avg(wire_bytes) OVER w) AS BIGINT) AS wire_bytes_mean, count(frame_ms) OVER w AS samples,
    lag(frame_ms) OVER (PARTITION BY stream_id ORDER BY frame_id) AS newest_ms,
    count(frame_ms) OVER w AS history_len
  FROM timings WINDOW w AS (PARTITION BY stream_id ORDER BY frame_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""
ORACLES["rolling_stats"] = f"""{_ROLLED} SELECT *,
  round(1000e0 / nullif(frame_ms_mean, 0), 9) AS fps FROM rolled"""
ORACLES["rate_target"] = f"""{_ROLLED}, rated AS (
  SELECT *, round(1000e0 / nullif(frame_ms_mean, 0), 9) AS fps FROM rolled)
SELECT stream_id, frame_id, fps >= 20e0 AS met, round_even(abs(fps - 20e0), 1) AS margin_hz
FROM rated WHERE fps IS NOT NULL"""
_HELD = "max(seq) FILTER (WHERE setting = '{s}') OVER (PARTITION BY stream_id ORDER BY seq) AS at_{s}"
_DEFAULTS = {"conf_threshold": "0.6e0", "hazard_factor": "4e0", "link_tier": "NULL", "risk_adaptive": "1e0",
             "compress": "1e0", "hz": "10e0", "preserve_risk_on_link": "1e0"}
ORACLES["settings_asof"] = f"""WITH log AS ({_sql(inputs.COMMANDS)}), held AS (
  SELECT *, {", ".join(_HELD.format(s=s) for s in _DEFAULTS)} FROM log)
SELECT h.stream_id, h.seq, {", ".join(
    f"CASE WHEN at_{s} IS NULL THEN CAST({d} AS DOUBLE) ELSE l_{s}.value END AS {s}" for s, d in _DEFAULTS.items())}
FROM held h {" ".join(
    f"LEFT JOIN log l_{s} ON l_{s}.seq = at_{s} AND l_{s}.stream_id = h.stream_id" for s in _DEFAULTS)}
WHERE h.setting IS NULL"""

# ------------------------------------------------------------- evidence
_LEDGER = f"WITH ledger AS ({_sql(inputs.LEDGER)})"
ORACLES["edge_pivot"] = f"""{_LEDGER}, named AS (
  SELECT *, CASE WHEN suffix(metric, '_latency_ms') THEN 'latency_ms' WHEN suffix(metric, '_fps') THEN 'fps'
                 WHEN suffix(metric, '_peak_mem_MB') THEN 'peak_mem_mb' END AS col,
    regexp_replace(metric, '(_latency_ms|_fps|_peak_mem_MB)$', '') AS model FROM ledger WHERE tag = 'edge')
SELECT export_path, model, arg_max(value, seq) FILTER (WHERE col = 'latency_ms') AS latency_ms,
  arg_max(value, seq) FILTER (WHERE col = 'fps') AS fps,
  arg_max(value, seq) FILTER (WHERE col = 'peak_mem_mb') AS peak_mem_mb,
  arg_max(hardware, seq) AS hardware, arg_max(command, seq) AS command
FROM named WHERE col IS NOT NULL GROUP BY export_path, model"""
ORACLES["distance_report"] = f"""{_LEDGER}, cut AS (
  SELECT *, CASE WHEN contains(metric, '_mIoU_') THEN regexp_extract(metric, '^(.*)_mIoU_(.*)$', 1) ELSE '' END AS label,
    CASE WHEN contains(metric, '_mIoU_') THEN regexp_extract(metric, '^(.*)_mIoU_(.*)$', 2) ELSE metric END AS band
  FROM ledger WHERE tag = 'distance'),
firsts AS (SELECT export_path, label, arg_min(command, seq) AS command FROM cut GROUP BY ALL)
SELECT c.export_path, c.label, c.band, arg_max(c.value, c.seq) AS miou, max(f.command) AS command
FROM cut c JOIN firsts f ON c.export_path = f.export_path AND c.label = f.label
GROUP BY c.export_path, c.label, c.band"""
_CHECKS = f"WITH checks AS ({_sql(inputs.CHECKS)})"
ORACLES["checklist_rollup"] = f"""{_CHECKS}
SELECT export_path, split_part(check_id, '.', 1) AS phase, count(done OR NULL) AS done, count(*) AS total
FROM checks GROUP BY GROUPING SETS ((export_path, split_part(check_id, '.', 1)), (export_path))"""
ORACLES["evidence_status"] = f"""{_LEDGER}, checks AS ({_sql(inputs.CHECKS)}),
exports AS (SELECT export_path FROM ledger UNION SELECT export_path FROM checks),
proofs AS (SELECT DISTINCT export_path, tag AS block FROM ledger UNION SELECT export_path, 'checklist' FROM checks),
blocks(block) AS (VALUES ('per_class'), ('distance'), ('edge'), ('baselines'), ('segmentation'), ('checklist'))
SELECT e.export_path, b.block, CASE WHEN p.block IS NOT NULL THEN 'measured'
  WHEN b.block = 'checklist' THEN 'absent' ELSE 'not_measured' END AS status
FROM exports e CROSS JOIN blocks b LEFT JOIN proofs p ON p.export_path = e.export_path AND p.block = b.block"""

ORACLES["distance_runs"] = f"""{_LEDGER}, cut AS (
  SELECT *, CASE WHEN contains(metric, '_mIoU_') THEN regexp_extract(metric, '^(.*)_mIoU_(.*)$', 1) ELSE '' END AS label,
    CASE WHEN contains(metric, '_mIoU_') THEN regexp_extract(metric, '^(.*)_mIoU_(.*)$', 2) ELSE metric END AS band
  FROM ledger WHERE tag = 'distance' AND export_path NOT IN ('run0', 'run1')),
firsts AS (SELECT export_path, label, arg_min(command, seq) AS command FROM cut GROUP BY ALL)
SELECT c.export_path, c.label, c.band, arg_max(c.value, c.seq) AS miou, CAST(NULL AS BIGINT) AS n_scans,
  max(f.command) AS command
FROM cut c JOIN firsts f ON c.export_path = f.export_path AND c.label = f.label
GROUP BY c.export_path, c.label, c.band
UNION ALL SELECT 'run' || (event_id % 2), 'label' || event_id, band, value / share, user_id % 17, 'run-' || event_type
FROM events, (VALUES ('0-10m', 1), ('10-30m', 2)) b(band, share)"""
ORACLES["per_class_report"] = """WITH runs AS (SELECT *, 'run' || event_id AS export_path,
  CASE WHEN event_id % 4 <> 0 THEN event_type ELSE 'run' END AS label, 'mean' AS aggregation,
  'day' || (event_id % 9) AS created FROM events)
SELECT export_path, label, aggregation, created, 'walls' AS category, round(value, 9) AS seg_miou,
  CAST(NULL AS DOUBLE) AS det_ap,
  'wall ' || event_type || ', fence ' || (user_id % 3) || ', gate ' || event_type AS constituents FROM runs
UNION ALL SELECT export_path, label, aggregation, created, 'poles', NULL, round(value / 2, 9),
  'pole ' || (user_id % 3) FROM runs"""
ORACLES["segmentation_entries"] = f"""{_LEDGER}
SELECT export_path, seq, metric, value, command FROM ledger WHERE tag = 'segmentation'"""
_NAMED = """named AS (
  SELECT 'export' || event_id AS export_path, 'one' AS key, event_type AS name, '/ckpt/' || event_type AS checkpoint
  FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'export' || event_id, 'two', event_type, '/two' FROM events WHERE event_id % 3 <> 0)"""
ORACLES["named_baselines"] = f"WITH {_NAMED} SELECT * FROM named"
ORACLES["evidence_snapshot"] = f"""WITH {_NAMED}, exports AS (SELECT *, 'export' || event_id AS export_path FROM events),
proofs AS (SELECT DISTINCT export_path, 'baselines' AS block FROM named
  UNION SELECT export_path, CASE event_id % 4 WHEN 0 THEN 'edge' ELSE 'segmentation' END FROM exports
  WHERE event_id % 4 < 2),
blocks(block) AS (VALUES ('per_class'), ('distance'), ('edge'), ('baselines'), ('segmentation'), ('checklist'))
SELECT e.export_path, b.block, CASE WHEN p.block IS NOT NULL THEN 'measured'
    WHEN b.block = 'checklist' THEN 'absent' ELSE 'not_measured' END AS status,
  event_id % 11 <> 0 AS available, 'day' || (event_id % 9) AS generated,
  CASE WHEN event_id % 3 = 1 THEN event_type ELSE 'Jetson Orin Nano 8GB' END AS board,
  CASE WHEN event_id % 2 = 0 THEN event_type || '; few scans' END AS caveats,
  CASE WHEN event_id % 5 = 0 THEN 'better than ' || event_type END AS claims, p.block IS NULL AS told
FROM exports e CROSS JOIN blocks b LEFT JOIN proofs p ON p.export_path = e.export_path AND p.block = b.block"""

# ------------------------------------------------------------- quality
_CHECK = "SELECT frame_id, '{name}' AS \"check\", count({broken} OR NULL) AS violations FROM {source} GROUP BY frame_id"
_GAP = """, put AS (SELECT frame_id, count(*) AS n FROM pts WHERE abs(x) < 102.4e0 AND abs(y) < 102.4e0 GROUP BY 1),
got AS (SELECT frame_id, sum(n_points) AS m FROM {source} GROUP BY 1)
SELECT coalesce(p.frame_id, g.frame_id) AS frame_id, 'conservation' AS "check",
  CAST(abs(coalesce(n, 0) - coalesce(m, 0)) AS BIGINT) AS violations
FROM put p FULL JOIN got g ON p.frame_id = g.frame_id"""
ORACLES["check_conservation"] = GRID + _GAP.format(source=_spoilt("n_points", "n_points + 1", 97))
ORACLES["check_conservation_link"] = f"{GRID}, {_decimated(9, True, 'link')}" + _GAP.format(source="link WHERE code % 53 <> 0")
ORACLES["check_containment"] = f"""{GRID}, moved AS (SELECT * FROM {_spoilt("x", "x + 0.17e0", 7, "tagged_cells")}), placed AS (SELECT *,
  -102.4e0 + (({_compact("node", 1)}) + 0.5e0) * {SIZE} AS cx,
  -102.4e0 + (({_compact("node", 0)}) + 0.5e0) * {SIZE} AS cy FROM moved)
{_CHECK.format(name="containment", source="placed",
               broken=f"abs(x - cx) > {SIZE} / 2 + 1e-4 OR abs(y - cy) > {SIZE} / 2 + 1e-4")}"""
_OFF = " OR ".join(
    f"abs((({v} + 102.4e0) / {SIZE} - 0.5e0) - round(({v} + 102.4e0) / {SIZE} - 0.5e0, 0)) > 1e-6 OR abs({v}) >= 102.4e0"
    for v in ("x", "y")
)
ORACLES["check_lattice"] = f"{GRID} {_CHECK.format(name='lattice', source=_spoilt('y', 'y + 0.01e0', 31), broken=_OFF)}"
_RANGE = "sqrt(x * x + y * y)"
ORACLES["check_sizes"] = f"""{GRID} {_CHECK.format(name="sizes", source=_spoilt("level", "level - 3", 29), broken=(
    f"{SIZE} < 0.05e0 - 1e-9 OR level > 12 OR ({_RANGE} < 10e0 AND {SIZE} > 0.05e0 + 1e-9)"
    f" OR ({_RANGE} > 90e0 AND {SIZE} > 0.5e0 + 1e-9)"))}"""
_STEEP = "z_min > z + 1e-5 OR z > z_max + 1e-5"
ORACLES["check_elevation"] = f"{GRID} {_CHECK.format(name='elevation', source=_spoilt('z', 'z + 5e0', 37), broken=_STEEP)}"
ORACLES["check_elevation_link"] = (
    f"{GRID}, {_decimated(9, True, 'link')} {_CHECK.format(name='elevation', source=_spoilt('z', 'z - 5e0', 41, 'link'), broken=_STEEP)}"
)
ORACLES["check_range_only"] = (
    f"WITH {EDGED}, {_grid(False)} {_CHECK.format(name='range_only', source=_spoilt('driver', '1', 43), broken='driver <> 0')}"
)
ORACLES["check_roundtrip"] = f"""{GRID}, packed AS (SELECT *, {_FIXED}
  FROM {_spoilt("z", "z + 400e0", 47)}) {_CHECK.format(name="roundtrip", source="packed", broken=(
    "abs(xq * 0.025e0 - x) > 1e-6 OR abs(yq * 0.025e0 - y) > 1e-6 OR abs(zq / 100e0 - z) > 0.005e0 + 1e-9"
    " OR abs(confq / 255e0 - conf) > 1e0 / 255e0"))}"""
ORACLES["check_points"] = f"""WITH {PTS}, spoilt AS (SELECT frame_id, x, y,
  CASE WHEN conf > 0.93e0 THEN conf + 0.2e0 ELSE conf END AS conf, cls = 5 AS no_z,
  CASE WHEN frame_id % 2 = 1 THEN CAST(cls AS VARCHAR) ELSE source END AS source FROM pts)
SELECT frame_id, 'points' AS "check", count(NOT (conf BETWEEN 0 AND 1) OR no_z OR NULL)
  + CASE WHEN min(source) <> max(source) THEN 1 ELSE 0 END AS violations FROM spoilt GROUP BY frame_id"""
ORACLES["check_tail"] = f"""{GRID} SELECT frame_id, 'tail' AS "check", count(*) % 2 AS violations
FROM cells GROUP BY frame_id"""
ORACLES["check_sparse"] = f"""{GRID} SELECT frame_id, 'sparse' AS "check", count(n_points <= 0 OR NULL)
  + CASE WHEN count(*) * 100 >= 16000000 THEN 1 ELSE 0 END AS violations
FROM {_spoilt("n_points", "0", 59)} GROUP BY frame_id"""
ORACLES["check_hazard_depth"] = f"""{GRID} SELECT frame_id, 'hazard_depth' AS "check",
  CAST(coalesce(avg(z) FILTER (WHERE cls = 40) >= avg(z) FILTER (WHERE cls = 1), false) AS BIGINT) AS violations
FROM cells GROUP BY frame_id"""
_SIZES = (
    f"{SIZE} < 0.05e0 - 1e-9 OR level > 12 OR ({_RANGE} < 10e0 AND {SIZE} > 0.05e0 + 1e-9)"
    f" OR ({_RANGE} > 90e0 AND {SIZE} > 0.5e0 + 1e-9)"
)
_MOVED = (
    "abs(xq * 0.025e0 - x) > 1e-6 OR abs(yq * 0.025e0 - y) > 1e-6 OR abs(zq / 100e0 - z) > 0.005e0 + 1e-9"
    " OR abs(confq / 255e0 - conf) > 1e0 / 255e0"
)
ORACLES["cell_checks"] = f"""{GRID}, bad AS (SELECT * REPLACE (
  CASE WHEN code % 31 = 0 THEN y + 0.01e0 ELSE y END AS y, CASE WHEN code % 47 = 0 THEN z + 400e0 ELSE z END AS z,
  CASE WHEN code % 59 = 0 THEN 0 ELSE n_points END AS n_points) FROM cells),
packed AS (SELECT *, {_FIXED} FROM bad)
""" + " UNION ALL ".join(
    "(" + _CHECK.format(name=name, source="packed", broken=broken) + ")"
    for name, broken in (("lattice", _OFF), ("sizes", _SIZES), ("elevation", _STEEP), ("roundtrip", _MOVED))
) + """ UNION ALL SELECT frame_id, 'sparse', count(n_points <= 0 OR NULL)
  + CASE WHEN count(*) * 100 >= 16000000 THEN 1 ELSE 0 END FROM packed GROUP BY frame_id
UNION ALL SELECT frame_id, 'hazard_depth',
  CAST(coalesce(avg(z) FILTER (WHERE cls = 40) >= avg(z) FILTER (WHERE cls = 1), false) AS BIGINT)
FROM packed GROUP BY frame_id"""
