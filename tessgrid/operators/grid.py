"""Points to quadtree cells.

A point asks for a level; a node whose points all ask for its level or coarser is a leaf. Node maxima
never grow on the way down while the bound does, so the leaf of a point is the smallest level L whose
node maximum is <= L, and no recursion is needed.

Work is spread by place, never by frame or by cell alone, so that one huge frame or one huge cell costs
no single task its whole size:

* a *run* is (frame, finest cell, point_idx >> run_bits). Indices are unique in a frame, so a run holds
  at most 2**run_bits points. Class changes between neighbouring points are found inside runs.
* a *tile* is a node at `params.tile_level`, no finer than any leaf: 1,024 finest cells with the default
  parameters. A tile therefore gathers at most 1,024 rows for every 2**run_bits points of its frame. Runs are shuffled by (frame, tile) once; neighbours across runs, node maxima
  of every level and the cell aggregates are all computed in that one partitioning and one sort order.
* the class change across a tile edge needs the last class of the tile before and the first of the tile
  after. Both come from a per-tile summary of the runs, read from the same shuffle; at most
  4**tile_level rows per frame.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.functions import risk, spatial
from tessgrid.operators.layout import gathered
from tessgrid.params import GridParams

TILE = ["frame_id", "tile"]
RUN = ["frame_id", "code", "run"]
TALLIES = ["n", "sum_z", "min_z", "max_z", "sum_conf"]
CELL_COLUMNS = [
    "frame_id", "code", "level", "x", "y", "z", "z_min", "z_max", "cls", "conf", "driver", "n_points",
]


def _key(i: int) -> str:
    return f"key_{i}"


def _risky(i: int) -> str:
    return f"risky_{i}"


def keyed_points(
    points: DataFrame,
    scenarios: list[GridParams],
    overrides: dict[str, str] | None = None,
    carry: list[str] = (),
) -> DataFrame:
    """Crop to the root square and give each point its code, tile, run and, per scenario, the refinement
    key it asks for off a class boundary (`key_i`) and whether the boundary rule applies (`risky_i`)."""
    p = scenarios[0]
    # What is known not to be null needs no null checks in the generated code, which must stay small.
    placed = (
        points.where(
            spatial.in_root(F.col("x"), F.col("y"), p)
            & F.col("frame_id").isNotNull()
            & F.col("point_idx").isNotNull()
        )
        .withColumns(
            {
                "cls": risk.class_id(F.col("cls")),
                "ix": spatial.grid_index(F.col("x"), p),
                "iy": spatial.grid_index(F.col("y"), p),
                "range_m": spatial.polar_range(F.col("x"), F.col("y")),
            }
        )
        .withColumns(
            {
                "code": spatial.morton_encode(F.col("ix"), F.col("iy"), p.max_depth),
                "base_m": spatial.target_size(F.col("range_m"), p),
            }
        )
    )
    keys = {}
    for i, scenario in enumerate(scenarios):
        settings = risk.RiskSettings.of(scenario, overrides)
        level, priority = risk.required_level(
            F.col("base_m"), F.col("cls"), F.col("conf"), scenario, settings
        )
        keys[_key(i)] = risk.refinement_key(level, priority)
        keys[_risky(i)] = settings.risk_adaptive
    return placed.select(
        "frame_id",
        "point_idx",
        "code",
        spatial.prefix(F.col("code"), p.tile_level, p).alias("tile"),
        F.shiftright("point_idx", p.run_bits).alias("run"),
        "z",
        "cls",
        "conf",
        *carry,
        *[c.alias(name) for name, c in keys.items()],
    )


def _with_run_neighbours(keyed: DataFrame) -> DataFrame:
    """Class before and after each point in its run; null at the two ends of the run."""
    order = Window.partitionBy(*RUN).orderBy("point_idx")
    return keyed.withColumn("before", F.lag("cls").over(order)).withColumn(
        "after", F.lead("cls").over(order)
    )


def _differs(neighbour: Column, own: Column) -> Column:
    """False where there is no neighbour."""
    return F.coalesce(neighbour != own, F.lit(False))


def _edge_key(i: int, params: GridParams) -> Column:
    return risk.boundary_key(F.col(_key(i)), params, F.col(_risky(i)))


def _class_runs(keyed: DataFrame, params: list[GridParams], by_run: bool, carry: list[str] = ()) -> DataFrame:
    """Tallies per (run, class), or per (cell, class) where neighbours do not matter.

    With `by_run`, `head` marks the row that holds the run's first point; that row also knows the first
    and the last class of the run. `first_key_i` / `last_key_i` are set on the rows that hold the first
    and the last point: what that point asks for if its outer neighbour has another class.
    """
    scenarios = range(len(params))
    tallies = [
        F.count(F.lit(1)).alias("n"),
        F.sum("z").alias("sum_z"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
        F.sum("conf").alias("sum_conf"),
    ]
    if not by_run:
        return keyed.groupBy(*TILE, "code", "cls").agg(
            *tallies, *[F.max(_key(i)).alias(_key(i)) for i in scenarios]
        )
    whole_run = (
        Window.partitionBy(*RUN)
        .orderBy("point_idx")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first, last = F.col("before").isNull(), F.col("after").isNull()
    inner = _differs(F.col("before"), F.col("cls")) | _differs(F.col("after"), F.col("cls"))
    found = [
        F.max(first).alias("head"),
        F.max(F.when(first, F.col("cls"))).alias("first_cls"),
        F.max(F.when(first, F.col("closing_cls"))).alias("last_cls"),
    ]
    for i in scenarios:
        key, edge = F.col(_key(i)), _edge_key(i, params[i])
        found.append(F.max(F.when(inner, edge).otherwise(key)).alias(_key(i)))
        found.append(F.max(F.when(first, edge)).alias(f"first_key_{i}"))
        found.append(F.max(F.when(last, edge)).alias(f"last_key_{i}"))
    return (
        _with_run_neighbours(keyed)
        .withColumn("closing_cls", F.last("cls").over(whole_run))
        .groupBy(*RUN, "tile", *carry, "cls")
        .agg(*tallies, *found)
    )


def by_tile(runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Runs gathered by tile, once: the tile summary and the neighbour windows read the same shuffle.

    A shuffle is shared only by readers that want the same columns, so `head`, which both need, is made
    to depend on every column. The comparison holds for any hash.
    """
    whole = F.xxhash64(*runs.columns) >= F.lit(-(2**63))
    return gathered(runs, tasks, *TILE).withColumn("head", F.col("head") & whole)


def tile_edges(runs: DataFrame, params: GridParams, tasks: int | None = None) -> DataFrame:
    """Per tile, the last class of the occupied tile before it and the first class of the one after.
    `runs` comes from `by_tile` and has head, first_cls and last_cls. Frames are dealt to `tasks` partitions."""
    spare = 63 - 2 * (params.max_depth - params.tile_level)
    in_tile = F.col("code") - F.shiftleft("tile", 63 - spare)
    # One LONG for (code in tile, run) keeps this a hash aggregate.
    run_bits = spare - params.run_bits
    at = F.when(
        F.col("run").between(0, 2**run_bits - 1), F.shiftleft(in_tile, run_bits).bitwiseOR(F.col("run"))
    ).otherwise(F.raise_error(F.lit(f"point_idx must be in 0..2**{spare} - 1")).cast("long"))
    ends = runs.groupBy(*TILE).agg(
        F.min_by("first_cls", F.when(F.col("head"), at)).alias("opens"),
        F.max_by("last_cls", F.when(F.col("head"), at)).alias("closes"),
    )
    if tasks:
        ends = gathered(ends, tasks, "frame_id")
    along = Window.partitionBy("frame_id").orderBy("tile")
    return ends.select(
        *TILE,
        F.lag("closes").over(along).alias("tile_before"),
        F.lead("opens").over(along).alias("tile_after"),
    )


def _node_levels(params: GridParams) -> list[int]:
    """Levels below the tile at which a leaf may lie, short of the finest cell, which is its own node."""
    return list(range(max(params.coarsest_leaf, params.tile_level + 1), params.max_depth))


def _nested_nodes(df: DataFrame, params: GridParams) -> tuple[DataFrame, list[str]]:
    """Node columns from coarse to fine, the finest cell last. As partition keys listed in this order
    they share one sort."""
    nodes = {
        f"node_{level}": spatial.prefix(F.col("code"), level, params) for level in _node_levels(params)
    }
    return df.withColumns(nodes), [*nodes, "code"]


def _with_neighbour_classes(runs: DataFrame, edges: DataFrame, nodes: list[str]) -> DataFrame:
    """Adds `run_before` / `run_after`: the class on either side of the run in (code, point_idx) order.
    Only head rows offer a value, so other rows of a run are skipped on the way to its neighbours."""
    order = ", ".join([*nodes, "run", "head DESC"])
    along = f"IGNORE NULLS OVER (PARTITION BY {', '.join(TILE)} ORDER BY {order})"
    # Two ids per tile against the runs of the tile: hashing the tiles leaves the runs unsorted until the
    # one sort below. Size estimates of such a summary are far too low to leave a broadcast to them.
    return (
        runs.join(edges.hint("shuffle_hash"), TILE)
        .withColumns(
            {
                "closed_by": F.when(F.col("head"), F.col("last_cls")),
                "opened_by": F.when(F.col("head"), F.col("first_cls")),
            }
        )
        .withColumns(
            {
                "run_before": F.expr(f"coalesce(lag(closed_by) {along}, tile_before)"),
                "run_after": F.expr(f"coalesce(lead(opened_by) {along}, tile_after)"),
            }
        )
    )


def leaf_runs(
    points: DataFrame,
    scenarios: list[GridParams],
    overrides: dict[str, str] | None = None,
    by_run: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """(run, class) tallies with `leaf_i`, the level of the leaf they belong to, per scenario. The largest
    `key_i` among the rows of a leaf tells its driver. Points are dealt to `tasks` partitions by run, runs
    to as many by tile."""
    keyed = keyed_points(points, scenarios, overrides)
    risky = any(s.risk_adaptive for s in scenarios) or "risk_adaptive" in (overrides or {})
    if tasks and (by_run or risky):
        keyed = gathered(keyed, tasks, *RUN)
    runs = _class_runs(keyed, scenarios, by_run or risky)
    if by_run:
        runs = runs.drop(*TALLIES)
    return _with_leaves(runs, scenarios, risky, tasks)


def _with_leaves(
    runs: DataFrame, scenarios: list[GridParams], risky: bool, tasks: int | None = None
) -> DataFrame:
    """Adds `leaf_i` to class runs, once what lies across the edges of runs is known."""
    p = scenarios[0]
    if tasks and not risky:
        runs = gathered(runs, tasks, *TILE)
    if risky:
        runs = by_tile(runs, tasks)
        edges = tile_edges(runs, p, tasks)
    runs, nodes = _nested_nodes(runs, p)
    if risky:
        runs = _with_neighbour_classes(runs, edges, nodes)
        enters = _differs(F.col("run_before"), F.col("cls"))
        leaves = _differs(F.col("run_after"), F.col("cls"))
        runs = runs.withColumns(
            {
                _key(i): F.greatest(
                    F.col(_key(i)),
                    F.when(enters, F.col(f"first_key_{i}")),
                    F.when(leaves, F.col(f"last_key_{i}")),
                )
                for i in range(len(scenarios))
            }
        )
    # Deepest node first: every coarser window then finds its rows already in order. The finest level
    # needs none, as what is no leaf above it is one there.
    levels = list(range(p.coarsest_leaf, p.max_depth))
    for level in reversed(levels):
        within = [f"node_{n}" for n in _node_levels(p) if n <= level]
        node = Window.partitionBy(*TILE, *within)
        runs = runs.withColumns(
            {f"node_key_{i}_{level}": F.max(_key(i)).over(node) for i in range(len(scenarios))}
        )

    def leaf(i: int) -> Column:
        done = [
            F.when(risk.key_level(F.col(f"node_key_{i}_{level}")) <= level, F.lit(level))
            for level in levels
        ]
        return F.coalesce(*done, F.lit(p.max_depth))

    return runs.withColumns({f"leaf_{i}": leaf(i) for i in range(len(scenarios))})


def majority_rank(n: Column, cls: Column) -> Column:
    """Orders classes by votes, the smaller class id first on a tie. One LONG, which a hash aggregate
    can hold."""
    return n * F.lit(256) + (F.lit(255) - cls)


def _cells(leaves: DataFrame, params: GridParams, extra: list[str]) -> DataFrame:
    """Aggregate (run, class) tallies that carry (level, key) into cells. Every key starts with
    (frame, tile), so no row moves."""
    keys = [*TILE, *extra, "level", "node"]
    node = spatial.prefix_at(F.col("code"), F.col("level"), params)
    per_class = (
        leaves.withColumn("node", node)
        .groupBy(*keys, "cls")
        .agg(
            F.sum("n").alias("n"),
            F.sum("sum_z").alias("sum_z"),
            F.min("min_z").alias("min_z"),
            F.max("max_z").alias("max_z"),
            F.sum("sum_conf").alias("sum_conf"),
            F.min("code").alias("code"),
            F.max("key").alias("key"),
        )
    )
    cells = per_class.groupBy(*keys).agg(
        F.min("code").alias("code"),
        (F.sum("sum_z") / F.sum("n")).alias("z"),
        F.min("min_z").alias("z_min"),
        F.max("max_z").alias("z_max"),
        F.max_by("cls", majority_rank(F.col("n"), F.col("cls"))).alias("cls"),
        (F.sum("sum_conf") / F.sum("n")).alias("conf"),
        risk.key_driver(F.max("key")).alias("driver"),
        F.sum("n").alias("n_points"),
    )
    x, y = spatial.cell_centre(F.col("node"), F.col("level"), params)
    return cells.withColumns({"x": x, "y": y}).select("tile", *extra, *CELL_COLUMNS)


def adaptive_grid(
    points: DataFrame,
    params: GridParams = GridParams(),
    overrides: dict[str, str] | None = None,
    keep_tile: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Cells of every frame in `points`.

    `overrides` maps a setting (`risk_adaptive`, `conf_threshold`, `hazard_factor`) to a column of
    `points` that sets it per row. `keep_tile` leaves the `tile` column in, which lets a following
    `decimate` reuse the partitioning. `tasks`, what `layout.tasks_for` says of the points, keeps what a
    task holds the same however many points there are; without it the session's number of partitions
    is used.
    """
    leaves = leaf_runs(points, [params], overrides, tasks=tasks)
    cells = _cells(
        leaves.withColumnsRenamed({"leaf_0": "level", _key(0): "key"}), params, []
    )
    return cells if keep_tile else cells.drop("tile")


def part_runs(points: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """Class runs of a part of some frames' points, to be stored and put together with those of other parts by
    `grid_of_parts`. A run is named by its first point index and ends at `run_end`."""
    keyed = keyed_points(points, [params])
    if not params.risk_adaptive:
        return _class_runs(keyed, [params], False)
    whole = Window.partitionBy(*RUN)
    ends = {"_first": F.min("point_idx").over(whole), "run_end": F.max("point_idx").over(whole)}
    told = keyed.withColumns(ends)
    runs = _class_runs(told, [params], True, ["_first", "run_end"])
    return runs.drop("run").withColumnRenamed("_first", "run")


def grid_of_parts(parts: DataFrame, params: GridParams = GridParams(), keep_tile: bool = False) -> DataFrame:
    """Cells of frames whose points came in parts. `parts` are the rows of `part_runs` for all of them; the
    points are not needed any more.

    Within a finest cell, the parts must hold one stretch of point indices after the other, as files that
    each hold a stretch of a scan do; where two overlap, the order of classes is lost and an error tells so.
    """
    if params.risk_adaptive:
        cell = Window.partitionBy("frame_id", "code").orderBy("run")
        before = F.max("run_end").over(cell.rangeBetween(Window.unboundedPreceding, -1))
        clash = F.coalesce(before >= F.col("run"), F.lit(False))
        said = F.concat(F.lit("parts of frame "), F.col("frame_id").cast("string"), F.lit(" overlap in point_idx"))
        parts = parts.withColumn("n", F.when(clash, F.raise_error(said).cast("long")).otherwise(F.col("n")))
        parts = parts.drop("run_end")
    else:
        keys = [*TILE, "code", "cls"]
        sums = [F.sum("n").alias("n"), F.sum("sum_z").alias("sum_z"), F.min("min_z").alias("min_z"),
                F.max("max_z").alias("max_z"), F.sum("sum_conf").alias("sum_conf"), F.max(_key(0)).alias(_key(0))]
        parts = parts.groupBy(*keys).agg(*sums)
    # Runs are named by point indices here, not by blocks of them.
    leaves = _with_leaves(parts, [replace(params, run_bits=0)], params.risk_adaptive)
    cells = _cells(leaves.withColumnsRenamed({"leaf_0": "level", _key(0): "key"}), params, [])
    return cells if keep_tile else cells.drop("tile")


def scenario_grids(
    points: DataFrame, scenarios: dict[str, GridParams], tasks: int | None = None
) -> DataFrame:
    """Cells of the same frames under several parameter sets that share one geometry, in one pass: the
    points are shuffled once, and only finished runs fan out, one copy per scenario."""
    named = list(scenarios.items())
    base = named[0][1]
    for _, other in named:
        if (other.root_size_m, other.max_depth, other.tile_level, other.run_bits) != (
            base.root_size_m, base.max_depth, base.tile_level, base.run_bits,
        ):
            raise ValueError("scenarios must share geometry and layout")
    leaves = leaf_runs(points, [p for _, p in named], tasks=tasks)
    variants = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.col(f"leaf_{i}").alias("level"),
                F.col(_key(i)).alias("key"),
            )
            for i, (name, _) in enumerate(named)
        ]
    )
    tallies = [*TILE, "code", "cls", "n", "sum_z", "min_z", "max_z", "sum_conf"]
    fanned = leaves.select(*tallies, F.explode(variants).alias("v")).select(
        *tallies, "v.scenario", "v.level", "v.key"
    )
    return _cells(fanned, base, ["scenario"]).drop("tile")


def required_levels(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """Level and priority each point asks for, class boundaries included."""
    keyed = keyed_points(points, [params])
    key = F.col("key_0")
    if params.risk_adaptive:
        keyed = _flag_edges(keyed, params, tasks)
        key = F.when(F.col("edge"), _edge_key(0, params)).otherwise(key)
    return keyed.select(
        "frame_id",
        "point_idx",
        "code",
        risk.key_level(key).alias("level"),
        key.bitwiseAND(F.lit(7)).alias("priority"),
    )


def _flag_edges(keyed: DataFrame, params: GridParams, tasks: int | None = None) -> DataFrame:
    """Adds `edge` to every keyed point. Only the two ends of a run need to look outside it."""
    if tasks:
        keyed = gathered(keyed, tasks, *RUN)
    ends = keyed.groupBy(*RUN, "tile").agg(
        F.min_by("cls", "point_idx").alias("first_cls"),
        F.max_by("cls", "point_idx").alias("last_cls"),
    )
    by_place = by_tile(ends.withColumn("head", F.lit(True)), tasks)
    ends, nodes = _nested_nodes(by_place, params)
    around = _with_neighbour_classes(ends, tile_edges(by_place, params, tasks), nodes).select(
        *RUN, "run_before", "run_after"
    )
    return (
        _with_run_neighbours(keyed)
        .join(around.hint("merge"), RUN)
        .withColumn(
            "edge",
            _differs(F.coalesce("before", "run_before"), F.col("cls"))
            | _differs(F.coalesce("after", "run_after"), F.col("cls")),
        )
    )


def class_edges(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """Points whose class differs from their neighbour's in (Morton code, point index) order."""
    return _flag_edges(keyed_points(points, [params]), params, tasks).select(
        "frame_id", "point_idx", "code", "cls", "edge"
    )


def assign_points(
    points: DataFrame, params: GridParams = GridParams(), tasks: int | None = None
) -> DataFrame:
    """Each point with its one leaf. Joined per run, so no key holds more points than a run does."""
    leaves = leaf_runs(points, [params], by_run=True, tasks=tasks)
    node = spatial.prefix_at(F.col("code"), F.col("level"), params)
    top = F.max(_key(0)).over(Window.partitionBy(*TILE, "level", "node"))
    leaves = (
        leaves.withColumn("level", F.col("leaf_0"))
        .withColumn("node", node)
        .withColumn("driver", risk.key_driver(top))
        .where("head")
        .select(*RUN, "level", "node", "driver")
    )
    keyed = keyed_points(points, [params], carry=["x", "y"])
    if tasks:
        keyed = gathered(keyed, tasks, *RUN)
    return keyed.join(leaves.hint("merge"), RUN).select(
        "frame_id", "point_idx", "x", "y", "z", "code", "level", "node", "driver"
    )
