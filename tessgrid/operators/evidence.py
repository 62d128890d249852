"""Reports on measured evidence, per export. A figure is reported only if an export holds it; what is
missing is named as missing, with the source that held nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric suffix -> column, board named when an export names none
EDGE_SUFFIXES = (
    ("_latency_ms", "latency_ms"),
    ("_fps", "fps"),
    ("_peak_mem_MB", "peak_mem_mb"),
)
BAND_MARK = "_mIoU_"
DEFAULT_BOARD = "Jetson Orin Nano 8GB"
# End of fixed values

# block -> where its rows come from; named in a report when nothing was found there
BLOCKS = {
    "per_class": "run files ps_category_table_*.json in the folder of the export",
    "distance": "run files distance_stratified_*.json in the folder of the export, or ledger tag distance",
    "edge": "ledger tag edge with a metric that ends in a board suffix",
    "baselines": "baselines of the export that have a checkpoint",
    "segmentation": "ledger tag segmentation",
    "checklist": "checks of the export",
}


def edge_report(ledger: DataFrame) -> DataFrame:
    """Board figures per model. Each column keeps its last ledger entry; hardware and command come from
    the last entry that names the model."""
    metric = F.col("metric")
    column, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, name in reversed(EDGE_SUFFIXES):
        ends = metric.endswith(suffix)
        column = F.when(ends, F.lit(name)).otherwise(column)
        model = F.when(ends, F.expr(f"left(metric, length(metric) - {len(suffix)})")).otherwise(model)
    named = (
        ledger.where(F.col("tag") == "edge")
        .withColumn("column", column)
        .withColumn("model", model)
        .where(F.col("column").isNotNull())
    )
    return named.groupBy("export_path", "model").agg(
        *[
            F.max_by("value", F.when(F.col("column") == name, F.col("seq"))).alias(name)
            for _, name in EDGE_SUFFIXES
        ],
        F.max_by("hardware", "seq").alias("hardware"),
        F.max_by("command", "seq").alias("command"),
    )


def distance_report(ledger: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Accuracy by range band. An export with run files is reported from those alone, any other from
    its ledger, where the metric is `label`, the mark, `band`, split at the last mark."""
    split = r"^(.*)" + BAND_MARK + r"(.*)$"
    marked = F.col("metric").contains(BAND_MARK)
    entries = (
        ledger.where(F.col("tag") == "distance")
        .withColumn(
            "label", F.when(marked, F.regexp_extract("metric", split, 1)).otherwise(F.lit(""))
        )
        .withColumn("band", F.when(marked, F.regexp_extract("metric", split, 2)).otherwise(F.col("metric")))
    )
    # The label's command is its first entry's, each band keeps its last value.
    per_band = entries.groupBy("export_path", "label", "band").agg(
        F.max_by("value", "seq").alias("miou"),
        F.min_by("command", "seq").alias("command"),
        F.min("seq").alias("since"),
    )
    commands = per_band.groupBy("export_path", "label").agg(F.min_by("command", "since").alias("command"))
    fallback = per_band.drop("command").join(commands, ["export_path", "label"]).select(
        "export_path", "label", "band", "miou", F.lit(None).cast("long").alias("n_scans"), "command"
    )
    if runs is None:
        return fallback
    measured = runs.select(
        "export_path", "label", "n_scans", "command", F.explode_outer("summary").alias("band", "v")
    ).select("export_path", "label", "band", F.col("v.mIoU_dataset").alias("miou"), "n_scans", "command")
    return measured.unionByName(
        fallback.join(runs.select("export_path").distinct(), "export_path", "left_anti")
    )


def _joined(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")


def per_class_report(runs: DataFrame) -> DataFrame:
    """Accuracy per named category and run, its constituent classes as one string. A constituent listed
    for both tasks keeps its place and takes the detection figure."""
    none = F.create_map().cast("map<string,string>")
    seg = F.coalesce("r.seg_constituents", none)
    det = F.coalesce("r.det_constituents", none)
    updated = F.transform_values(seg, lambda k, v: F.coalesce(F.try_element_at(det, k), v))
    added = F.map_filter(det, lambda k, v: ~F.map_contains_key(seg, k))
    parts = F.concat(F.map_entries(updated), F.map_entries(added))
    return runs.select(
        "export_path",
        F.coalesce("label", F.lit("run")).alias("label"),
        "aggregation",
        "created",
        F.explode_outer("rows").alias("r"),
    ).select(
        "export_path",
        "label",
        "aggregation",
        "created",
        F.col("r.ps_category").alias("category"),
        F.col("r.seg_mIoU").alias("seg_miou"),
        F.col("r.det_AP").alias("det_ap"),
        _joined(parts).alias("constituents"),
    )


def checklist_rollup(checks: DataFrame) -> DataFrame:
    """Checks done and listed per phase (the id before its first dot) and, as phase null, overall."""
    return (
        checks.withColumn("phase", F.split("check_id", r"\.", 2)[0])
        .groupingSets([["export_path", "phase"], ["export_path"]], "export_path", "phase")
        .agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("total"))
    )


def named_baselines(exports: DataFrame) -> DataFrame:
    """Baselines that name their checkpoint."""
    listed = exports.select("export_path", F.explode("baselines").alias("key", "b"))
    return listed.where(F.coalesce("b.checkpoint", F.lit("")) != "").select("export_path", "key", "b.*")


def segmentation_entries(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("tag") == "segmentation")


def _board() -> Column:
    return F.coalesce(F.when(F.col("edge_board") != "", F.col("edge_board")), F.lit(DEFAULT_BOARD))


def board(exports: DataFrame) -> DataFrame:
    return exports.select("export_path", _board().alias("board"))


def evidence_status(proofs: DataFrame, blocks: dict[str, str] = BLOCKS) -> DataFrame:
    """Every block of every export: `measured`, or not, then with the source that held nothing.

    `proofs` holds (export_path, block), any number of rows for a block that has some; a block null
    names an export that may have none. One pass: an export is one row with a flag per block.
    """
    flags = [F.max(F.coalesce(F.col("block") == b, F.lit(False))).alias(f"has_{b}") for b in blocks]
    listed = F.array(
        *[
            F.struct(F.lit(b).alias("block"), F.lit(source).alias("source"), F.col(f"has_{b}").alias("found"))
            for b, source in blocks.items()
        ]
    )
    told = proofs.groupBy("export_path").agg(*flags).select("export_path", F.explode(listed).alias("b"))
    missing = F.when(F.col("b.block") == "checklist", "absent").otherwise("not_measured")
    return told.select(
        "export_path",
        "b.block",
        F.when(F.col("b.found"), "measured").otherwise(missing).alias("status"),
        F.when(~F.col("b.found"), F.col("b.source")).alias("missing"),
    )


def evidence_snapshot(exports: DataFrame, proofs: DataFrame, blocks: dict[str, str] = BLOCKS) -> DataFrame:
    """Status of every block of every export, with what the export says of itself: whether it could be
    read, when it was generated, its board, caveats and the claims of its comparisons."""
    known = exports.select("export_path", F.lit(None).cast("string").alias("block"))
    told = evidence_status(known.unionByName(proofs.select("export_path", "block")), blocks)
    about = exports.select(
        "export_path", "available", "generated", _board().alias("board"), "data_caveats",
        F.transform("comparisons", lambda c: c["claim"]).alias("claims"),
    )
    return told.join(about, "export_path")


def proofs_of(
    exports: DataFrame, class_runs: DataFrame, distance_runs: DataFrame, ledger: DataFrame, checks: DataFrame
) -> DataFrame:
    """(export_path, block) for what was read from disk. A block of the ledger is named by its tag."""
    tagged = ledger.where(F.col("tag").isin("distance", "edge", "segmentation"))
    found = tagged.select("export_path", F.col("tag").alias("block"))
    for block, rows in (
        ("per_class", class_runs), ("distance", distance_runs), ("baselines", named_baselines(exports)),
        ("checklist", checks),
    ):
        found = found.unionByName(rows.select("export_path", F.lit(block).alias("block")))
    return found
