"""Evidence exports and per-run result files: JSON with declared schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_SCHEMA = """
generated STRING, edge_board STRING, data_caveats ARRAY<STRING>,
checks MAP<STRING, STRUCT<text: STRING, done: BOOLEAN>>,
ledger ARRAY<STRUCT<metric: STRING, value: DOUBLE, unit: STRING, tag: STRING, command: STRING,
                    hardware: STRING>>,
baselines MAP<STRING, STRUCT<name: STRING, axis: STRING, checkpoint: STRING, config: STRING>>,
comparisons ARRAY<STRUCT<claim: STRING>>, _corrupt STRING
"""
RUN_SCHEMA = """
label STRING, n_scans LONG, command STRING, aggregation STRING, created STRING,
summary MAP<STRING, STRUCT<mIoU_dataset: DOUBLE>>,
rows ARRAY<STRUCT<ps_category: STRING, seg_mIoU: DOUBLE, det_AP: DOUBLE,
                  seg_constituents: MAP<STRING, STRING>, det_constituents: MAP<STRING, STRING>>>,
_corrupt STRING
"""
# File names of the two kinds of run, and the mark of a self-test
CLASS_RUNS = "ps_category_table_"
DISTANCE_RUNS = "distance_stratified_"
SELF_TEST = "SELFTEST"
# End of fixed values


def _json(spark: SparkSession, schema: str, path: str, pattern: str | None = None) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path).withColumn("path", F.input_file_name())


def _folder(path: str):
    return F.regexp_replace(path, "/[^/]*$", "")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """One row per export. An unreadable file keeps its row with every field null, so what it lacks is
    still reported as missing."""
    found = _json(spark, EXPORT_SCHEMA, path).withColumnRenamed("path", "export_path")
    fields = ["generated", "edge_board", "data_caveats", "checks", "ledger", "baselines", "comparisons"]
    readable = F.col("_corrupt").isNull()
    return found.select(
        "export_path",
        _folder("export_path").alias("folder"),
        *[F.when(readable, F.col(name)).alias(name) for name in fields],
        (readable & F.greatest(*[F.col(name).isNotNull() for name in fields])).alias("available"),
    )


def read_runs(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Run files of one kind. Unreadable and empty ones and self-tests are dropped."""
    found = _json(spark, RUN_SCHEMA, folder, f"{prefix}*.json")
    filled = F.greatest(
        *[F.col(name).isNotNull() for name in ("label", "n_scans", "command", "aggregation", "created",
                                                "summary", "rows")]
    )
    return found.where(
        F.col("_corrupt").isNull()
        & filled
        & ~F.coalesce("label", F.lit("")).contains(SELF_TEST)
    ).select(_folder("path").alias("folder"), "*").drop("_corrupt")


def for_exports(runs: DataFrame, exports: DataFrame) -> DataFrame:
    """Runs with the export they lie beside."""
    return exports.select("export_path", "folder").join(runs, "folder").drop("folder")


def ledger_of(exports: DataFrame) -> DataFrame:
    """Ledger entries with their position, long form."""
    return exports.select("export_path", F.posexplode("ledger").alias("seq", "e")).select(
        "export_path", F.col("seq").cast("long").alias("seq"), "e.*"
    )


def checks_of(exports: DataFrame) -> DataFrame:
    return exports.select("export_path", F.explode("checks").alias("check_id", "c")).select(
        "export_path", "check_id", "c.text", F.coalesce("c.done", F.lit(False)).alias("done")
    )
