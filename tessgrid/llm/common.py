"""What several operators share: white space, word counts, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_blanks(text: Column) -> Column:
    """Text with every white-space character deleted. Byte searches are cheaper than a pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text)


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than white-space characters.

    Blanks at both ends are trimmed, so every split point separates two words.
    """
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared place named by spark.checkpoint.dir; a temporary one only where that
    is unset, as in tests on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = tempfile.mkdtemp(prefix="tessgrid-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Shuffle files go when the write that made them ends: what was written no longer needs them. Python tasks
#: get so many rows at a time at most, as rows hold whole texts.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"
BATCH_ROWS = 2048


@contextmanager
def tidy(spark: SparkSession, batch_rows: int = BATCH_ROWS, read_rows: int | None = None) -> Iterator[None]:
    """Writes inside drop their shuffle files at their end and hand Python tasks small batches. `read_rows`:
    rows of Parquet files that a task decodes at a time, where the usual 4,096 are too large."""
    wanted = {_CLEANUP: "true", _BATCH: str(batch_rows)} | ({_READ: str(read_rows)} if read_rows else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(
    df: DataFrame, compression: str | None = None, batch_rows: int = BATCH_ROWS, read_rows: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and safe from lost executors. `options`
    are those of the writer."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    write = df.write.options(**(options or {}))
    with tidy(spark, batch_rows, read_rows):
        (write.option("compression", compression) if compression else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` stored as _doc, one struct of all its columns whatever their names, and _row: a number of the
    stored row, which no other row bears."""
    return stored(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "zstd")


def one_per_group(rows: DataFrame, groups: DataFrame, first: list[Column]) -> DataFrame:
    """Of `numbered` rows one of each group, as it was. `groups` gives (_row, _group) for every row. The row
    that is least by `first` stays, then by doc_id with null last, then by _row."""
    doc_id = F.col("_doc.doc_id")
    order = F.struct(*first, doc_id.isNull(), doc_id.alias("doc_id"), "_row")
    kept = (
        rows.select("_row", order.alias("_order"))
        .join(groups.hint("merge"), "_row")
        .groupBy("_group")
        .agg(F.min("_order")["_row"].alias("_row"))
    )
    return rows.join(stored(kept.select("_row")).hint("merge"), "_row", "left_semi").select("_doc.*")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores added to those that are taken, in upper or lower case."""
    lower = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        found.append(name)
    return found
