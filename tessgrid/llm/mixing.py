"""Mix sources to target weights by hash thresholds.

Every document has a hash of its id. Sizes are summed by (source, leading hash bits); running sums over
those buckets tell how far down the hash range a source's budget reaches. Only the bucket in which the
budget ends is looked at again with the next bits. Taking a document is then one comparison: no sort,
no draw, the same answer on every run, and a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import stored, whole_text, word_count

#: Weights by source in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix per 100 words of the input, and how often a source may be used.
SHARE_PERCENT, MOST_REPEATS = 150, 2
#: Hash bits per refinement and number of refinements.
BITS, LEVELS = 10, 4


def id_hash(doc_id: str | Column = "doc_id", place: Column | None = None) -> Column:
    """The first BITS * LEVELS bits of the md5 of the id as text. A null id has the hash of its row's place, so
    that rows without an id do not come all or nothing."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    other = F.lit("") if place is None else F.concat(F.lit("row "), place.cast("string"))
    text = F.coalesce(key.cast("string"), other)
    return F.conv(F.substring(F.md5(text), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """source, source_size, target. A target stops at `most_repeats` times its source; what is left
    over goes to the others by weight until none is above its bound. In order of bounds, the level of a source is what a unit of
    weight gets if all sources before it are capped; of the levels that respect their source's bound the
    largest holds. One row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    up = Window.orderBy("bound", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    most = F.lit(most_repeats) * F.col("source_size")
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_from")
    return (
        by_source.withColumn("weight", weight.cast("long"))
        .withColumn("bound", most / F.col("weight"))
        .withColumns(
            {
                "budget": F.lit(share_percent) * F.sum("source_size").over(everything) / F.lit(100.0),
                "capped_before": F.coalesce(
                    F.sum(most).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "weight_from": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
            }
        )
        .withColumn("level", F.max(F.when(level <= F.col("bound"), level)).over(everything))
        .select(
            "source",
            "source_size",
            F.least(
                most.cast("double"),
                F.coalesce(F.col("level") * F.col("weight"), most.cast("double")),
            ).alias("target"),
        )
    )


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies every document gives), below (documents with a hash
    below it give one more). `hashed`: source, size, h."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = ["source", "source_size", "target", "whole"]
    found = targets.withColumn("whole", whole.cast("long")).select(
        *goals,
        F.lit(0).cast("long").alias("prefix"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
    )
    for at in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - at)
        edge = found.select(F.col("source").alias("_s"), "prefix")
        inside = hashed.join(
            edge,
            F.col("source").eqNullSafe(F.col("_s"))
            & (F.shiftright("h", shift + BITS) == F.col("prefix")),
        )
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        along = Window.partitionBy("source").orderBy("bucket")
        running = buckets.withColumn("upto", F.sum("words").over(along))
        ends = running.select(F.col("source").alias("_s"), "bucket", "upto", "words").join(
            found.select(F.col("source").alias("_t"), "left"), F.col("_s").eqNullSafe(F.col("_t"))
        )
        # The first bucket that would pass the budget; past the last one, nothing is left to refine.
        passing = ends.where("upto > left").groupBy("_s").agg(
            F.min("bucket").alias("next"),
            F.min(F.col("upto") - F.col("words")).alias("used"),
            F.min_by("words", "bucket").alias("at_edge"),
        )
        found = found.join(passing, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            *goals,
            F.coalesce("next", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
            (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            F.coalesce("at_edge", F.lit(0)).alias("words"),
        )
        found = stored(found)
    # The last bucket goes in if that comes closer to the target than leaving it out.
    nearer = F.when(F.col("left") * 2 > F.col("words"), 1).otherwise(0)
    return found.select(*goals, (F.col("prefix") + nearer).alias("below"))


def repeats(h: str = "h") -> Column:
    """How often the mix takes a document: whole copies, and one more below the threshold."""
    return F.col("whole") + (F.col(h) < F.col("below")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of every document."""
    place = F.monotonically_increasing_id()
    return docs.select("doc_id", "source", word_count(whole_text()).alias("size"), id_hash("doc_id", place).alias("h"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Null texts have size 0, null is a source of its own and comes last. Rows repeated under one id share
    a hash and are taken alike; rows without an id go by their place in the table, each for itself. Sources
    without words get target 0. Extra columns are ignored.
    """
    rows = stored(measured(docs))
    plan = thresholds(rows, source_targets(rows, **settings))
    mixed = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats()).alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: all columns of `docs`, each document as often as it is taken. Documents without
    words follow their hash like any other."""
    place = F.monotonically_increasing_id()
    # Stored with the hash, as the place of a row is only its place in one reading.
    told = stored(docs.select(F.struct("*").alias("_doc"), id_hash("doc_id", place).alias("_h")))
    rows = stored(told.select("_doc.doc_id", "_doc.source", word_count(whole_text("_doc.text")).alias("size"), F.col("_h").alias("h")))
    plan = stored(thresholds(rows, source_targets(rows, **settings)))
    times = F.col("whole") + (F.col("_h") < F.col("below")).cast("long")
    return (
        told.join(plan, F.col("_doc.source").eqNullSafe(F.col("source")))
        .select("_doc", times.alias("_times"))
        .where("_times > 0")
        .select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select("_doc.*")
    )
