"""Exact duplicates: equal once white space is deleted.

1. Local: the map side of the first aggregation folds equal texts of a task.
2. Salted: digest groups are merged per salt, so the copies of one text meet in `salts` tasks.
3. Global: at most `salts` rows per text meet.

All three compare the digest and the whole normalised text. Results go back to the documents by
(digest, salt), which splits a hot group the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessgrid.llm.common import numbered, one_per_group, whole_text, without_blanks

#: Below 63: the salts in which a text occurs are one bit each of a LONG.
SALTS = 16
_STEP = "36893488147419103232"  # 2**65, more than the ids below a length
_HALF = "9223372036854775808"  # 2**63


def _rank(length: Column, doc_id: Column) -> Column:
    """One number that is larger for longer texts, then for smaller ids; null ids come last. Unlike a
    struct, a hash aggregate can hold it."""
    below = F.lit(_HALF).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    return (
        length.cast("decimal(11,0)") * F.lit(_STEP).cast("decimal(20,0)")
        + F.coalesce(below, F.lit(0).cast("decimal(21,0)"))
    ).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    below = rank % F.lit(_STEP).cast("decimal(38,0)")
    return F.when(below != 0, F.lit(_HALF).cast("decimal(38,0)") - below).cast("long")


def digests(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, place (number of the row), n_points (code points of the original), salt, digest and the
    normalised text. The salt goes by place, so it splits rows of one id or of none."""
    if not 1 <= salts <= 62:
        raise ValueError("salts must be in 1..62")
    text = whole_text("text")
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("place"),
        F.char_length(text).alias("n_points"),
        without_blanks(text).alias("norm"),
    ).withColumns(
        {"salt": F.pmod(F.xxhash64("place"), F.lit(salts)), "digest": F.unhex(F.sha2("norm", 256))}
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest doc_id. Null texts count as empty; empty
    texts are one group. A null doc_id yields to any other id. Rows repeated under one id each count in
    group_size, and `kept` is true for one of them only. Extra columns are ignored; an empty table gives no
    rows.
    """
    keyed = digests(docs, salts)
    rank = _rank(F.col("n_points"), F.col("doc_id"))
    salted = keyed.groupBy("salt", "digest", "norm").agg(
        F.max(rank).alias("best"), F.max_by("place", rank).alias("place"), F.count(F.lit(1)).alias("n")
    )
    winners = (
        salted.groupBy("digest", "norm")
        .agg(
            F.max("best").alias("best"),
            F.max_by("place", "best").alias("best_place"),
            F.sum("n").alias("group_size"),
            F.bit_or(F.expr("shiftleft(1L, CAST(salt AS INT))")).alias("in_salts"),
        )
        .select(
            "digest",
            "group_size",
            _id_of(F.col("best")).alias("keep_id"),
            "best_place",
            F.explode(
                F.expr(f"filter(sequence(0L, {salts - 1}L), s -> (in_salts & shiftleft(1L, CAST(s AS INT))) != 0)")
            ).alias("salt"),
        )
    )
    rows = keyed.select("doc_id", "salt", "digest", "place")
    return rows.join(winners.hint("merge"), ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("place") == F.col("best_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Exactly one row of each group, all columns as they were: the longest text, then the smallest doc_id,
    null last. Rows are told apart by their stored number, so ids may repeat, be null, or bear several
    texts."""
    rows = numbered(docs)
    groups = exact_groups(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), salts)
    groups = groups.select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    return one_per_group(rows, groups, [-F.char_length(whole_text("_doc.text"))])
