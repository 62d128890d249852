"""Link quoted passages to the messages they come from, and lay conversations out in reply order.

A line that starts with quote marks (`>`, also `> >`) is quoted at the level of its marks. Quoted lines
are normalised, hashed, and looked up among the lines that other messages of the conversation wrote
themselves; hash and text must both agree. A line points at one message only, the first to write it, so
the lookup never pairs one group of repeats with another.

Lines that nobody wrote as they are, such as those of a paragraph wrapped anew, are joined into passages:
runs of lines of one level, blanks normalised across line ends. A passage is looked up by the hash of its
first PART_WORDS words among all runs of that many words that messages wrote, and belongs to the first
message whose own text holds it whole. Where a passage as a whole belongs to none, its lines are looked up
one by one in the same way. Fewer words than PART_WORDS link only as a whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import BLANKS, stored

#: Quote marks and what may stand between them, at the start of a line.
_MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: Words that a part of somebody's text must have to be taken for a quote of it.
PART_WORDS = 4


def _normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message (a number of the row), at, level (0: own words), line as written, normalised
    line. Null texts have none."""
    marks = F.regexp_extract("line", _MARKS, 0)
    bare = F.btrim(F.regexp_replace("line", _MARKS, ""), F.lit(BLANKS))
    return (
        messages.select("conv_id", "turn", "text", F.monotonically_increasing_id().alias("message"))
        .select(
            "conv_id", "turn", "message", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line")
        )
        .withColumn("level", F.length(F.regexp_replace(marks, "[^>]", "")))
        .withColumn("norm", _normal(bare))
    )


def _key(norm: Column) -> Column:
    return F.xxhash64(norm)


def own_texts(messages: DataFrame) -> DataFrame:
    """conv_id, turn, part, own: what a message wrote between quoted lines, normalised across line ends."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    parts = F.split(text, r"(?md)^[ \t]*>[^\n]*$")
    return (
        messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select("conv_id", "turn", F.posexplode(parts).alias("part", "own"))
        .withColumn("own", _normal(F.btrim("own", F.lit(BLANKS))))
        .where("own <> ''")
    )


def passages(unlinked: DataFrame) -> DataFrame:
    """Runs of consecutive lines of one level, and the lines of longer runs by themselves: conv_id, turn,
    message, run, level, whole (1: the run), n_lines, passage."""
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("at")
    follows = (F.lag("at").over(order) + 1 == F.col("at")) & (F.lag("level").over(order) == F.col("level"))
    numbered = unlinked.withColumn("starts", F.when(follows, 0).otherwise(1)).withColumn(
        "run", F.sum("starts").over(order)
    )
    runs = numbered.groupBy("conv_id", "turn", "message", "run", "level").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]).alias("norms")
    )
    joined = F.struct(F.lit(1).alias("whole"), F.size("norms").alias("n_lines"), F.array_join("norms", " ").alias("passage"))
    single = F.transform("norms", lambda x: F.struct(F.lit(0).alias("whole"), F.lit(1).alias("n_lines"), x.alias("passage")))
    both = F.when(F.size("norms") > 1, F.concat(F.array(joined), single)).otherwise(F.array(joined))
    return runs.select("conv_id", "turn", "message", "run", "level", F.inline(both)).where(
        F.size(F.split("passage", " ")) >= PART_WORDS
    )


def part_links(messages: DataFrame, unlinked: DataFrame) -> DataFrame:
    """conv_id, turn, level, source_turn, n_lines of passages that are part of what an earlier message wrote."""
    sought = passages(unlinked)
    wanted = sought.select("conv_id", "passage").distinct()
    wanted = wanted.withColumn("key", _key(F.substring_index("passage", " ", PART_WORDS)))
    own = own_texts(messages).join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    words = own.select("conv_id", "turn", "part", F.split("own", " ").alias("words"))
    # Only keys are multiplied by the number of words; texts are fetched for those that are met.
    starts = F.sequence(F.lit(1), F.size("words") - PART_WORDS + 1)
    keys = words.where(F.size("words") >= PART_WORDS).select(
        "conv_id", "turn", "part",
        F.explode(F.array_distinct(F.transform(starts, lambda i: _key(F.array_join(F.slice("words", i, PART_WORDS), " "))))).alias("key"),
    )
    met = keys.join(wanted, ["conv_id", "key"]).select("conv_id", "turn", "part", "passage").distinct()
    padded = [F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("own", "passage")]
    first = (
        met.join(own, ["conv_id", "turn", "part"])
        .where(padded[0].contains(padded[1]))
        .groupBy("conv_id", "passage")
        .agg(F.min("turn").alias("source_turn"))
    )
    found = sought.join(first, ["conv_id", "passage"]).where("source_turn < turn")
    best = F.max("whole").over(Window.partitionBy("conv_id", "turn", "message", "run"))
    return (
        found.withColumn("best", best)
        .where("whole = best")
        .select("conv_id", "turn", "level", "source_turn", F.col("n_lines").cast("long").alias("n_lines"))
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, turn, level, source_turn): how many quoted lines of that level were first
    written by an earlier message, as lines or as parts of its text. Lines without words link to nothing."""
    lines = lines_of(messages).where("norm <> ''")
    own = (
        lines.where("level = 0")
        .groupBy("conv_id", _key(F.col("norm")).alias("key"), "norm")
        .agg(F.min("turn").alias("source_turn"))
    )
    quoted = (
        lines.where("level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
        .withColumn("key", _key(F.col("norm")))
        .join(own, ["conv_id", "key", "norm"], "left")
    )
    # Stored, so that both branches see the same numbers of messages.
    quoted = stored(quoted.select("conv_id", "turn", "message", "at", "level", "norm", "source_turn"))
    whole = quoted.where("source_turn < turn").select(
        "conv_id", "turn", "level", "source_turn", F.lit(1).cast("long").alias("n_lines")
    )
    parts = part_links(messages, quoted.where("source_turn IS NULL OR source_turn >= turn"))
    return (
        whole.unionByName(parts)
        .groupBy("conv_id", "turn", "level", "source_turn")
        .agg(F.sum("n_lines").alias("n_lines"))
    )


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn: the message with most lines at the outermost quote level that links at
    all; of equals the latest."""
    links = quote_links(messages)
    best = F.struct(-F.col("level"), "n_lines", "source_turn")
    return links.groupBy("conv_id", "turn").agg(F.max(best)["source_turn"].alias("parent_turn"))


def own_words(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply (text without quoted lines), n_quoted, quote_depth."""
    line = F.split("text", r"\r\n|\r|\n")
    marked = F.filter(line, lambda x: F.regexp_like(x, F.lit(_MARKS)))
    kept = F.filter(line, lambda x: ~F.regexp_like(x, F.lit(_MARKS)))
    depth = F.array_max(
        F.transform(
            marked, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
        )
    )
    return messages.withColumns(
        {
            "reply": F.btrim(F.array_join(kept, "\n"), F.lit(BLANKS)),
            "n_quoted": F.coalesce(F.size(marked), F.lit(0)).cast("long"),
            "quote_depth": F.coalesce(depth, F.lit(0)).cast("int"),
        }
    )


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply, n_quoted, quote_depth, parent_turn, root_turn, depth for every message.

    `path` is the list of turns from the root to the message; sorted by it, a conversation reads in reply
    order. Parents are earlier turns, so there are no cycles. Paths double in length per round until all
    have reached their roots. A null text has no lines and gives a null reply. Rows repeated under
    one (conv_id, turn) share their links; messages whose conv_id or turn is null link to nothing and are
    roots. Extra columns are dropped.
    """
    base = own_words(messages.select("conv_id", "turn", "role", "text"))
    found = parents(messages)
    hops = stored(
        found.select("conv_id", "turn", F.array("parent_turn").alias("path"), F.col("parent_turn").alias("top"))
    )
    while True:
        far = hops.selectExpr("conv_id AS _conv", "turn AS _turn", "path AS _path", "top AS _top")
        step = hops.join(
            far, (F.col("conv_id") == F.col("_conv")) & (F.col("top") == F.col("_turn")), "left"
        ).select(
            "conv_id",
            "turn",
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
            F.coalesce("_top", "top").alias("top"),
            F.col("_path").isNotNull().alias("moved"),
        )
        step = stored(step)
        hops = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    told = hops.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "path", "top")
    joined = base.join(
        told, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left"
    )
    return joined.select(
        "conv_id", "turn", "role", "reply", "n_quoted", "quote_depth",
        F.element_at("path", -1).alias("parent_turn"),
        F.coalesce("top", "turn").alias("root_turn"),
        F.coalesce(F.size("path"), F.lit(0)).cast("int").alias("depth"),
        F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("turn")).alias("path"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """Messages sorted into reply order: by conversation, then parents before replies and replies to one
    message by turn. A range sort, so one long conversation is laid out by many tasks."""
    return reply_order(messages).orderBy("conv_id", "path", "role", "reply")
