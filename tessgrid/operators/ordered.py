"""Order-dependent operators over keys that may be hot.

A window over a whole key puts that key into one task. Here a key is cut into blocks of consecutive
order values instead; what crosses a block edge travels in a summary of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"
#: Blocks that one summary cuts a key into at most; blocks that are still too large are cut again.
_CUTS = 64
#: A quantile is off by one in so many rows of a key at most.
_ACCURACY = 10_000
#: Keys that need cutting are broadcast up to this number: 0.5 kB each.
_BROADCAST_KEYS = 4096


def _in_blocks(df: DataFrame, keys: list[str], order: str, rows: int) -> DataFrame:
    """Adds the block of each row, an array of numbers that rises with the order column. Blocks hold at most
    about 1.1 times `rows` rows, whatever the values: each key is cut at quantiles of its own values, as
    many as its row count asks for.

    Quantiles come from summaries that tasks merge. A summary gives at most 64 blocks; a key with more
    than 64 * `rows` rows is cut again inside its blocks. Keys of up to `rows` rows, usually all, stay
    whole and cost one count. Rows of equal order value share a block.
    """
    blocked, by, before = df.withColumn(_BLOCK, F.array().cast("array<int>")), [*keys, _BLOCK], None
    shares = F.array([F.lit(i / _CUTS) for i in range(1, _CUTS)])
    while True:
        sizes = blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__a"), F.max(order).alias("__b"))
        large = sizes.where((F.col("__n") > 1.1 * rows) & (F.col("__a") < F.col("__b")))
        found = large.agg(F.count(F.lit(1)), F.sum("__n")).first()
        if found[0] == 0 or found == before:
            return blocked
        before = found
        summaries = blocked.groupBy(*by).agg(
            F.count(F.lit(1)).alias("__n"), F.percentile_approx(order, shares, F.lit(_ACCURACY)).alias("__q")
        )
        blocks = F.least(F.ceil(F.col("__n") / F.lit(rows)), F.lit(_CUTS)).cast("int")
        places = F.transform(
            F.sequence(F.lit(1), blocks - 1), lambda i: F.greatest(F.round(i * _CUTS / blocks).cast("int"), F.lit(1))
        )
        cuts = summaries.where(F.col("__n") > 1.1 * rows).select(
            *by, F.array_distinct(F.transform(places, lambda i: F.element_at("__q", i))).alias("__cuts")
        )
        passed = F.size(F.filter(F.col("__cuts"), lambda c: c < F.col(order)))
        blocked = _with_few(blocked, cuts, by, order, found[0]).withColumn(
            _BLOCK, F.concat(_BLOCK, F.array(F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(passed)))
        ).drop("__cuts")


def _with_few(df: DataFrame, few: DataFrame, by: list[str], order: str, n_few: int) -> DataFrame:
    """Left join with a table of `n_few` rows: broadcast, or salted where it is too large for that."""
    if n_few <= _BROADCAST_KEYS:
        return df.join(F.broadcast(few), by, "left")
    return salted_join(df, few, by, F.xxhash64(order))


def ranked(df: DataFrame, keys: list[str], order: str, rows: int = 65_536, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row within `keys` by the LONG column `order`, unique per key.

    The running count over blocks is the only window over a whole key, and it sees one row per block.
    """
    blocked = _in_blocks(df, keys, order, rows)
    earlier = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*keys, _BLOCK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    return (
        blocked.join(offsets, [*keys, _BLOCK])
        .withColumn(name, F.row_number().over(inside) - F.lit(1) + F.col("__offset"))
        .drop(_BLOCK, "__offset")
    )


def carried_forward(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], rows: int = 65_536,
    then: tuple[str, ...] = (),
) -> DataFrame:
    """Adds, per entry of `values`, the last non-null value at or before each row within `keys`, by the LONG
    column `order`, then by the columns `then`."""
    blocked = _in_blocks(df, keys, order, rows)
    for name, value in values.items():
        blocked = blocked.withColumn(f"__{name}", value)
    ends = blocked.groupBy(*keys, _BLOCK).agg(
        *[
            F.max_by(f"__{name}", F.when(F.col(f"__{name}").isNotNull(), F.struct(order, *then))).alias(name)
            for name in values
        ]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = ends.select(
        *keys,
        _BLOCK,
        *[F.last(name, ignorenulls=True).over(earlier).alias(f"__before_{name}") for name in values],
    )
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(order, *then)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = blocked.join(before, [*keys, _BLOCK])
    for name in values:
        here = F.last(f"__{name}", ignorenulls=True).over(inside)
        filled = filled.withColumn(name, F.coalesce(here, F.col(f"__before_{name}")))
    dropped = [f"__{name}" for name in values] + [f"__before_{name}" for name in values]
    return filled.drop(_BLOCK, *dropped)


def with_history(
    df: DataFrame, keys: list[str], order: str, lookback: int, span: int = 4096, rows: int = 65_536
) -> tuple[DataFrame, list[str], str]:
    """Rows cut into blocks of `span` consecutive rows, each block led by copies of the `lookback` rows
    before it.

    Returns the rows, the partition keys and the order column for a window of at most `lookback`
    preceding rows. Drop the copies (`is_history`) after the window.
    """
    if lookback >= span:
        raise ValueError("lookback must be shorter than a block")
    dense = ranked(df, keys, order, rows, "__seq")
    home = F.floor(F.col("__seq") / span).cast("long")
    late = F.col("__seq") % span >= span - lookback
    copies = F.array_compact(
        F.array(
            F.struct(home.alias("block"), F.lit(False).alias("copy")),
            F.when(late, F.struct((home + 1).alias("block"), F.lit(True).alias("copy"))),
        )
    )
    spread = dense.withColumn("__to", F.explode(copies))
    spread = spread.withColumn("__span", F.col("__to.block")).withColumn(
        "is_history", F.col("__to.copy")
    )
    return spread.drop("__to"), [*keys, "__span"], "__seq"


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, salts: int = 8) -> DataFrame:
    """Left join whose keys may be hot on the big side: its rows spread over `salts` copies of the other
    side, which should hold few rows per key. It is a sort-merge join fed by two exchanges, so what is
    still too large after salting is split further while it runs, by the bytes that really arrived."""
    slots = F.sequence(F.lit(0), F.lit(salts - 1))
    left = big.withColumn("__salt", F.pmod(by, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(slots))
    return left.join(right.hint("merge"), [*keys, "__salt"], "left").drop("__salt")
