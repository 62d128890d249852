"""How many tasks the points of a job are dealt to, and groups read off sorted rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Points of a task. What a task holds per point, copies for several tiers and scenarios included, stays
#: below some kilobytes.
POINTS_PER_TASK = 2**17
#: Up to so many tasks' worth of points the session's own number of partitions is left to do.
_FEW_TASKS = 8


def tasks_for(points: DataFrame) -> int | None:
    """Tasks that `points`, or the table they are read from, ask for: as many as keep what one of them holds
    the same however many rows there are. None, the session's choice, for few rows.

    Counts the rows, which costs a stored table no more than its footers. Where points come out of costly
    work, say the number instead.
    """
    tasks = math.ceil(points.count() / POINTS_PER_TASK)
    return tasks if tasks > _FEW_TASKS else None


def gathered(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` shuffled by `keys` into `tasks` partitions, or as the session has it."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where the groups of a sorted table begin."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in keys:
        column = table[name].combine_chunks()
        if pa.types.is_string(column.type):
            column = column.dictionary_encode().indices
        known, values = column.is_valid().to_numpy(False), column.fill_null(0).to_numpy(False)
        new |= (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `keys` as tables of whole groups, with where each group begins. A table holds about
    `rows` rows, or one group if that is larger."""
    held, n, due = [], 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < due:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        cut = int(starts[-1])  # the last group may go on
        if cut:
            yield table.slice(0, cut), starts[:-1]
        held = table.slice(cut).to_batches()
        n -= cut
        due = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)
