"""Helpers that run in Python tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that are held as Python objects at a time, and entries a memo may hold.
ROWS, MEMO_ENTRIES = 512, 600_000


def worker_wide(name: str, make: Callable[[], object]) -> object:
    """What `make` builds, kept for the life of this Python process: workers serve many tasks."""
    kept = sys.modules.setdefault("_tessgrid_llm_worker", types.ModuleType("_tessgrid_llm_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def release() -> None:
    """Give freed memory back to the machine: a worker stays beside later stages that need none of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """Remembers what `find` gave for short keys, in two generations: when the young one is full it
    becomes the old one, from which what is asked for again comes back."""

    def __init__(self, find: Callable, longest: int = 64):
        super().__init__()
        self.find, self.longest, self.old = find, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            if 2 * len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
