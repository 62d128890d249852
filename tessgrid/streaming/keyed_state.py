"""Stateful processors: one small state per drive or stream id, kept by Spark's state store.

A batch reads and writes the state of the keys it brings and of no other. State commits with the batch, so a
replay after a failure starts from the state before it.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state needs. A running query keeps the store it started with."""
    spark.conf.set(_PROVIDER, _ROCKS)


class Settings(StatefulProcessor):
    """Commands and frames of a stream in, the settings in force at each frame out.

    Rows carry `seq`, `setting` and `value`; a frame has no setting. State: the value and seq of each setting
    ever set, and the commands whose seq no frame has reached yet. A command counts for frames from its
    seq on. One that comes after frames beyond its seq counts from the next frame on, unless a later command
    has set the same setting. At equal seq the later arrival in a batch wins by order of its value, null first.
    """

    def __init__(self, settings: tuple[str, ...], defaults: dict[str, float]):
        self.settings, self.defaults = settings, defaults

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "setting string", "value double, given boolean, seq long")
        self.pending = handle.getListState("pending", "seq long, setting string, value double, given boolean")

    def frames(self, key: tuple, rows: list[Row]) -> Iterator[tuple[int, Row]]:
        """(seq, row) of the frames in the order their settings are wanted."""
        return ((r.seq, r) for r in sorted(rows, key=lambda r: r.seq))

    def told(self, key: tuple, row: Row, seq: int, values: list[float | None]) -> Row:
        return Row("stream_id", "seq", *self.settings)(*key, seq, *values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        frames, commands = [], [tuple(c) for c in self.pending.get()]
        n_pending = len(commands)
        for r in rows:
            if r.setting is None:
                frames.append(r)
            else:
                commands.append((r.seq, r.setting, 0.0 if r.value is None else r.value, r.value is not None))
        commands.sort(key=lambda c: (c[0], c[3], c[2]))
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        changed, done, out = set(), 0, []
        for seq, row in self.frames(key, frames):
            while done < len(commands) and commands[done][0] <= seq:
                at, setting, value, given = commands[done]
                if setting not in held or held[setting][2] <= at:
                    held[setting] = (value, given, at)
                    changed.add(setting)
                done += 1
            out.append(self.told(key, row, seq, [self._value(held.get(s), s) for s in self.settings]))
        for setting in changed:
            self.held.updateValue((setting,), held[setting])
        if done or len(commands) != n_pending:
            left = commands[done:]
            if left:
                self.pending.put(left)
            else:
                self.pending.clear()
        yield from out

    def _value(self, held: tuple | None, setting: str) -> float | None:
        if held is None:
            return self.defaults.get(setting)
        return held[0] if held[1] else None

    def close(self) -> None:
        pass


class NumberedFrames(Settings):
    """The same for files that arrive: the frames of a drive are numbered from 0 up, in order of path within
    a batch, and `seq` is that number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.next = handle.getValueState("next", "number long")

    def frames(self, key: tuple, rows: list[Row]) -> Iterator[tuple[int, Row]]:
        if not rows:
            return iter(())
        first = self.next.get()[0] if self.next.exists() else 0
        self.next.update((first + len(rows),))
        return enumerate(sorted(rows, key=lambda r: r.path), first)

    def told(self, key: tuple, row: Row, seq: int, values: list[float | None]) -> Row:
        return Row("drive", "path", "number", *self.settings)(*key, row.path, seq, *values)


class RollingFrames(StatefulProcessor):
    """Timings of a stream in, figures over the `window` frames before each frame out.

    State: the last `window + late` frames, in order of frame_id. A frame that comes late takes its place
    among them, and the frames whose window it enters are told anew. Frames too late for that have no
    figures: what came before them is forgotten. A frame that comes again replaces its earlier values.
    """

    MEASURES = ("frame_ms", "perception_ms", "grid_ms", "codec_ms", "wire_bytes")
    TOLD = Row(
        "stream_id", "frame_id", "frame_ms_mean", "frame_ms_p95", "perception_ms_mean", "grid_ms_mean",
        "codec_ms_mean", "wire_bytes_mean", "samples",
    )

    def __init__(self, window: int, late: int, ttl_ms: int | None = None):
        self.window, self.late, self.ttl_ms = window, late, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"{m} double, has_{m} boolean" for m in self.MEASURES)
        self.kept = handle.getListState("frames", f"frame_id long, {values}", self.ttl_ms)
        self.cut = handle.getValueState("cut", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known: list[tuple] = [(r[0], tuple(r[1 + 2 * i] if r[2 + 2 * i] else None for i in range(5))) for r in self.kept.get()]
        cut = self.cut.exists()
        new = {r.frame_id: tuple(None if r[m] is None else float(r[m]) for m in self.MEASURES) for r in rows}
        merged = dict(known) | new
        order = sorted(merged)
        values = [merged[f] for f in order]
        places = sorted(bisect.bisect_left(order, f) for f in new)
        upto = 0
        for at in places:
            for i in range(max(at, upto), min(at + self.window + 1, len(order))):
                if i >= self.window or not cut:
                    yield self._figures(key, order[i], values[max(0, i - self.window) : i])
                elif order[i] in new:
                    yield self.TOLD(*key, order[i], *[None] * 7)
            upto = max(upto, at + self.window + 1)
        most = self.window + self.late
        if len(order) > most:
            self.cut.update((True,))
            order, values = order[-most:], values[-most:]
        self.kept.put(
            [(f, *(x for v in vs for x in ((0.0, False) if v is None else (v, True)))) for f, vs in zip(order, values)]
        )

    def _figures(self, key: tuple, frame_id: int, past: list[tuple]) -> Row:
        columns = [[v for v in column if v is not None] for column in zip(*past)] if past else [[]] * 5

        def mean(found: list[float]) -> float | None:
            total = 0.0
            for v in found:
                total += v
            return total / len(found) if found else None

        means = [mean(c) for c in columns]
        return self.TOLD(*key, frame_id, means[0], percentile(sorted(columns[0]), 0.95), *means[1:], len(columns[0]))

    def close(self) -> None:
        pass


def percentile(found: list[float], share: float) -> float | None:
    """Between the two nearest of sorted values, as the SQL function `percentile` has it."""
    if not found:
        return None
    place = (len(found) - 1) * share
    low, high = math.floor(place), math.ceil(place)
    if low == high or found[low] == found[high]:
        return found[low]
    return (high - place) * found[low] + (place - low) * found[high]
