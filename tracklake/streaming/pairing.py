"""Structured Streaming twins: one-to-one pairing, nearest samples, distance sampling, order checks, running counts.

Times are long nanoseconds in the rows; timestamps are made from them for watermarks alone. The stateful ones (see
streaming/ordered.py) give the rows of their batch twins exactly, however the rows come in, as long as none comes
later than ``delay``; later ones are given back with the problem ``late``.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.streaming.ordered import walked

_SIDED = {"side": "int", "i": "long"}
_MET = {"i": "long", "t": "long", "sample_index": "long", "residual_ns": "long"}
_BEHIND = {"i": "i", "t": "at"}


class Pairs:
    """Each side waits; the earliest feasible pair first. Kept: the rows that something still to come may reach."""

    def __init__(self, tolerance_ns: int) -> None:
        self.tolerance_ns = tolerance_ns

    def resume(self, carry: tuple | None) -> None:
        self.waiting: tuple[deque, deque] = (deque(), deque())
        for t, i, side in zip(*carry, strict=True) if carry else ():
            self.waiting[side].append((t, i))

    def row(self, values: tuple) -> Iterator[tuple]:
        t, side, i = values
        references, samples = self.waiting
        self.waiting[side].append((t, i))
        while references and samples:
            d = samples[0][0] - references[0][0]
            if abs(d) <= self.tolerance_ns:
                yield references[0][1], references[0][0], samples[0][1], d
            if d >= -self.tolerance_ns:
                references.popleft()
            if d <= self.tolerance_ns:
                samples.popleft()
        self._evict(t)

    def _evict(self, now_ns: int) -> None:
        for side in self.waiting:
            while side and now_ns - side[0][0] > self.tolerance_ns:
                side.popleft()

    def settle(self, now_ns: int) -> Iterator[tuple]:
        self._evict(now_ns)
        return iter(())

    def carry(self) -> tuple | None:
        kept = [(t, i, side) for side in (0, 1) for t, i in self.waiting[side]]
        return tuple(map(list, zip(*kept, strict=True))) if kept else None

    def due_ns(self) -> int | None:
        newest = max((side[-1][0] for side in self.waiting if side), default=None)
        return None if newest is None else newest + self.tolerance_ns + 1


class Nearest:
    """References wait for the first sample at or after them, or until none can be near. Kept: these, and the last sample."""

    def __init__(self, tolerance_ns: int) -> None:
        self.tolerance_ns = tolerance_ns

    def resume(self, carry: tuple | None) -> None:
        self.waiting: deque = deque(zip(*carry[:4], strict=True) if carry else ())
        self.last: tuple | None = tuple(carry[4]) if carry and carry[4] else None

    def _answer(self, above: tuple | None) -> tuple:
        t, i, below_t, below_i = self.waiting.popleft()
        near = (below_t, below_i) if below_t is not None and (above is None or t - below_t <= above[0] - t) else above
        good = near is not None and abs(near[0] - t) <= self.tolerance_ns
        return (i, t, near[1], near[0] - t) if good else (i, t, None, None)

    def row(self, values: tuple) -> Iterator[tuple]:
        t, side, i = values
        if side:
            while self.waiting:
                yield self._answer((t, i))
            if self.last is None or self.last[0] < t:  # of samples at one time, the smallest index is the nearest
                self.last = t, i
        else:
            self.waiting.append((t, i, *(self.last or (None, None))))

    def settle(self, now_ns: int) -> Iterator[tuple]:
        while self.waiting and self.waiting[0][0] + self.tolerance_ns < now_ns:
            yield self._answer(None)
        if self.last and self.last[0] + self.tolerance_ns < now_ns:
            self.last = None

    def carry(self) -> tuple | None:
        if not self.waiting and self.last is None:
            return None
        columns = [list(x) for x in zip(*self.waiting, strict=True)] if self.waiting else [[], [], [], []]
        return (*columns, list(self.last or ()))

    def due_ns(self) -> int | None:
        times = [x[0] for x in (*self.waiting, *([self.last] if self.last else []))]
        return max(times) + self.tolerance_ns + 1 if times else None


class DistanceSamples:
    """Kept: the last position and the path so far; after ``idle_ns`` without a row they go, and a new path starts."""

    def __init__(self, spacing_m: float, idle_ns: int | None) -> None:
        self.spacing_m, self.idle_ns = spacing_m, idle_ns

    def resume(self, carry: tuple | None) -> None:
        self.state = carry

    def row(self, values: tuple) -> Iterator[tuple]:
        t, i, *here = values
        if self.state is None or (self.idle_ns is not None and t - self.state[4] > self.idle_ns):
            self.state = (*here, 0.0, t)
            yield i, t
            return
        before = math.floor((self.state[3] + 1e-12) / self.spacing_m)
        path = self.state[3] + math.dist(self.state[:3], here)
        self.state = (*here, path, t)
        if math.floor((path + 1e-12) / self.spacing_m) > before:
            yield i, t

    def settle(self, now_ns: int) -> Iterator[tuple]:
        if self.state is not None and self.idle_ns is not None and now_ns - self.state[4] > self.idle_ns:
            self.state = None
        return iter(())

    def carry(self) -> tuple | None:
        return self.state

    def due_ns(self) -> int | None:
        return None if self.state is None or self.idle_ns is None else self.state[4] + self.idle_ns + 1


class NotAfter:
    """Rows whose header isn't after the newest one before. Kept: that one."""

    def resume(self, carry: tuple | None) -> None:
        self.newest = carry[0] if carry else None

    def row(self, values: tuple) -> Iterator[tuple]:
        _, i, t = values
        if self.newest is not None and t <= self.newest:
            yield i, t
        self.newest = t if self.newest is None else max(self.newest, t)

    def settle(self, now_ns: int) -> Iterator[tuple]:
        return iter(())

    def carry(self) -> tuple | None:
        return None if self.newest is None else (self.newest,)

    def due_ns(self) -> int | None:
        return None


def one_to_one_stream(rows: DataFrame, tolerance_ns: int, delay: str = "10 seconds", key: str = "segment_id") -> DataFrame:
    """Pairs of a stream of (key, side 0 or 1, i, t): key, i, t, sample_index, residual_ns, problem.

    What no row of the other side can reach any more is evicted. A late row (of either side) has its i and t alone.
    """
    return walked(rows, Pairs(tolerance_ns), _SIDED, ["at", "side", "i"], _MET, _BEHIND, delay, key, "t")


def nearest_stream(rows: DataFrame, tolerance_ns: int, delay: str = "10 seconds", key: str = "segment_id") -> DataFrame:
    """key, i, t, sample_index, residual_ns, problem: the nearest sample of each reference in a stream of (key, side 0 or 1, i, t).

    A reference is answered as soon as a sample at or after it is in order, or the watermark has passed it by the tolerance;
    ties go to the earlier sample, none in tolerance gives nulls. A late row (of either side) has its i and t alone.
    """
    return walked(rows, Nearest(tolerance_ns), _SIDED, ["at", "side", "i"], _MET, _BEHIND, delay, key, "t")


def distance_sampled_stream(rows: DataFrame, spacing_m: float, delay: str = "10 seconds", idle_ns: int | None = None, key: str = "segment_id") -> DataFrame:
    """key, i, t, problem of rows (key, i, t, x, y, z) where the travelled distance passes another multiple of the spacing.

    With ``idle_ns``, a key that has had no row for so long is forgotten, and its next row is a first one.
    """
    return walked(rows, DistanceSamples(spacing_m, idle_ns), {"i": "long", "x": "double", "y": "double", "z": "double"}, ["at", "i"], {"i": "long", "t": "long"}, _BEHIND, delay, key, "t")


def out_of_order_stream(rows: DataFrame, delay: str = "10 seconds", key: str = "segment_id", at: str = "log_t") -> DataFrame:
    """Rows (key, i, t, log_t) whose header time t is not after the newest one logged before: a reject table in place of an error.

    The order is that of the log (``at``, then i), which is also the event time; headers may go back as far as they like.
    """
    return walked(rows, NotAfter(), {"i": "long", "t": "long"}, ["at", "i"], {"i": "long", "t": "long"}, {"i": "i", "t": "t"}, delay, key, at)


def time_window_stream(rows: DataFrame, start_ns: int, stop_ns: int, time: str = "t") -> DataFrame:
    """Rows with start <= time < stop; where reading ends is the source's part."""
    return rows.where((F.col(time) >= start_ns) & (F.col(time) < stop_ns))


def quality_counts(rows: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "event_time", quality: str = "quality") -> DataFrame:
    """Counts by tumbling window and quality; works on a stream (with its watermark) and on a table alike."""
    held = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = held.groupBy(F.window(time, window).alias("w"), quality).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), quality, "n")
