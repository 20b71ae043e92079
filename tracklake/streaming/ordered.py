"""Rows of a key in event-time order, whatever order they come in: the base of the stateful streams.

Keys are dealt to buckets. Rows are put into blocks (a few thousand rows of a bucket in order of time, as Arrow bytes) before
they meet the state, so neither Spark's state nor a worker handles them one by one. A block waits in map state, by its
earliest time, until the watermark has passed a row in it; then the rows that are due are put in order, some blocks at a
time, and go through a walk of their key, which has a small carried state of its own. Timers on event time wake a bucket for that, and
once more when what a key carries can't matter any longer, so an idle key keeps nothing. So the result doesn't depend on how
rows are dealt to files, micro-batches or Arrow parts. A row that comes after the watermark has passed its time is late:
it is given back with the problem ``late`` and changes nothing.

The watermark moves with what comes in. A source that ends, or falls silent, has to send a heartbeat (a row without a
key, or with a null in a column that the walk needs, and a time beyond the last one), or the last rows wait for it. Rows without a time are left out.

What a worker holds at once is ``_SWEEP`` blocks, what of earlier blocks is later than these, and what the keys of a bucket carry.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER, _WIDTH = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
_PASSED = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Buckets of keys, rows of a block, rows that a task gathers before it makes blocks, blocks read at a time, and rows that become Python values at a time.
_BUCKETS, _BLOCK, _GATHERED, _SWEEP, _SLICE = 512, 4096, 500_000, 128, 50_000


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which timers and map state need.

    Every state partition is a store and a Python worker's turn in each micro-batch, so there are two for a core at most.
    Blocks of rows are passed to workers a thousand at a time.
    """
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _WIDTH, _PASSED)}
    spark.conf.set(_PASSED, "1000")
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(_WIDTH, str(min(int(before[_WIDTH]), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Walk(Protocol):
    """What is done with the rows of a key in order."""

    def resume(self, carry: tuple | None) -> None:
        """Takes up what was carried, or starts."""

    def row(self, values: tuple) -> Iterator[tuple]:
        """Output rows once the next row (order columns and values) is there."""

    def settle(self, now_ns: int) -> Iterator[tuple]:
        """Output rows that need nothing more, as no row before ``now_ns`` can come any more."""

    def carry(self) -> tuple | None:
        """What to carry on; None if nothing."""

    def due_ns(self) -> int | None:
        """When to settle even if no row comes; None if never."""


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


def _starts(values: np.ndarray) -> list[int]:
    """Where a run of equal values begins, and the end of the last."""
    return [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]


def _cut(rows: pa.Table) -> Iterator[pa.Table]:
    """Rows in order of time as tables of a block each."""
    rows = rows.sort_by("at")
    for k in range(0, len(rows), _BLOCK):
        yield rows.slice(k, _BLOCK)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, rows: blocks of what comes in, without heartbeats."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        ends = _starts(rows["bucket"].to_numpy())
        rows, buckets = rows.drop_columns(["bucket"]), rows["bucket"]
        for a, b in zip(ends, ends[1:]):
            for block in _cut(rows.slice(a, b - a)):
                yield pa.RecordBatch.from_arrays([pa.array([buckets[a].as_py()], pa.int32()), pa.array([_bytes(block)], pa.binary())], ["bucket", "rows"])

    held, n = [], 0
    for part in parts:
        part = part.filter(pa.compute.invert(part["beat"])).drop_columns(["beat"])
        if part.num_rows:
            held.append(part)
            n += part.num_rows
        if n >= _GATHERED:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


class InOrder(StatefulProcessor):
    """Runs a walk over each key's rows. Input: bucket, rows (blocks of key, at, which is the event time, and the walk's columns)."""

    def __init__(self, walk: Walk, columns: list[str], order: list[str], out: list[str], late: dict[str, str]) -> None:
        self.walk, self.columns, self.order, self.out, self.late = walk, columns, order, out, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, number long", "rows binary")
        self.number = handle.getValueState("number", "next long")
        self.kept = handle.getValueState("kept", "carried binary")

    def _wake(self, at_ns: int | None, gone: int | None = None) -> None:
        """One timer a bucket, at the earliest time that is asked for. ``gone``: one that has just expired."""
        if at_ns is None:
            return
        at = max(at_ns // 1_000_000 + 1, 1)
        timers = [t for t in self.handle.listTimers() if t != gone]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _keep(self, blocks: Iterator[pa.Table]) -> int | None:
        """Lets blocks wait; the earliest time in them."""
        number = before = self.number.get()[0] if self.number.exists() else 0
        first = None
        for block in blocks:
            low = block["at"][0].as_py()
            first = low if first is None else min(first, low)
            self.waiting.updateValue((low, number), (_bytes(block),))
            number += 1
        if number > before:
            self.number.update((number,))
        return first

    def _frame(self, rows: list[tuple], problem: str | None) -> pd.DataFrame:
        names = self.out[:-1] if problem is None else [self.out[0], *self.late]
        found = pd.DataFrame(rows, columns=names, dtype=object).reindex(columns=self.out)
        found[self.out[-1]] = problem
        return found.astype({c: "Int64" for c in self.out[1:-1]} | {self.out[-1]: "object"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1_000_000
        behind: list[pd.DataFrame] = []

        def in_time() -> Iterator[pa.Table]:
            for part in rows:
                for held in part["rows"]:
                    block = _table(held)
                    k = int(np.searchsorted(block["at"].to_numpy(), now))
                    if k:
                        behind.append(self._frame(list(zip(*[block[c].slice(0, k).to_pylist() for c in ("key", *self.late.values())])), "late"))
                    if k < len(block):
                        yield block.slice(k)

        self._wake(self._keep(in_time()))
        yield from behind

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1_000_000
        carried = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        walks: dict[Any, Walk] = {}

        def walk(k: Any) -> Walk:
            if k not in walks:
                walks[k] = copy.copy(self.walk)
                walks[k].resume(carried[k][0] if k in carried else None)
            return walks[k]

        waiting = sorted(tuple(k) for k in self.waiting.keys())
        due, rest = [k for k in waiting if k[0] < now], [k[0] for k in waiting if k[0] >= now][:1]
        left: list[pa.Table] = []
        for n in range(0, len(due), _SWEEP):
            until = min(now, due[n + _SWEEP][0]) if n + _SWEEP < len(due) else now  # no other block has an earlier row
            for k in due[n : n + _SWEEP]:
                left.append(_table(self.waiting.getValue(k)[0]))
                self.waiting.removeKey(k)
            held = pa.concat_tables(left).combine_chunks()
            ready = pa.compute.less(held["at"], until)
            yield from self._walked(held.filter(ready), walk)
            left = [held.filter(pa.compute.invert(ready))]
        if left and len(left[0]):
            rest.append(self._keep(_cut(left[0])))

        def settled() -> Iterator[tuple]:
            for k in [k for k, (_, due_ns) in carried.items() if due_ns is not None and due_ns <= now]:
                walk(k)
            for k, one in walks.items():
                yield from ((k, *o) for o in one.settle(now))
                carried.pop(k, None)
                if (carry := one.carry()) is not None:
                    carried[k] = carry, one.due_ns()

        yield from self._framed(settled())
        if carried:
            self.kept.update((pickle.dumps(carried),))
        else:
            self.kept.clear()
        wanted = [*rest, *(due_ns for _, due_ns in carried.values() if due_ns is not None)]
        self._wake(min(wanted, default=None), expiredTimerInfo.getExpiryTimeInMs())

    def _framed(self, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in found:
            out.append(row)
            if len(out) == _SLICE:
                yield self._frame(out, None)
                out = []
        if out:
            yield self._frame(out, None)

    def _walked(self, rows: pa.Table, walk: Callable[[Any], Walk]) -> Iterator[pd.DataFrame]:
        """What the walks give for rows that come after all before."""
        rows = rows.sort_by([(c, "ascending") for c in ("key", *self.order)]).combine_chunks()
        ends = _starts(rows["key"].to_numpy())

        def found() -> Iterator[tuple]:
            for a, b in zip(ends, ends[1:]):
                k = rows["key"][a].as_py()
                step = walk(k).row
                for n in range(a, b, _SLICE):
                    for values in zip(*[rows[c].slice(n, min(_SLICE, b - n)).to_numpy().tolist() for c in self.columns]):
                        for o in step(values):
                            yield (k, *o)

        return self._framed(found())

    def close(self) -> None:
        pass


def walked(rows: DataFrame, walk: Walk, columns: dict[str, str], order: list[str], out: dict[str, str], late: dict[str, str], delay: str, key: str, at: str) -> DataFrame:
    """The walk over a stream. ``columns``: what it needs and of which types; ``out``: the output's columns between key and ``problem``; ``late``: those of late rows, and what is in them; ``delay``: how late a row may come."""
    kind = rows.schema[key].dataType.simpleString()
    held = rows.where(F.col(at).isNotNull()).withColumn("at", F.col(at)).withColumn("event_time", F.timestamp_micros(F.floor(F.col(at) / 1000)))
    # without the column, Spark doesn't take late rows away before they can be given back
    held = held.withWatermark("event_time", delay)
    zero = {"int": F.lit(0), "long": F.lit(0).cast("long"), "double": F.lit(0.0)}
    beat = F.greatest(*[F.col(c).isNull() for c in (key, *columns)], F.lit(False))
    some = F.coalesce(F.col(key), F.lit("" if kind == "string" else 0).cast(kind))  # whichever key a heartbeat has
    bucket = F.pmod(F.xxhash64(some), F.lit(_BUCKETS)).cast("int")
    held = held.select(bucket.alias("bucket"), some.alias("key"), "at", beat.alias("beat"), *[F.coalesce(F.col(c).cast(t), zero[t]).alias(c) for c, t in columns.items()])
    names = ["at", *columns]
    processor = InOrder(walk, names, order, [key, *out, "problem"], late)
    result = ", ".join([f"`{key}` {kind}", *[f"`{c}` {t}" for c, t in out.items()], "problem string"])
    return held.mapInArrow(_blocks, "bucket int, rows binary").groupBy("bucket").transformWithStateInPandas(processor, result, "Append", "EventTime")
