"""Scans with carried state over rows in order: a worker sees one key's rows as a stream, never as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by the keys to as many tasks as shuffles have partitions.

    Spark would put partitions of few bytes together into one task; with the number given it doesn't, and Python's work stays spread.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task of spread().
TASK_ROWS = 1 << 18


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by the keys to tasks of about TASK_ROWS rows, as many tasks as shuffles have partitions at least.

    Groupings and joins by these keys that follow need no other shuffle. Spark would size them by bytes, of which a row of a
    grouping takes many times what it has in a shuffle; so what a task holds doesn't grow with the table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // TASK_ROWS)), *keys)


#: Rows that a worker gathers before it hands them on.
BATCH = 8192


def scanned(df: DataFrame, keys: list[str], order: list[str], values: list[str], walk: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``walk`` yields for each key from its rows (keys, then values) in order.

    Keys are hashed to tasks, which sort (and spill) in the JVM; ``walk`` gets an iterator, so that a worker holds one
    batch and what ``walk`` keeps. Many small keys share a batch. Null keys are a key.
    """
    columns, n = [*keys, *values], len(keys)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(len(columns))), strict=True))
        found = (out for _, own in groupby(rows, key=lambda row: row[:n]) for out in walk(own))
        while part := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    placed = dealt(df.select(*columns, *[c for c in order if c not in columns]), *keys).sortWithinPartitions(*keys, *order)
    return placed.select(*columns).mapInArrow(run, schema)
