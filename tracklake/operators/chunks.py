"""Scans over recordings of any length: ranges of rows as tasks, and what one range has to know of those before it.

``chunked`` deals the rows out by ranges of (keys, order), so that a recording that holds all rows is as many
tasks as there are partitions, and short recordings share one. Everything else works inside a chunk of a key, plus a table
with one row for each chunk of a key, over which the carry runs: the last row, the last known value, a sum. That
table has at most as many rows as there are keys and partitions together, so its windows are short. Window frames of a
bounded number of rows work on blocks of rows that overlap by that number.

The order columns tell every two rows of a key apart; null keys are a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.operators.pairs import checkpointed

#: Rows of a block of with_blocks(), or four times the overlap if that is more.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Chunked:
    """Rows with ``_chunk``, their keys and the order inside a key."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def inside(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*self.order)

    @property
    def back(self) -> WindowSpec:
        """From the end of a chunk: what comes after a row, without a frame that is read anew for each row."""
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*[F.col(o).desc_nulls_last() for o in self.order])

    @property
    def along(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_chunk")

    def of(self, rows: DataFrame) -> Chunked:
        return Chunked(rows, self.keys, self.order)

    def ends(self, columns: Sequence[str], last: bool = True, where: Column | None = None) -> DataFrame:
        """keys, _chunk, _end: the last (or first) row of each chunk, out of those where ``where`` holds."""
        row = F.struct(*self.order, *[c for c in columns if c not in self.order])
        row = row if where is None else F.when(where, row)
        return self.rows.groupBy(*self.keys, "_chunk").agg((F.max(row) if last else F.min(row)).alias("_end"))

    def told(self, carry: DataFrame) -> DataFrame:
        """The rows with the columns of their chunk's row in ``carry``."""
        renamed = carry.select(*[F.col(k).alias(f"_{i}k") for i, k in enumerate(self.keys)], F.col("_chunk").alias("_ck"), *[c for c in carry.columns if c not in (*self.keys, "_chunk")])
        same = F.col("_chunk") == F.col("_ck")
        for i, k in enumerate(self.keys):
            same = same & self.rows[k].eqNullSafe(F.col(f"_{i}k"))
        return self.rows.join(renamed, same, "left").drop("_ck", *[f"_{i}k" for i in range(len(self.keys))])


def chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> Chunked:
    """The rows dealt out by ranges; the bounds are sampled, so what is dealt is written to the shared folder."""
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    return Chunked(checkpointed(placed), tuple(keys), tuple(order))


def with_neighbour(c: Chunked, columns: Sequence[str], out: str = "_before", ahead: bool = False) -> Chunked:
    """Adds a struct of the row before (or after) in the whole key, null for the first (or last) one."""
    carry = c.ends(columns, last=not ahead)
    step = F.lead if ahead else F.lag
    carry = carry.select(*c.keys, "_chunk", step("_end").over(c.along).alias("_beyond"))
    own = F.struct(*c.order, *[x for x in columns if x not in c.order])
    return c.of(c.told(carry).withColumn(out, F.coalesce(step(own).over(c.inside), "_beyond")).drop("_beyond"))


def with_known(c: Chunked, known: Column, columns: Sequence[str], out: str, ahead: bool = False) -> Chunked:
    """Adds a struct of the last row up to this one (or the first from this one on) where ``known`` holds, in the whole key."""
    carry = c.ends(columns, last=not ahead, where=known)
    beyond = (
        F.first("_end", ignorenulls=True).over(c.along.rowsBetween(1, Window.unboundedFollowing))
        if ahead
        else F.last("_end", ignorenulls=True).over(c.along.rowsBetween(Window.unboundedPreceding, -1))
    )
    carry = carry.select(*c.keys, "_chunk", beyond.alias("_beyond"))
    row = F.when(known, F.struct(*c.order, *[x for x in columns if x not in c.order]))
    here = F.last(row, ignorenulls=True).over((c.back if ahead else c.inside).rowsBetween(Window.unboundedPreceding, 0))
    return c.of(c.told(carry).withColumn(out, F.coalesce(here, "_beyond")).drop("_beyond"))


def with_running(c: Chunked, value: Column, out: str) -> Chunked:
    """Adds the sum of ``value`` up to and including the row, in the whole key.

    A chunk goes on from what its last row before has, by the same additions in the same order, so a sum never steps back.
    """
    part = c.of(c.rows.withColumn("_part", F.sum(value).over(c.inside.rowsBetween(Window.unboundedPreceding, 0))))
    total = part.ends(["_part"]).select(*c.keys, "_chunk", F.sum("_end._part").over(c.along.rowsBetween(Window.unboundedPreceding, -1)).alias("_sum"))
    return c.of(part.told(total).withColumn(out, F.coalesce(F.col("_sum") + F.col("_part"), "_part")).drop("_sum", "_part"))


def with_blocks(c: Chunked, overlap: int) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows in blocks that begin with up to ``overlap`` rows of the one before, a window over a block, and which rows are a block's own."""
    size = max(BLOCK, 4 * overlap)
    numbered = with_running(c, F.lit(1).cast("long"), "_row").rows.drop("_chunk")
    at = F.col("_row") - 1
    block = F.floor(at / size)
    later = F.when(at % size >= size - overlap, F.array(block, block + 1)).otherwise(F.array(block))
    blocks = numbered.withColumn("_block", F.explode(later))
    return blocks, Window.partitionBy(*c.keys, "_block").orderBy(*c.order), F.col("_block") == block


def _step(before: str, xyz: Sequence[str]) -> Column:
    square = sum(((F.col(v) - F.col(f"{before}.{v}")) * (F.col(v) - F.col(f"{before}.{v}")) for v in xyz), F.lit(0.0))
    return F.coalesce(F.sqrt(square), F.lit(0.0))


def sample_by_distance(rows: DataFrame, spacing_m: float, key: str, order: Sequence[str], *xyz: str) -> DataFrame:
    """Rows where the travelled distance passes another multiple of the spacing, and the first row; adds path_m."""
    c = with_neighbour(chunked(rows, [key], order), xyz)
    c = with_running(c, _step("_before", xyz), "path_m")
    c = with_neighbour(c, ["path_m"], "_last")
    cell = lambda path: F.floor((F.col(path) + 1e-12) / spacing_m)
    return c.rows.where(F.col("_last").isNull() | (cell("path_m") > cell("_last.path_m"))).drop("_before", "_last", "_chunk")


def unwrapped(rows: DataFrame, key: str, order: Sequence[str], angle: str, out: str) -> DataFrame:
    """Adds multiples of a full turn so that no step exceeds half a turn."""
    c = with_neighbour(chunked(rows, [key], order), [angle])
    d = F.col(angle) - F.col(f"_before.{angle}")
    turns = F.when(F.abs(d) > math.pi, -F.floor((d + math.pi) / (2 * math.pi))).otherwise(0)
    c = with_running(c, F.coalesce(turns, F.lit(0)).cast("long"), "_turns")
    return c.rows.withColumn(out, F.col(angle) + 2 * math.pi * F.col("_turns")).drop("_before", "_turns", "_chunk")


def gaps_filled(rows: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Nulls replaced by linear interpolation over the row number; ends take the nearest value."""
    c = with_running(chunked(rows, [key], order), F.lit(1).cast("long"), "_row")
    known = F.col(value).isNotNull()
    c = with_known(with_known(c, known, ["_row", value], "_a"), known, ["_row", value], "_b", ahead=True)
    a, b = F.col(f"_a.{value}"), F.col(f"_b.{value}")
    between = a + (b - a) * (F.col("_row") - F.col("_a._row")) / (F.col("_b._row") - F.col("_a._row"))
    filled = F.when(known, F.col(value)).when(F.col("_a").isNull(), b).when(F.col("_b").isNull(), a).otherwise(between)
    return c.rows.withColumn(out, filled).drop("_row", "_a", "_b", "_chunk")


def runs(rows: DataFrame, flag: str, key: str, order: Sequence[str], index: str) -> DataFrame:
    """key, flag, first_index, last_index, n of each maximal run of one flag, however long; null is a flag too."""
    c = with_neighbour(chunked(rows.select(*dict.fromkeys([key, flag, *order, index])), [key], order), [flag])
    c = with_running(c, (F.col("_before").isNull() | ~F.col(flag).eqNullSafe(F.col(f"_before.{flag}"))).cast("long"), "_run")
    row = F.struct(*order, *([index] if index not in order else []))
    out = c.rows.groupBy(key, "_run", flag).agg(F.min(row)[index].alias("first_index"), F.max(row)[index].alias("last_index"), F.count("*").alias("n"))
    return out.drop("_run")


def path_windows(rows: DataFrame, key: str, order: Sequence[str], steps: int, prior: Sequence[str], refined: Sequence[str], absolute_m: float, relative: float) -> DataFrame:
    """Length of both paths over the last ``steps`` steps, and whether they differ by more than max(absolute, relative * prior); only full windows."""
    c = with_neighbour(chunked(rows, [key], order), [*prior, *[v for v in refined if v not in prior]])
    c = c.of(c.rows.withColumn("_p", _step("_before", prior)).withColumn("_r", _step("_before", refined)).drop("_before"))
    blocks, w, own = with_blocks(c, steps)
    span = w.rowsBetween(-(steps - 1), 0)
    out = blocks.withColumn("prior_m", F.sum("_p").over(span)).withColumn("refined_m", F.sum("_r").over(span))
    out = out.where(own & (F.col("_row") > steps)).drop("_p", "_r", "_row", "_block")
    return out.withColumn("difference_m", F.abs(F.col("refined_m") - F.col("prior_m"))).withColumn("failed", F.col("difference_m") > F.greatest(F.lit(absolute_m), relative * F.col("prior_m")))
