"""Ordered series of a segment: sampling by distance, rates, blocks, smoothing, gradients, gaps, windows of rows.

A segment is ordered by one task here. For recordings of any length see operators/chunks.py, which has the same
operators (distance, unwrapping, gaps, runs, path windows) over ranges of rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.operators.pairs import checkpointed
from tracklake.operators.scans import scanned, spread


def ordered(key: str = "segment_id", *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(order or ("frame",)))


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def step_length(w: WindowSpec, *xyz: str) -> Column:
    """Distance from the row before, 0 for the first."""
    square = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in xyz), F.lit(0.0))
    return F.coalesce(F.sqrt(square), F.lit(0.0))


def path_length(df: DataFrame, w: WindowSpec, *xyz: str) -> DataFrame:
    return df.withColumn("_step", step_length(w, *xyz)).withColumn("path_m", F.sum("_step").over(_so_far(w))).drop("_step")


def sample_by_distance(df: DataFrame, spacing_m: float, w: WindowSpec, *xyz: str) -> DataFrame:
    """Rows where the travelled distance passes another multiple of the spacing, and the first row; adds path_m."""
    with_path = path_length(df, w, *xyz)
    cell = F.floor((F.col("path_m") + 1e-12) / spacing_m)
    cells = with_path.withColumn("_cell", cell)
    return cells.withColumn("_before", F.lag("_cell").over(w)).where("_before is null or _cell > _before").drop("_cell", "_before")


def rates(df: DataFrame, w: WindowSpec, time: str, *xyz: str) -> DataFrame:
    """dt_s, speed, acceleration from the row before."""
    dt = (F.col(time) - F.lag(time).over(w)) / 1e9
    out = df.withColumn("dt_s", dt).withColumn("speed", F.when(F.col("dt_s") > 0, step_length(w, *xyz) / F.col("dt_s")))
    return out.withColumn("acceleration", F.when(F.col("dt_s") > 0, (F.col("speed") - F.lag("speed").over(w)) / F.col("dt_s")))


def state_changes(df: DataFrame, w: WindowSpec, state: str) -> DataFrame:
    """before_change and at_change marks."""
    return df.withColumn("before_change", F.coalesce(F.col(state) != F.lead(state).over(w), F.lit(False))).withColumn("at_change", F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(False)))


def temporal_role(df: DataFrame, w: WindowSpec, key: str, blocks: int) -> DataFrame:
    """Block = row * blocks div rows; odd blocks are held out, even ones calibrate."""
    n = F.count("*").over(Window.partitionBy(key))
    block = F.floor(F.col("_i") * blocks / F.col("_n")).cast("long")
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).withColumn("block", block)
    return out.withColumn("role", F.when(F.col("block") % 2 == 1, "holdout").otherwise("calibration")).drop("_i", "_n")


def time_blocks(df: DataFrame, key: str, time: str, blocks: int, stride: int, offset: int) -> DataFrame:
    """Blocks of equal time between a segment's ends; every stride-th from offset is held out."""
    part = Window.partitionBy(key)
    low, high = F.min(time).over(part), F.max(time).over(part)
    cell = F.when(high > low, F.least(F.floor((F.col(time) - low) * blocks / (high - low)), F.lit(blocks - 1))).otherwise(0).cast("long")
    return df.withColumn("block", cell).withColumn("holdout", F.col("block") % stride == offset)


def smoothed(df: DataFrame, w: WindowSpec, key: str, width: int, *values: str) -> DataFrame:
    """Box filter over ``width`` rows; rows beyond the ends count as the first or last value."""
    before, after = width // 2, width - 1 - width // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    lack = F.greatest(before - F.col("_i"), F.lit(0)), F.greatest(F.col("_i") + after + 1 - F.col("_n"), F.lit(0))
    for v in values:
        inside = F.sum(v).over(w.rowsBetween(-before, after))
        out = out.withColumn(f"{v}_smooth", (inside + lack[0] * F.first(v).over(whole) + lack[1] * F.last(v).over(whole)) / width)
    return out.drop("_i", "_n")


def gradient(w: WindowSpec, value: str, time: str) -> Column:
    """Second-order differences over uneven times, one-sided at the ends."""
    v, t = F.col(value), F.col(time)
    h0, h1 = t - F.lag(time).over(w), F.lead(time).over(w) - t
    d0, d1 = (v - F.lag(value).over(w)) / h0, (F.lead(value).over(w) - v) / h1
    return F.when(h0.isNull(), d1).when(h1.isNull(), d0).otherwise((h1 * d0 + h0 * d1) / (h0 + h1))


def unwrapped(df: DataFrame, w: WindowSpec, angle: str, out: str) -> DataFrame:
    """Adds multiples of a full turn so that no step exceeds half a turn."""
    d = F.col(angle) - F.lag(angle).over(w)
    turns = F.when(F.abs(d) > math.pi, -F.floor((d + math.pi) / (2 * math.pi))).otherwise(0)
    return df.withColumn("_turns", F.coalesce(turns, F.lit(0)).cast("long")).withColumn(out, F.col(angle) + 2 * math.pi * F.sum("_turns").over(_so_far(w))).drop("_turns")


def gaps_filled(df: DataFrame, w: WindowSpec, value: str, out: str) -> DataFrame:
    """Nulls replaced by linear interpolation over the row number; ends take the nearest value."""
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_s", F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))))
    a = F.last("_s", ignorenulls=True).over(_so_far(w))
    b = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    numbered = numbered.withColumn("_a", a).withColumn("_b", b)
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    return numbered.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between)).drop("_i", "_s", "_a", "_b")


def path_windows(df: DataFrame, w: WindowSpec, rows: int, prior: tuple[str, ...] | Column, refined: tuple[str, ...] | Column, absolute_m: float, relative: float) -> DataFrame:
    """Length of both paths over the last ``rows`` steps, and whether they differ by more than max(absolute, relative * prior); only full windows.

    A path is the names of its coordinates, or the length of each row's step.
    """
    lengths = {n: path if isinstance(path, Column) else step_length(w, *path) for n, path in (("_p", prior), ("_r", refined))}
    out = df.withColumns(lengths)
    span = w.rowsBetween(-(rows - 1), 0)
    out = out.withColumn("prior_m", F.sum("_p").over(span)).withColumn("refined_m", F.sum("_r").over(span)).withColumn("_n", F.count("*").over(w.rowsBetween(-rows, 0)))
    out = out.where(F.col("_n") == rows + 1).drop("_p", "_r", "_n")
    return out.withColumn("difference_m", F.abs(F.col("refined_m") - F.col("prior_m"))).withColumn("failed", F.col("difference_m") > F.greatest(F.lit(absolute_m), relative * F.col("prior_m")))


def row_windows(df: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """key, ordinal, first and last row of overlapping windows; the last one ends at the last row."""
    stride = size - overlap
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    count = F.when(F.col("_n") <= size, 1).otherwise(F.ceil((F.col("_n") - size) / stride) + 1)
    cells = n.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    last = F.least(F.col("ordinal") * stride + size, F.col("_n")) - 1
    return cells.select(key, "ordinal", F.greatest(F.lit(0), last - size + 1).cast("long").alias("first_row"), last.cast("long").alias("last_row"))


def end_distance(w: WindowSpec, key: str) -> Column:
    """min(i + 1, n - i) of row i."""
    i = F.row_number().over(w)
    return F.least(i, F.count("*").over(Window.partitionBy(key)) - i + 1).cast("long")


def chain_gaps(chunks: DataFrame, key: str, start: str, stop: str, order: str) -> DataFrame:
    """Each chunk's gap to the one before (negative: overlap) and whether its start increases."""
    w = Window.partitionBy(key).orderBy(order)
    return chunks.withColumn("gap", F.col(start) - F.lag(stop).over(w)).withColumn("start_increases", F.coalesce(F.col(start) > F.lag(start).over(w), F.lit(True)))


def order_violations(df: DataFrame, key: str, order: str, time: str, strict: bool = True) -> DataFrame:
    """Rows whose time isn't after (or, if not strict, is before) that of the row before."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("before", before).where(F.col(time) <= F.col("before") if strict else F.col(time) < F.col("before"))


def first_per_time(df: DataFrame, key: str, time: str, index: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key, time).orderBy(index))).where("_k = 1").drop("_k")


def every_kth(df: DataFrame, w: WindowSpec, k: int, offset: int = 0) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % k == offset).drop("_i")


#: Intervals of a group of decimated() at least.
INTERVALS = 8


def decimated(df: DataFrame, interval: int, key: str, time: str, index: str) -> DataFrame:
    """key, index, time of rows at least ``interval`` after the last accepted one, the smallest index of a time. The state is carried inside a key.

    A key is cut into groups of intervals, wherever its gaps are. A group's task finds for every row that may be its first
    accepted one which row is then its last: chains from such rows soon meet, and at the end there are at most two more than the
    emptiest of the group's intervals has rows. Over this table, about an eighth of the times at most, the state passes from
    group to group; then every group is decimated from its own. A worker holds the times of a group's first interval.
    """
    rows = df.select(key, index, time).where(F.col(time).isNotNull())
    if interval <= 0:
        return rows
    low, high = rows.agg(F.min(time), F.max(time)).first()
    if low is None:
        return rows
    kind = lambda c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    width = max(INTERVALS * interval, (high - low) / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    grouped = spread(rows.withColumn("_group", F.floor(F.col(time) / F.lit(float(width))).cast("long")), key, "_group", time)
    first = checkpointed(grouped.groupBy(key, "_group", time).agg(F.min(index).alias(index)))

    def chains(rows: Iterator[tuple]) -> Iterator[tuple]:
        upto, joined = [], []  # the rows that may be the first one, and which one's chain each has met
        at: deque[tuple] = deque()  # the last row of each chain, in order, and the chain
        more = True
        for k, g, t in rows:
            chain = None
            while at and t - at[0][0] >= interval:
                met = at.popleft()[1]
                chain, joined[met] = (met, met) if chain is None else (chain, chain)
            if more:
                chain = len(upto) if chain is None else chain
                upto.append(t)
                joined.append(chain)
                more = t - upto[0] < interval
            if chain is not None:
                at.append((t, chain))
        ends = {chain: t for t, chain in at}
        held = None
        for i, t in enumerate(upto):
            while joined[i] != joined[joined[i]]:
                joined[i] = joined[joined[i]]
            end = ends[joined[i]]
            if held is not None and held[1] != end:
                yield k, g, *held
            held = t, end
        yield k, g, *held

    def enter(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = after = group = None
        for k, g, upto, end in rows:
            if g != group:
                group, last, met = g, after, False
                if last is not None:
                    yield k, g, last
            if not met and (last is None or upto - last >= interval):
                met, after = True, end

    def accept(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for k, _, i, t, own in rows:
            if own and (last is None or t - last >= interval):
                yield k, i, t
                last = t
            elif not own:
                last = t

    state = kind(time).removeprefix(f"`{time}`")
    tables = scanned(first, [key, "_group"], [time], [time], chains, f"{kind(key)}, _group long, _upto {state}, _end {state}")
    states = scanned(tables, [key], ["_group", "_upto"], ["_group", "_upto", "_end"], enter, f"{kind(key)}, _group long, {kind(time)}")
    both = first.withColumn("_own", F.lit(True)).unionByName(states.withColumns({index: F.lit(None).cast(df.schema[index].dataType), "_own": F.lit(False)}))
    return scanned(both, [key, "_group"], [time], [index, time, "_own"], accept, f"{kind(key)}, {kind(index)}, {kind(time)}")


def inherited(df: DataFrame, w: WindowSpec, member: str, known: Column, out: str) -> DataFrame:
    """Rows without evidence take membership if the nearest known row before or after has it."""
    held = df.withColumn("_m", F.when(known, F.col(member)))
    a, b = F.last("_m", ignorenulls=True).over(_so_far(w)), F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return held.withColumn(out, F.when(known, F.col(member)).otherwise(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))).drop("_m")
