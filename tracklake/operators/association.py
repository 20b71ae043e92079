"""Joins of streams by time.

Streams have a key, a time in long nanoseconds and an index that breaks ties. ``reference`` rows are all returned.
Bounded searches deal both streams out by (key, time bucket), a sample going to each bucket that its tolerance
reaches; the unbounded ones and the search for gaps go over ranges of rows and carry the last and the next sample from
one to the other (operators/chunks.py). So one long recording is not one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import chunks
from tracklake.operators.scans import scanned


def _sides(reference: DataFrame, sample: DataFrame, key: str, time: str, index: str, bucket: tuple[Column, Column] | None = None) -> DataFrame:
    """Both streams as one: key, t, side (0 reference, 1 sample), i, and a struct s of a sample's (t, i)."""
    r = reference.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(index).alias("i"))
    s = sample.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(index).alias("i"))
    r, s = (x.withColumn("bucket", b if bucket else F.lit(0)) for x, b in zip((r, s), bucket or (None, None), strict=True))
    none = F.lit(None).cast("struct<t:bigint,i:bigint>")
    return r.withColumn("side", F.lit(0)).withColumn("s", none).unionByName(s.withColumn("side", F.lit(1)).withColumn("s", F.struct(F.col("t").cast("long").alias("t"), F.col("i").cast("long").alias("i"))))


def _buckets(reach_ns: int) -> tuple[Column, Column]:
    """The time bucket of a reference, and all buckets that a sample can be met in."""
    cell = lambda t: F.floor(t / F.lit(max(16 * reach_ns, 1_000_000_000))).cast("long")
    return cell(F.col("t")), F.explode(F.sequence(cell(F.col("t") - reach_ns), cell(F.col("t") + reach_ns)))


def _around(both: DataFrame, exact_below: bool, bucketed: bool) -> DataFrame:
    """Reference rows with the last sample before (or at, if exact_below) and the first at or after.

    In buckets a window finds them; over whole keys they are carried from one range of rows to the next.
    """
    # references stand before samples of the same time, so "before" is strict and "after" includes the same time
    if bucketed:
        part, so_far = Window.partitionBy("key", "bucket"), (Window.unboundedPreceding, 0)
        # of samples at one time the smallest index is the nearest
        below = F.last("s", ignorenulls=True).over(part.orderBy("t", "side", F.col("i") if exact_below else F.col("i").desc()).rowsBetween(*so_far))
        above = F.last("s", ignorenulls=True).over(part.orderBy(*[F.col(o).desc_nulls_last() for o in ("t", "side", "i")]).rowsBetween(*so_far))
        out = both.withColumns({"below": below, "above": above})
    else:
        known = F.col("s").isNotNull()
        c = chunks.with_known(chunks.chunked(both.drop("bucket"), ["key"], ["t", "side", "i"]), known, [], "below")
        out = chunks.with_known(c, known, [], "above", ahead=True).rows
    out = out.where("side = 0").select("key", "t", "side", "i", "below", "above")
    if exact_below:
        out = out.withColumn("below", F.when(F.col("above.t") == F.col("t"), F.col("above")).otherwise(F.col("below")))
    return out


def nearest(reference: DataFrame, sample: DataFrame, tolerance_ns: int | None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """key, index, time, sample_index, sample_t_ns, residual_ns of each reference row.

    Samples may be used again; of two equally near the earlier one is taken; the residual is sample minus reference.
    With a tolerance, rows without a sample that near have nulls; without one, the nearest is always given.
    """
    bucket = None if tolerance_ns is None else _buckets(tolerance_ns)
    found = _around(_sides(reference, sample, key, time, index, bucket), exact_below=False, bucketed=bucket is not None)
    earlier = F.col("below").isNotNull() & (F.col("above").isNull() | (F.col("t") - F.col("below.t") <= F.col("above.t") - F.col("t")))
    found = found.withColumn("s", F.when(earlier, F.col("below")).otherwise(F.col("above")))
    if tolerance_ns is not None:
        found = found.withColumn("s", F.when(F.abs(F.col("s.t") - F.col("t")) <= tolerance_ns, F.col("s")))
    return found.select(F.col("key").alias(key), F.col("i").alias(index), F.col("t").alias(time), F.col("s.i").alias("sample_index"), F.col("s.t").alias("sample_t_ns"), (F.col("s.t") - F.col("t")).alias("residual_ns"))


def nearest_with_validity(reference: DataFrame, sample: DataFrame, tolerance_ns: int, **names: str) -> DataFrame:
    """The nearest sample however far, and ``association_valid``: whether it is within the tolerance."""
    valid = F.coalesce(F.abs("residual_ns") <= tolerance_ns, F.lit(False))
    return nearest(reference, sample, None, **names).withColumn("association_valid", valid)


def first_unmatched(reference: DataFrame, sample: DataFrame, tolerance_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """First reference row of each key without a sample in tolerance, and how many there are; no rows if all match."""
    missed = nearest(reference, sample, tolerance_ns, key, time, index).where("sample_index is null")
    first = F.min(F.struct(time, index))
    return missed.groupBy(key).agg(first[index].alias(index), first[time].alias(time), F.count("*").alias("n_unmatched"))


def islands(both: DataFrame, tolerance_ns: int) -> DataFrame:
    """Numbers the stretches of the union that no feasible pair reaches across."""
    c = chunks.with_neighbour(chunks.chunked(both, ["key"], ["t", "side", "i"]), [])
    gap = F.coalesce(F.col("t") - F.col("_before.t") > tolerance_ns, F.lit(True))
    return chunks.with_running(c, gap.cast("long"), "island").rows.drop("_before", "_chunk")


def one_to_one(reference: DataFrame, sample: DataFrame, tolerance_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """Pairs in time order, each sample and reference used once, the earliest feasible pair first.

    The two streams are cut where a gap exceeds the tolerance, so many stretches of a recording are paired apart. In a
    stretch rows pass as a stream: what is kept is the rows that are still in reach of the newest one.
    """
    held = islands(_sides(reference, sample, key, time, index).drop("s", "bucket"), tolerance_ns)
    # pieces with one side only hold no pair and don't leave the JVM
    both = held.groupBy(F.col("key").alias("_key"), F.col("island").alias("_island")).agg(F.min("side").alias("_low"), F.max("side").alias("_high")).where("_low < _high")
    held = held.join(both, held["key"].eqNullSafe(F.col("_key")) & (F.col("island") == F.col("_island")), "left_semi")
    key_type = reference.schema[key].dataType.simpleString()

    def pair(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting: tuple[deque, deque] = (deque(), deque())
        references, samples = waiting
        for k, _, t, side, i in rows:
            waiting[side].append((t, i))
            while references and samples:
                d = samples[0][0] - references[0][0]
                if abs(d) <= tolerance_ns:
                    yield k, references[0][1], references[0][0], samples[0][1], d
                if d >= -tolerance_ns:
                    references.popleft()
                if d <= tolerance_ns:
                    samples.popleft()
            for side_ in waiting:
                while side_ and t - side_[0][0] > tolerance_ns:
                    side_.popleft()

    return scanned(held, ["key", "island"], ["t", "side", "i"], ["t", "side", "i"], pair, f"`{key}` {key_type}, `{index}` long, `{time}` long, sample_index long, residual_ns long")


def unique_nearest(reference: DataFrame, sample: DataFrame, tolerance_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """nearest() with each sample given to one reference: smallest residual, then lowest index; ``state`` says won, lost or none."""
    order = Window.partitionBy(key, "sample_index").orderBy(F.abs("residual_ns"), index)
    found = nearest(reference, sample, tolerance_ns, key, time, index).withColumn("_rank", F.row_number().over(order))
    state = F.when(F.col("sample_index").isNull(), "none").when(F.col("_rank") == 1, "won").otherwise("lost")
    return found.withColumn("state", state).drop("_rank")


def bracket(reference: DataFrame, sample: DataFrame, max_gap_ns: int | None = None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """key, index, time, lower/upper index and time, alpha: samples around each reference, no extrapolation.

    A sample at the very time is both ends, with alpha 0. Wider gaps than ``max_gap_ns`` give nulls; with that bound
    both ends are near the reference, so the streams are dealt out by time bucket; without one, by ranges of rows.
    """
    found = _around(_sides(reference, sample, key, time, index, None if max_gap_ns is None else _buckets(max_gap_ns)), exact_below=True, bucketed=max_gap_ns is not None)
    good = F.col("below").isNotNull() & F.col("above").isNotNull()
    if max_gap_ns is not None:
        good = good & (F.col("above.t") - F.col("below.t") <= max_gap_ns)
    found = found.withColumns({c: F.when(good, F.col(c)) for c in ("below", "above")})
    gap = F.col("above.t") - F.col("below.t")
    alpha = F.when(gap > 0, (F.col("t") - F.col("below.t")) / gap).when(gap == 0, 0.0)
    return found.select(F.col("key").alias(key), F.col("i").alias(index), F.col("t").alias(time), F.col("below.i").alias("lower_index"), F.col("above.i").alias("upper_index"), F.col("below.t").alias("lower_t_ns"), F.col("above.t").alias("upper_t_ns"), alpha.alias("alpha"))


def interpolated(reference: DataFrame, sample: DataFrame, values: list[str], max_gap_ns: int | None = None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """bracket() with the values interpolated linearly."""
    found = bracket(reference, sample, max_gap_ns, key, time, index)
    for side in ("lower", "upper"):
        ends = sample.select(F.col(key), F.col(index).alias(f"{side}_index"), *[F.col(v).alias(f"_{side}_{v}") for v in values])
        found = found.join(ends, [key, f"{side}_index"], "left")
    lerp = {v: F.col(f"_lower_{v}") + F.col("alpha") * (F.col(f"_upper_{v}") - F.col(f"_lower_{v}")) for v in values}
    return found.withColumns(lerp).drop(*[f"_{s}_{v}" for s in ("lower", "upper") for v in values])


def supported(reference: DataFrame, sample: DataFrame, good: Column, before_ns: int, after_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """key, index, supported: whether all samples that cover [t - before, t + after] are good, and the interval is covered."""
    bad = (~good).cast("long")
    counted = chunks.with_running(chunks.chunked(sample, [key], [time, index]), bad, "_bad").rows.withColumn("_own", bad)
    ends = []
    for side, shift in (("lower", -before_ns), ("upper", after_ns)):
        moved = reference.select(key, index, (F.col(time) + shift).alias(time))
        found = bracket(moved, sample, None, key, time, index).select(key, index, F.col(f"{side}_index").alias("_at"))
        value = F.col("_bad") - F.col("_own") if side == "lower" else F.col("_bad")
        ends.append(found.join(counted.select(key, F.col(index).alias("_at"), value.alias(f"_{side}")), [key, "_at"], "left").drop("_at"))
    return ends[0].join(ends[1], [key, index]).select(key, index, F.coalesce(F.col("_upper") == F.col("_lower"), F.lit(False)).alias("supported"))


def time_key_pairs(left: DataFrame, right: DataFrame, rate: float, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """Equi-join on the nearest tick of a fixed rate."""
    tick = F.bround((F.col(time) / 1e9) * rate, 0).cast("long")
    a = left.select(key, tick.alias("tick"), F.col(index).alias("left_index"))
    b = right.select(key, tick.alias("tick"), F.col(index).alias("right_index"))
    return a.join(b, [key, "tick"])

