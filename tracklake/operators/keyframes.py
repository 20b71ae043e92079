"""Keyframes: forced reasons, then motion since the last selected frame.

A forced frame is always selected, so the state starts anew there: stretches from one forced frame to the next can be
scanned apart, many of them in one segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.quality import runs
from tracklake.operators.scans import scanned

#: Fixed order of reasons.
REASONS = ("endpoint", "turn_entry", "turn_peak", "turn_exit", "gnss_before_change", "gnss_state_change", "spatial_revisit_source", "spatial_revisit", "translation", "rotation", "max_elapsed", "quality_override")


#: Stretches between forced frames that a worker takes at once.
STRETCHES = 256


@dataclass(frozen=True)
class KeyframePolicy:
    translation_m: float = 0.5
    rotation_deg: float = 10.0
    elapsed_s: float = 1.5


def forced_reasons(frames: DataFrame, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, index, reasons: ends of segments, turns (column ``turning``, peak at the largest ``step_deg``) and status changes."""
    w = Window.partitionBy(key).orderBy(time, index)
    marks = frames.select(key, index, time, "turning", "step_deg", "status").withColumns({"_prev": F.lag("status").over(w), "_next": F.lead("status").over(w), "_first": F.lag(index).over(w).isNull(), "_last": F.lead(index).over(w).isNull()})
    named = [("endpoint", F.col("_first") | F.col("_last")), ("gnss_before_change", F.col("_next") != F.col("status")), ("gnss_state_change", F.col("_prev") != F.col("status"))]
    plain = marks.select(key, index, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in named]))).alias("reason"))
    turn = runs(frames, "turning", key, time, index).where("turning").withColumn("_run", F.monotonically_increasing_id())
    ends = turn.select(key, F.explode(F.array(F.struct(F.col("first_index").alias("i"), F.lit("turn_entry").alias("r")), F.struct(F.col("last_index").alias("i"), F.lit("turn_exit").alias("r")))).alias("e")).select(key, F.col("e.i").alias(index), F.col("e.r").alias("reason"))
    changed = F.coalesce(F.col("turning") != F.lag("turning").over(w), F.lit(True))
    numbered = frames.withColumn("_run", F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("turning")
    peak = numbered.groupBy(key, "_run").agg(F.min(F.struct(-F.col("step_deg"), F.col(index)))[index].alias(index)).select(key, index, F.lit("turn_peak").alias("reason"))
    return plain.unionByName(ends).unionByName(peak).groupBy(key, index).agg(F.collect_set("reason").alias("reasons"))


def select_keyframes(frames: DataFrame, forced: DataFrame, policy: KeyframePolicy = KeyframePolicy(), key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, index, reasons (comma-joined, in fixed order) of the selected frames.

    ``frames`` has x, y, z, a unit quaternion qx, qy, qz, qw, and ``acceptable``; frames of poor quality are selected
    only where forced or overdue, with quality_override.
    """
    w = Window.partitionBy(key).orderBy(time, index)
    held = frames.select(key, index, time, "x", "y", "z", "qx", "qy", "qz", "qw", "acceptable").join(forced, [key, index], "left")
    held = held.withColumn("_anchor", F.sum(F.col("reasons").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a task takes some stretches that follow each other, as a stream; the frame after them, forced and so selected, is theirs
    # to report, for its motion is measured from their last selected frame
    held = held.withColumn("_part", F.floor((F.col("_anchor") - 1) / STRETCHES).cast("long"))
    starts = held.where((F.col("_anchor") - 1) % STRETCHES == 0).where("reasons is not null and _part > 0").withColumn("_part", F.col("_part") - 1)
    held = held.unionByName(starts)
    kind = lambda c: frames.schema[c].dataType.simpleString()
    limit = lambda x: x - 1e-12 * max(1.0, abs(x))
    far, turned, late = limit(policy.translation_m), limit(policy.rotation_deg), limit(policy.elapsed_s)

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for k, part, i, t, *pose, fine, given in rows:
            found, begins = set(given or ()), last is None
            if not begins:
                p, q = last[1][:3], last[1][3:]
                if math.dist(p, pose[:3]) >= far:
                    found.add("translation")
                if math.degrees(2 * math.acos(min(1.0, abs(math.sumprod(q, pose[3:]))))) >= turned:
                    found.add("rotation")
                if (t - last[0]) / 1e9 >= late:
                    found.add("max_elapsed")
            if not found or (not fine and found <= {"translation", "rotation"}):
                continue
            if not fine:
                found.add("quality_override")
            last = (t, pose)
            if not begins or not part:
                yield k, i, ",".join(r for r in REASONS if r in found)

    values = [index, time, "x", "y", "z", "qx", "qy", "qz", "qw", "acceptable", "reasons"]
    return scanned(held, [key, "_part"], [time, index], values, scan, f"`{key}` {kind(key)}, `{index}` {kind(index)}, reasons string")
