"""Row-wise position quality, decoding, validity and frame issues; residual summaries and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Receiver modes by the names that receivers give them.
RECEIVER_MODES = {
    "INVALID": "INVALID", "SPP": "SPP", "SINGLE_POINT_POSITION": "SPP", "DGNSS": "DGNSS", "DIFFERENTIAL_GNSS": "DGNSS",
    "FLOAT_RTK": "FLOAT_RTK", "RTK_FLOAT": "FLOAT_RTK", "FIXED_RTK": "FIXED_RTK", "RTK_FIXED": "FIXED_RTK",
    "DEAD_RECKONING": "DEAD_RECKONING", "SBAS": "SBAS", "UNKNOWN": "UNKNOWN",
}
#: Quality, carrier solution of a receiver mode.
MODE_QUALITY = {"SPP": ("standalone", 0), "DGNSS": ("differential", 0), "SBAS": ("differential", 0), "FLOAT_RTK": ("rtk_float", 1), "FIXED_RTK": ("rtk_fixed", 2)}


def position_valid(status: Column, finite: Column) -> Column:
    return F.coalesce(finite & (status >= 0), F.lit(False))


def position_quality(status: Column, carrier: Column, finite: Column) -> Column:
    """The best that status and carrier solution support; invalid without a fix."""
    return F.when(~position_valid(status, finite), "invalid").when(carrier >= 2, "rtk_fixed").when(carrier == 1, "rtk_float").when(status >= 1, "differential").otherwise("standalone")


def offline_quality(status: Column, finite: Column) -> Column:
    """Of positions computed afterwards: never better than unknown_valid."""
    return F.when(position_valid(status, finite), "unknown_valid").otherwise("invalid")


def receiver_mode(name: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    known = F.create_map(*[F.lit(x) for pair in RECEIVER_MODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text), F.concat(F.lit("UNRECOGNIZED:"), text))


def receiver_state(mode: Column, error_words: Column, status: Column, finite: Column, matched: Column) -> dict[str, Column]:
    """carrier, valid, quality: a matched mode overrides the fix status, and any error word makes the row invalid."""
    carrier = F.when(error_words > 0, -1)
    quality = F.lit("invalid")
    for name, (label, value) in MODE_QUALITY.items():
        carrier = carrier.when(mode == name, value)
        quality = F.when(mode == name, label).otherwise(quality)
    carrier = F.coalesce(carrier, F.lit(-1))
    state = matched & (error_words <= 0) & position_valid(status, finite)
    valid = F.when(matched, state & mode.isin(*MODE_QUALITY)).otherwise(position_valid(status, finite))
    return {"carrier": carrier, "valid": valid, "quality": F.when(matched, F.when(state, quality).otherwise("invalid")).otherwise(position_quality(status, carrier, finite))}


def heading_valid(flags: Column, carrier: Column, finite: Column, accuracy: Column) -> Column:
    """``flags``: eight booleans; of the first seven all but the fifth and sixth must be set, those two clear."""
    at = lambda i: F.element_at(flags, i)
    good = at(1) & at(2) & at(3) & at(4) & ~at(5) & ~at(6) & at(7)
    return F.coalesce(good & (carrier >= 2) & finite & (accuracy >= 0) & ~F.isnan(accuracy), F.lit(False))


def fixed_point_m(cm: Column, tenth_mm: Column) -> Column:
    return cm * 0.01 + tenth_mm * 1e-4


@dataclass(frozen=True)
class FramePolicy:
    min_blur: float | None = None
    min_exposure: float | None = None
    max_sync_s: float | None = None
    max_variance: float | None = None
    statuses: tuple[int, ...] | None = None


def frame_issues(policy: FramePolicy, blur: Column, exposure: Column, sync_s: Column, variance: Column, status: Column) -> Column:
    """Names of what is wrong with a frame, in fixed order; an unknown (null) measure that is asked for is wrong."""
    checks = [
        ("blur", policy.min_blur, lambda: blur >= policy.min_blur),
        ("exposure", policy.min_exposure, lambda: exposure >= policy.min_exposure),
        ("stereo_sync", policy.max_sync_s, lambda: F.abs(sync_s) <= policy.max_sync_s),
        ("rtk_covariance", policy.max_variance, lambda: variance <= policy.max_variance),
        ("rtk_status", policy.statuses, lambda: status.isin(*policy.statuses)),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(good(), F.lit(False)), name) for name, bound, good in checks if bound is not None], F.lit(None).cast("string")))


#: Weight of a position by quality.
QUALITY_WEIGHT = {"rtk_fixed": 1.0, "rtk_float": 0.5, "differential": 0.2, "standalone": 0.1, "unknown_valid": 0.1, "invalid": 0.05}


def weighted_variance(variance: Column, quality: Column, weights: dict[str, float] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (weights or QUALITY_WEIGHT).items() for x in pair])
    return variance / F.try_element_at(known, quality)


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """Name of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, median, p95 (linear), max, mean of a column."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def residual_summary(df: DataFrame, residual: str, *keys: str) -> DataFrame:
    """n, median and largest absolute residual, mean residual."""
    v = F.col(residual)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(F.abs(v), 0.5).alias("median_abs"), F.max(F.abs(v)).alias("max_abs"), F.avg(v).alias("mean"))


def runs(df: DataFrame, flag: str, key: str, time: str, index: str) -> DataFrame:
    """Maximal runs of equal values of a flag: key, flag, first and last index, n."""
    order = Window.partitionBy(key).orderBy(time, index)
    changed = F.coalesce(F.col(flag) != F.lag(flag).over(order), F.lit(True))
    numbered = df.withColumn("_run", F.sum(changed.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(time, index)
    return numbered.groupBy(key, "_run").agg(F.first(flag).alias(flag), F.min(at)[index].alias("first_index"), F.max(at)[index].alias("last_index"), F.count("*").alias("n")).drop("_run")


def dropout_budget(matched: DataFrame, max_share: float, max_run: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """n, invalid, share, longest invalid run, largest residual of the valid, passed: of rows with association_valid and residual_ns."""
    longest = runs(matched, "association_valid", key, time, index).where("not association_valid").groupBy(key).agg(F.max("n").alias("longest_run"))
    own = matched.groupBy(key).agg(F.count("*").alias("n"), F.sum((~F.col("association_valid")).cast("long")).alias("n_invalid"), F.max(F.when(F.col("association_valid"), F.abs("residual_ns"))).alias("max_valid_residual_ns"))
    out = own.join(longest, key, "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)).cast("long")).withColumn("share", F.col("n_invalid") / F.col("n"))
    return out.withColumn("passed", (F.col("share") <= max_share) & (F.col("longest_run") <= max_run))
