"""Position jumps: boundaries where a step disagrees with the motion around it, excursions, and their audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JumpPolicy:
    support: int = 5
    floor_m: float = 0.075
    sigmas: float = 3.0
    acceleration: float = 2.0
    max_interval_s: float = 0.5
    min_carrier: int = 2
    max_excursion_s: float = 60.0
    opposition: float = 0.9
    closure_fraction: float = 0.55
    closure_m: float = 0.03
    max_rejected_share: float = 0.05
    max_unpaired: int = 0


def boundaries(df: DataFrame, policy: JumpPolicy = JumpPolicy(), key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """Rows that end a jump: residual (rx, ry, rz), residual_m, threshold_m.

    ``df`` has x, y, z, var (largest position variance), carrier, valid. The expected step is the mean of the median
    velocities of ``support`` steps before and after; all rows that these touch must be valid and close in time.
    """
    k = policy.support
    w = Window.partitionBy(key).orderBy(time, index)
    out = df.withColumn("_dt", (F.col(time) - F.lag(time).over(w)) / 1e9)
    for c in "xyz":
        out = out.withColumn(f"_d{c}", F.col(c) - F.lag(c).over(w)).withColumn(f"_v{c}", F.when(F.col("_dt") > 0, F.col(f"_d{c}") / F.col("_dt")))
    before, after = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    around = w.rowsBetween(-k - 1, k)
    for c in "xyz":
        mean = (F.percentile(f"_v{c}", 0.5).over(before) + F.percentile(f"_v{c}", 0.5).over(after)) / 2
        out = out.withColumn(f"r{c}", F.col(f"_d{c}") - mean * F.col("_dt"))
    out = out.withColumn("_n", F.count("*").over(around)).withColumn("_bad", F.sum((~F.col("valid")).cast("int")).over(around)).withColumn("_slow", F.max("_dt").over(w.rowsBetween(-k, k)))
    out = out.withColumn("_carrier", F.greatest("carrier", F.lag("carrier").over(w))).withColumn("_std", F.sqrt(F.col("var") + F.lag("var").over(w)))
    out = out.withColumn("residual_m", F.sqrt(sum((F.col(f"r{c}") * F.col(f"r{c}") for c in "yz"), F.col("rx") * F.col("rx"))))
    out = out.withColumn("threshold_m", F.greatest(F.lit(policy.floor_m), policy.sigmas * F.col("_std"), policy.acceleration * F.col("_dt") * F.col("_dt") / 2))
    good = (F.col("_n") == 2 * k + 2) & (F.col("_bad") == 0) & (F.col("_slow") <= policy.max_interval_s) & (F.col("_carrier") >= policy.min_carrier)
    return out.where(good & (F.col("residual_m") > F.col("threshold_m"))).select(key, index, time, "rx", "ry", "rz", "residual_m", "threshold_m")


def excursions(found: DataFrame, df: DataFrame, policy: JumpPolicy = JumpPolicy(), key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, start, stop (exclusive) of boundary pairs that oppose and close each other in time, paired from the left.

    Whether a boundary may pair with the next one doesn't depend on other pairs, so in each run of boundaries that
    may, those at odd places do.
    """
    w = Window.partitionBy(key).orderBy(time, index)
    bad = df.withColumn("_bad", F.sum((~F.col("valid")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, index, "_bad", F.col("valid"))
    b = found.join(bad, [key, index])
    nxt = lambda c: F.lead(c).over(w)
    b = b.withColumns({f"_{c}": nxt(c) for c in (index, time, "rx", "ry", "rz", "residual_m")}).withColumn("_more", nxt("_bad") - F.col("_bad"))
    dot = sum((F.col(c) * F.col(f"_{c}") for c in ("ry", "rz")), F.col("rx") * F.col("_rx"))
    closure = F.sqrt(sum(((F.col(c) + F.col(f"_{c}")) * (F.col(c) + F.col(f"_{c}")) for c in ("ry", "rz")), (F.col("rx") + F.col("_rx")) * (F.col("rx") + F.col("_rx"))))
    limit = F.greatest(F.lit(policy.closure_m), policy.closure_fraction * F.greatest("residual_m", "_residual_m"))
    may = (
        (F.col(f"_{index}") > F.col(index))
        & ((F.col(f"_{time}") - F.col(time)) / 1e9 <= policy.max_excursion_s)
        & (dot <= -policy.opposition * F.col("residual_m") * F.col("_residual_m"))
        & (closure <= limit)
        & (F.col("_more") == 0)
        & F.col("valid")
    )
    b = b.withColumn("_may", F.coalesce(may, F.lit(False))).withColumn("_no", F.sum((~F.col("_may")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a run of "may" has one value of _no; a boundary that may not ends it
    b = b.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_no", "_may").orderBy(time, index)))
    return b.where("_may and _place % 2 = 1").select(key, F.col(index).alias("start"), F.col(f"_{index}").alias("stop"))


def audit(df: DataFrame, policy: JumpPolicy = JumpPolicy(), key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """n, boundaries, excursions, rejected, unpaired, passed of each segment."""
    found = boundaries(df, policy, key, index, time)
    pairs = excursions(found, df, policy, key, index, time)
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    b = found.groupBy(key).agg(F.count("*").alias("boundaries"))
    p = pairs.groupBy(key).agg(F.count("*").alias("excursions"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("rejected"))
    out = sizes.join(b, key, "left").join(p, key, "left").fillna(0, ["boundaries", "excursions", "rejected"])
    out = out.withColumn("unpaired", F.col("boundaries") - 2 * F.col("excursions"))
    return out.withColumn("passed", (F.col("rejected") <= policy.max_rejected_share * F.col("n")) & (F.col("unpaired") <= policy.max_unpaired))
