"""Acceptance of trajectories, plans, sensors and refinements: gates over what other operators measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.functions import geodesy
from tracklake.operators import association, cover, quality, series, trajectory
from tracklake.operators.checks import checks
from tracklake.operators.quality import runs


def calibration_fix(status: Column, covariance_type: Column, variance: Column, status_age_ns: Column, flags_ok: Column, max_age_ns: int) -> Column:
    """A fix that may calibrate: a valid status, known covariance, and a receiver status that is young and good."""
    good = (status >= 0) & (covariance_type > 0) & variance.isNotNull() & ~F.isnan(variance) & (F.abs(status_age_ns) <= max_age_ns) & flags_ok
    return F.coalesce(good, F.lit(False))


@dataclass(frozen=True)
class PathPolicy:
    window_rows: int = 30
    absolute_m: float = 0.25
    relative: float = 0.1
    max_step_m: float = 0.5
    max_outlier_run: int = 5
    min_inlier_share: float = 0.9


def path_gates(df: DataFrame, w: WindowSpec, policy: PathPolicy = PathPolicy(), key: str = "segment_id", time: str = "t_ns", index: str = "frame", steps: tuple[str, str, str] | None = None) -> DataFrame:
    """Checks of a refined path (u, v, w) against its prior (x, y, z), with ``inlier`` marks: five rows a segment.

    Sliding path length, adjacent steps as vectors and in length, the longest run of outliers, and the inlier share.
    Steps are told to a picometre, so one of exactly the bound passes whatever the last bits of its coordinates are.
    ``steps``: columns with the lengths of a row's step in the prior and the refined path and of what lies between them, where these
    are known rather than to be taken from coordinates; they are held against the bounds as they are.
    """
    if steps is None:
        prior, refined = ("x", "y", "z"), ("u", "v", "w")
        worst = trajectory.step_errors(df, w, key, index, prior, refined).select(key, F.round("vector_m", 12).alias("vector_m"), F.round("length_m", 12).alias("length_m"))
    else:
        prior, refined, between = map(F.col, steps)
        worst = df.groupBy(key).agg(F.max(between).alias("vector_m"), F.max(F.abs(refined - prior)).alias("length_m"))
    windows = series.path_windows(df, w, policy.window_rows, prior, refined, policy.absolute_m, policy.relative)
    failed = windows.groupBy(key).agg(F.count_if("failed").alias("windows_failed"))
    outliers = runs(df, "inlier", key, time, index).where("not inlier").groupBy(key).agg(F.max("n").alias("outlier_run"))
    share = df.groupBy(key).agg(F.avg(F.col("inlier").cast("double")).alias("inlier_share"))
    joined = share.join(worst, key).join(failed, key, "left").join(outliers, key, "left").fillna(0, ["windows_failed", "outlier_run"])
    c = F.col
    return checks(joined, [key], {
        "sliding_window": (c("windows_failed"), None, 0),
        "step_vector": (c("vector_m"), None, policy.max_step_m),
        "step_length": (c("length_m"), None, policy.max_step_m),
        "outlier_run": (c("outlier_run"), None, policy.max_outlier_run),
        "inlier_share": (c("inlier_share"), policy.min_inlier_share, None),
    })


def plan_audit(tiles: DataFrame, lo_u: float, lo_v: float, hi_u: float, hi_v: float, tolerance: float = 1e-9) -> DataFrame:
    """One row: overlapping pairs of cores, whether areas add up to the scene's, and cores outside it."""
    overlaps = cover.overlapping_pairs(tiles, "tile_id").agg(F.count("*").alias("overlaps"))
    outside = (F.col("lo_u") < lo_u) | (F.col("lo_v") < lo_v) | (F.col("hi_u") > hi_u) | (F.col("hi_v") > hi_v)
    area = tiles.agg((F.abs(F.sum((F.col("hi_u") - F.col("lo_u")) * (F.col("hi_v") - F.col("lo_v"))) - (hi_u - lo_u) * (hi_v - lo_v)) <= tolerance).alias("area_whole"), F.count_if(outside).alias("outside"))
    return overlaps.crossJoin(area)  # one row each


def recomputed(stored: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose stored row isn't what was computed again, and ``problem``: missing, extra, or the first value that differs."""
    a = stored.select(*keys, F.struct(*values).alias("_a"))
    b = found.select(*keys, F.struct(*values).alias("_b"))
    differs = [(v, ~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}"))) for v in values]
    problem = quality.first_reason(("missing", F.col("_a").isNull()), ("extra", F.col("_b").isNull()), *differs)
    return a.join(b, keys, "full").select(*keys, problem.alias("problem")).where("problem is not null")


@dataclass(frozen=True)
class ProbePolicy:
    max_epipolar_px: float
    min_inlier_share: float
    min_matches: int
    ratio: tuple[float, float] = (0.98, 1.02)


def sensor_acceptance(probes: DataFrame, policy: ProbePolicy, *keys: str) -> DataFrame:
    """Checks of a sensor from its probe rows: epipolar_px, inliers, matches, ratio (measured depth over stereo)."""
    c = F.col
    a = probes.groupBy(*keys).agg(F.percentile("epipolar_px", 0.5).alias("epipolar"), (F.sum("inliers") / F.sum("matches")).alias("share"), F.min("matches").alias("fewest"), F.percentile("ratio", 0.5).alias("scale"))
    return checks(a, list(keys), {"epipolar_px": (c("epipolar"), None, policy.max_epipolar_px), "inlier_share": (c("share"), policy.min_inlier_share, None), "matches": (c("fewest"), policy.min_matches, None), "depth_scale": (c("scale"), *policy.ratio)})


def localised_outlier(failed: DataFrame, expected: list[str], worst: DataFrame, anchors: DataFrame, *keys: str) -> DataFrame:
    """keys, localised: failed check names are exactly the expected ones, and the anchor row lies in the worst range (first, last)."""
    names = failed.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("names"))
    j = names.join(worst.select(*keys, "first", "last"), list(keys)).join(anchors.select(*keys, "row"), list(keys))
    same = F.col("names") == F.array(*[F.lit(n) for n in sorted(expected)])
    return j.select(*keys, (same & F.col("row").between(F.col("first"), F.col("last"))).alias("localised"))


def failure_inventory(failures: DataFrame, allowed: list[str], warn_median: float, *keys: str) -> DataFrame:
    """keys, windows, allowed and structural counts, warning: whether the median number of failures a window is over the bound."""
    kind = F.col("name").isin(*allowed)
    each = failures.groupBy(*keys, "window_id").agg(F.count_if(kind).alias("_a"), F.count_if(~kind).alias("_s"), F.count("*").alias("_n"))
    return each.groupBy(*keys).agg(F.count("*").alias("windows"), F.sum("_a").alias("allowed"), F.sum("_s").alias("structural"), (F.percentile("_n", 0.5) > warn_median).alias("warning"))


def migrated(frames: DataFrame, fixes: DataFrame, states: DataFrame, headings: DataFrame, tolerance_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """Frames of an old layout with their fix, its receiver state, the heading, and their validity and quality.

    ``fixes``: status, finite, and raw columns, which stay as ``raw_``; ``states``: carrier; ``headings``: flags,
    heading_carrier, accuracy. A fix takes the state nearest to itself, not to the frame. ``problem`` names the first
    stream without a row in tolerance (fix, state, heading); validity is false and quality invalid there.
    """
    names = {"key": key, "time": time, "index": index}
    link = lambda left, right: association.nearest(left, right, tolerance_ns, **names).select(key, index, "sample_index", "sample_t_ns", "residual_ns")
    state = link(fixes, states).join(states.select(key, F.col(index).alias("sample_index"), "carrier"), [key, "sample_index"], "left").select(key, index, F.col("sample_index").alias("state_index"), "carrier")
    known = fixes.join(state, [key, index]).select(key, F.col(index).alias("sample_index"), "state_index", "carrier", "status", "finite", *[F.col(x).alias(f"raw_{x}") for x in fixes.columns if x not in (key, index)])
    fix = link(frames, fixes).join(known, [key, "sample_index"], "left").withColumnsRenamed({"sample_index": "source_index", "sample_t_ns": "source_t_ns", "residual_ns": "source_residual_ns"})
    turned = link(frames, headings).join(headings.select(key, F.col(index).alias("sample_index"), "flags", "heading_carrier", "accuracy"), [key, "sample_index"], "left")
    turned = turned.select(key, index, F.col("sample_index").alias("heading_index"), F.radians("accuracy").alias("accuracy_rad"), quality.heading_valid(F.col("flags"), F.col("heading_carrier"), F.lit(True), F.col("accuracy")).alias("heading_valid"))
    problem = F.when(F.col("source_index").isNull(), "fix").when(F.col("state_index").isNull(), "state").when(F.col("heading_index").isNull(), "heading")
    carrier, missing = F.coalesce("carrier", F.lit(-1)), F.col("source_index").isNull()
    out = frames.join(fix, [key, index]).join(turned, [key, index]).withColumn("problem", problem)
    valid, grade = quality.position_valid(F.col("status"), F.col("finite")), quality.position_quality(F.col("status"), carrier, F.col("finite"))
    return out.withColumns({"position_valid": ~missing & valid, "position_quality": F.when(missing, "invalid").otherwise(grade)}).drop("carrier", "status", "finite")


def calibration_fixes(fixes: DataFrame, states: DataFrame, origin: tuple[float, float, float], max_age_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """key, index, time, east, north, up, age_ns, good: the first fix of each time, in metres from the origin.

    ``fixes``: lat, lon, alt, status, covariance_type, variance; ``states``: ok. A fix is good by ``calibration_fix``
    with the state nearest in time within ``max_age_ns``; without one it isn't.
    """
    first = series.first_per_time(fixes, key, time, index)
    near = association.nearest(first, states, max_age_ns, key, time, index).join(states.select(key, F.col(index).alias("sample_index"), "ok"), [key, "sample_index"], "left")
    good = calibration_fix(F.col("status"), F.col("covariance_type"), F.col("variance"), F.col("residual_ns"), F.col("ok"), max_age_ns)
    place = geodesy.enu(F.col("lat"), F.col("lon"), F.col("alt"), *[F.lit(float(v)) for v in origin])
    found = first.join(near.select(key, index, "residual_ns", "ok"), [key, index])
    return found.select(key, index, time, *[v.alias(n) for n, v in zip(("east", "north", "up"), place, strict=True)], F.abs("residual_ns").alias("age_ns"), good.alias("good"))


def calibration_frames(frames: DataFrame, roles: DataFrame, start_ns: Column, stop_ns: Column, time: str = "t_ns", name: str = "name") -> DataFrame:
    """Frames in [start, stop] whose name has the role calibration and no other, with ``problem`` for names listed twice.

    ``roles``: name, role. Names of several roles are leaks and come with the problem ``roles``, names of several
    frames with ``frames``; nothing is left out silently.
    """
    held = roles.groupBy(name).agg(F.bool_or(F.col("role") == "calibration").alias("_in"), (F.count_distinct("role") > 1).alias("_mixed")).where("_in")
    found = frames.where(F.col(time).between(start_ns, stop_ns)).join(held, name)
    same = F.count("*").over(Window.partitionBy(name)) > 1
    return found.withColumn("problem", F.when(F.col("_mixed"), "roles").when(same, "frames")).drop("_in", "_mixed")
