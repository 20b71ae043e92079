"""Clock offsets, rates, courses, pose interpolation, pose comparison, blending and path gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.functions import rotation
from tracklake.operators import association, series


def clock_offset(fix: DataFrame, camera: DataFrame, key: str = "segment_id", time: str = "log_ns", index: str = "row_id", header: str = "header_ns") -> DataFrame:
    """offset_ns, early_ns, late_ns, drift_ns: median fix delay, interpolated at camera logs, minus median camera delay.

    A delay is header minus log; early and late are the halves of each segment's camera rows by time.
    """
    f = fix.select(key, index, time, (F.col(header) - F.col(time)).cast("double").alias("delay"))
    at = association.interpolated(camera.select(key, index, time), f, ["delay"], None, key, time, index)
    rows = at.select(key, index, F.col("delay").alias("fix_delay")).join(camera.select(key, index, time, (F.col(header) - F.col(time)).alias("own")), [key, index])
    rows = rows.where("fix_delay is not null").withColumn("_half", F.ntile(2).over(Window.partitionBy(key).orderBy(time, index)))
    m = lambda c, half=None: F.percentile(F.when(F.col("_half") == half, F.col(c)) if half else F.col(c), 0.5)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), (m("fix_delay") - m("own")).alias("offset_ns"), (m("fix_delay", 1) - m("own", 1)).alias("early_ns"), (m("fix_delay", 2) - m("own", 2)).alias("late_ns"))
    return out.withColumn("drift_ns", F.col("late_ns") - F.col("early_ns"))


def rate_and_speed(df: DataFrame, w: WindowSpec, key: str, time: str, *xyz: str, moving: float = 0.01) -> DataFrame:
    """rate_hz: inverse median step of time; speed: median of speeds over ``moving``."""
    r = series.rates(df, w, time, *xyz)
    return r.groupBy(key).agg((1 / F.percentile("dt_s", 0.5)).alias("rate_hz"), F.percentile(F.when(F.col("speed") > moving, F.col("speed")), 0.5).alias("speed"))


def stride_for(spacing_m: Column, rate_hz: Column, speed: Column) -> Column:
    """Frames to step on so that kept frames are about the spacing apart."""
    return F.greatest(F.lit(1).cast("long"), F.floor(spacing_m * rate_hz / speed + 0.5))


def course(df: DataFrame, w: WindowSpec, key: str, time: str, width: int, min_speed: float) -> DataFrame:
    """course (radians, unwrapped), speed, course_valid from smoothed positions x, y and their gradients by seconds."""
    first = F.min(time).over(Window.partitionBy(key))
    out = series.smoothed(df, w, key, width, "x", "y").withColumn("_s", (F.col(time) - first) / 1e9)
    out = out.withColumns({"_vx": series.gradient(w, "x_smooth", "_s"), "_vy": series.gradient(w, "y_smooth", "_s")})
    out = out.withColumn("speed", F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))).withColumn("_a", F.atan2("_vy", "_vx"))
    return series.unwrapped(out, w, "_a", "course").withColumn("course_valid", F.col("speed") >= min_speed).drop("_s", "_vx", "_vy", "_a", "x_smooth", "y_smooth")


def turning(df: DataFrame, w: WindowSpec, time: str, min_rate: float, yaw: str = "yaw") -> DataFrame:
    """``turning``: both ends of steps whose angular rate reaches the bound (radians a second)."""
    d = F.abs(F.atan2(F.sin(F.col(yaw) - F.lag(yaw).over(w)), F.cos(F.col(yaw) - F.lag(yaw).over(w))))
    fast = F.coalesce(d / ((F.col(time) - F.lag(time).over(w)) / 1e9) >= min_rate, F.lit(False))
    return df.withColumn("_fast", fast).withColumn("turning", F.col("_fast") | F.coalesce(F.lead("_fast").over(w), F.lit(False))).drop("_fast")


_QUATERNION = ("qx", "qy", "qz", "qw")


def interpolated_poses(frames: DataFrame, poses: DataFrame, max_gap_ns: int | None = None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """Position (x, y, z) by lines and rotation (qx to qw) by slerp, with alpha and both ends' indexes."""
    values = ["x", "y", "z", *_QUATERNION]
    found = association.bracket(frames, poses, max_gap_ns, key, time, index)
    for side in ("lower", "upper"):
        found = found.join(poses.select(key, F.col(index).alias(f"{side}_index"), *[F.col(v).alias(f"{side}_{v}") for v in values]), [key, f"{side}_index"], "left")
    turned = rotation.slerp(*[tuple(F.col(f"{s}_{q}") for q in _QUATERNION) for s in ("lower", "upper")], F.col("alpha"))  # type: ignore[arg-type]
    line = {c: F.col(f"lower_{c}") + F.col("alpha") * (F.col(f"upper_{c}") - F.col(f"lower_{c}")) for c in "xyz"}
    return found.withColumns({**line, **dict(zip(_QUATERNION, turned, strict=True))}).drop(*[f"{s}_{v}" for s in ("lower", "upper") for v in values])


def supported_values(frames: DataFrame, track: DataFrame, values: list[str], valid: str, reach: int, max_gap_ns: int | None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """Values between samples, null unless all samples within ``reach`` rows of both ends are valid."""
    w = Window.partitionBy(key).orderBy(time, index)
    held = track.withColumn("_ok", F.min(F.col(valid).cast("double")).over(w.rowsBetween(-reach, reach)))
    out = association.interpolated(frames, held, [*values, "_ok"], max_gap_ns, key, time, index)
    return out.withColumns({v: F.when(F.col("_ok") == 1, F.col(v)) for v in values}).drop("_ok")


def compare_poses(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, distance and angle (degrees) of two poses of the same keys."""
    values = ["x", "y", "z", *_QUATERNION]
    j = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values]), list(keys))
    square = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "yz"), (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")))
    angle = rotation.angle_between(*[tuple(F.col(f"{s}_{q}") for q in _QUATERNION) for s in "ab"])  # type: ignore[arg-type]
    return j.select(*keys, F.sqrt(square).alias("distance_m"), F.degrees(angle).alias("angle_deg"))


def overlaps(poses: DataFrame, key: str = "segment_id", window: str = "window_id", frame: str = "frame") -> DataFrame:
    """Poses of one frame in windows that follow each other, with ``same_time``: whether the frame is the same one."""
    values = ["t_ns", "x", "y", "z", *[q for q in _QUATERNION if q in poses.columns]]
    a = poses.select(key, F.col(window).alias("first_window"), frame, *[F.col(v).alias(f"a_{v}") for v in values])
    b = poses.select(key, (F.col(window) - 1).alias("first_window"), frame, *[F.col(v).alias(f"b_{v}") for v in values])
    return a.join(b, [key, "first_window", frame]).withColumn("same_time", F.col("a_t_ns") == F.col("b_t_ns"))


def blended_centers(poses: DataFrame, power: float, key: str = "segment_id", window: str = "window_id", frame: str = "frame") -> DataFrame:
    """Weighted mean centre of each frame over its windows; weights are (distance to the window's end) ** power."""
    part = Window.partitionBy(key, window)
    i = F.row_number().over(part.orderBy(frame))
    w = F.pow(F.least(i, F.count("*").over(part) - i + 1).cast("double"), F.lit(power))
    held = poses.withColumn("_w", w)
    return held.groupBy(key, frame).agg(F.count("*").alias("windows"), *[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in "xyz"])


def united_roles(roles: DataFrame, *keys: str) -> DataFrame:
    """calibration if any window says so, holdout if all do, else excluded."""
    some = lambda name: F.bool_or(F.col("role") == name)
    return roles.groupBy(*keys).agg(F.when(some("calibration"), "calibration").when(F.bool_and(F.col("role") == "holdout"), "holdout").otherwise("excluded").alias("role"))


def baseline_audit(poses: DataFrame, key: str, frame: str, camera: str, left: str, right: str) -> DataFrame:
    """Median distance of two cameras of a frame, and its largest difference from that median."""
    sides = [poses.where(F.col(camera) == c).select(key, frame, *[F.col(v).alias(f"{s}{v}") for v in "xyz"]) for s, c in (("a", left), ("b", right))]
    j = sides[0].join(sides[1], [key, frame])
    d = F.sqrt(sum(((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in "yz"), (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx"))))
    lengths = j.select(key, d.alias("d"))
    median = lengths.groupBy(key).agg(F.percentile("d", 0.5).alias("median_m"), F.count("*").alias("n"))
    return lengths.join(median, key).groupBy(key).agg(F.first("n").alias("n"), F.first("median_m").alias("median_m"), F.max(F.abs(F.col("d") - F.col("median_m"))).alias("max_change_m"))


def step_errors(df: DataFrame, w: WindowSpec, key: str, index: str, prior: tuple[str, str, str], refined: tuple[str, str, str]) -> DataFrame:
    """Largest difference of adjacent steps of two paths, as vectors and in length, and the rows where they are."""
    d = {n: [F.col(c) - F.lag(c).over(w) for c in cols] for n, cols in (("p", prior), ("r", refined))}
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    rows = df.select(key, index, norm([r - p for p, r in zip(d["p"], d["r"], strict=True)]).alias("vector_m"), F.abs(norm(d["r"]) - norm(d["p"])).alias("length_m"))
    worst = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c), (-F.col(index)).alias("i"))))
    out = rows.groupBy(key).agg(worst("vector_m").alias("_v"), worst("length_m").alias("_l"))
    return out.select(key, F.col("_v.vector_m").alias("vector_m"), (-F.col("_v.i")).alias("vector_at"), F.col("_l.length_m").alias("length_m"), (-F.col("_l.i")).alias("length_at"))


def calibration_score(residuals: DataFrame, *keys: str) -> DataFrame:
    """Median, RMS, p95 and largest residual, RMS of each axis (ex, ey, ez)."""
    square = F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")
    r = residuals.withColumn("_r", F.sqrt(square))
    return r.groupBy(*keys).agg(
        F.percentile("_r", 0.5).alias("median_m"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rms_m"), F.percentile("_r", 0.95).alias("p95_m"), F.max("_r").alias("max_m"),
        *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in ("ex", "ey", "ez")],
    )


def motion_correlations(df: DataFrame, w: WindowSpec, key: str, time: str) -> DataFrame:
    """Correlation of residuals along and across the course (ex, ey) with speed and turn rate, and the implied latency.

    ``df`` has course, speed, ex, ey.
    """
    along = F.col("ex") * F.cos("course") + F.col("ey") * F.sin("course")
    across = -F.col("ex") * F.sin("course") + F.col("ey") * F.cos("course")
    rows = df.withColumns({"along": along, "across": across, "_s": F.col(time) / 1e9}).withColumn("turn_rate", series.gradient(w, "course", "_s"))
    pairs = [F.corr(r, m).alias(f"{r}_{m}") for r in ("along", "across") for m in ("speed", "turn_rate")]
    speed2 = F.sum(F.col("speed") * F.col("speed"))
    return rows.groupBy(key).agg(*pairs, F.when(speed2 > 0, F.sum(F.col("along") * F.col("speed")) / speed2).alias("latency_s"))


def axis_sigmas(df: DataFrame, floor_m: float) -> Column:
    """max(floor, posterior, spread) where trusted, else the prior."""
    return F.when(F.col("trusted"), F.greatest(F.lit(floor_m), F.col("posterior"), F.col("spread"))).otherwise(F.col("prior"))


def tilt(df: DataFrame, w: WindowSpec, key: str, width: int) -> DataFrame:
    """Roll and pitch (radians) of quaternions, unwrapped, smoothed, less their medians."""
    roll, pitch, _ = rotation.to_euler(tuple(F.col(q) for q in _QUATERNION))  # type: ignore[arg-type]
    out = df.withColumns({"_roll": roll, "_pitch": pitch})
    for c in ("roll", "pitch"):
        out = series.unwrapped(out, w, f"_{c}", c)
    out = series.smoothed(out, w, key, width, "roll", "pitch")
    middle = out.groupBy(key).agg(*[F.percentile(f"{c}_smooth", 0.5).alias(f"_m{c}") for c in ("roll", "pitch")])
    return out.join(middle, key).withColumns({c: F.col(f"{c}_smooth") - F.col(f"_m{c}") for c in ("roll", "pitch")}).drop("_roll", "_pitch", "roll_smooth", "pitch_smooth", "_mroll", "_mpitch")


def dual_antenna_heading(primary: DataFrame, secondary: DataFrame, baseline_m: float, tolerance_m: float, max_gap_ns: int, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """heading (radians, from primary to secondary, east over north axes x, y), length, accuracy, heading_valid.

    The second antenna is interpolated at the first's times from valid rows on both sides; the length must be right.
    """
    other = association.interpolated(primary, secondary.withColumn("_ok", F.col("valid").cast("double")), ["x", "y", "z", "var", "_ok"], max_gap_ns, key, time, index)
    other = other.select(key, index, *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "z", "var")], "_ok")
    j = primary.join(other, [key, index])
    dx, dy, dz = (F.col(f"o_{c}") - F.col(c) for c in "xyz")
    j = j.withColumn("length_m", F.sqrt(dx * dx + dy * dy + dz * dz))
    good = F.coalesce(F.col("valid") & (F.col("_ok") == 1) & (F.abs(F.col("length_m") - baseline_m) <= tolerance_m), F.lit(False))
    return j.select(key, index, time, "length_m", good.alias("heading_valid"), F.when(good, F.atan2(dy, dx)).alias("heading"), F.when(good, F.sqrt(F.col("var") + F.col("o_var")) / F.col("length_m")).alias("accuracy_rad"))


def opposes(heading: Column, course_angle: Column) -> Column:
    """Whether a heading points backwards along the course."""
    return F.cos(heading - course_angle) < 0


def degrees_between(a: Column, b: Column) -> Column:
    return F.abs(F.atan2(F.sin(a - b), F.cos(a - b))) * (180 / math.pi)
