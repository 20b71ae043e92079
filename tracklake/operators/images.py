"""Pixels and depth support: blur and exposure, cells, audits of projected depth, view overlap. Pixels are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sharpness_and_exposure(pixels: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    """blur: variance of the 4-neighbour Laplacian over inner pixels; exposure: share that isn't clipped.

    Neighbours are added up by place, so pixels (u, v, value) are shuffled once and not joined.
    """
    cells = F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv"), F.lit(w).alias("w")) for du, dv, w in ((0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0))])
    told = pixels.withColumn("_s", F.explode(cells)).select(*keys, (F.col("u") + F.col("_s.du")).alias("u"), (F.col("v") + F.col("_s.dv")).alias("v"), (F.col("value") * F.col("_s.w")).alias("_l"))
    inner = told.groupBy(*keys, "u", "v").agg(F.sum("_l").alias("_l"), F.count("*").alias("_n")).where("_n = 5")
    blur = inner.groupBy(*keys).agg(F.var_pop("_l").alias("blur"))
    clipped = F.avg(((F.col("value") <= low) | (F.col("value") >= high)).cast("double"))
    return pixels.groupBy(*keys).agg((1 - clipped).alias("exposure")).join(blur, list(keys), "left")


def support_cells(points: DataFrame, axis: tuple[float, float], size: float, *keys: str) -> DataFrame:
    """Distinct cells (u, v) of ground positions x, y in the frame whose first axis is given."""
    a, b = axis
    u, v = F.col("x") * a + F.col("y") * b, F.col("y") * a - F.col("x") * b
    return points.select(*keys, *[(F.floor(x / size) * size).alias(n) for n, x in (("u", u), ("v", v))]).distinct()


def support_diagnostics(cells: DataFrame, frames: DataFrame, max_depthless: float, frame: str = "frame") -> DataFrame:
    """One row: cells per frame (least, median, most), share of frames without any, and whether that passes."""
    n = frames.select(frame).distinct().join(cells.groupBy(frame).agg(F.count("*").alias("n")), frame, "left").fillna(0, ["n"])
    out = n.agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.avg((F.col("n") == 0).cast("double")).alias("depthless"))
    return out.withColumn("passed", F.col("depthless") <= max_depthless)


def projection_coverage(source: DataFrame, target: DataFrame, pixels: int, min_coverage: float, min_retention: float, *keys: str) -> DataFrame:
    """Coverage (target pixels of all) and retention (target of source) of each frame with gates."""
    s, t = source.groupBy(*keys).agg(F.count("*").alias("n_source")), target.groupBy(*keys).agg(F.count("*").alias("n_target"))
    out = s.join(t, list(keys), "left").fillna(0, ["n_target"]).withColumn("coverage", F.col("n_target") / pixels).withColumn("retention", F.col("n_target") / F.col("n_source"))
    return out.withColumn("passed", (F.col("coverage") >= min_coverage) & (F.col("retention") >= min_retention))


def depth_scale_audit(rows: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    """n, median and p95 absolute error, median ratio of measured to expected, and whether it lies in [low, high]."""
    error, ratio = F.abs(F.col("measured") - F.col("expected")), F.col("measured") / F.when(F.col("expected") != 0, F.col("expected"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(error, 0.5).alias("median_error"), F.percentile(error, 0.95).alias("p95_error"), F.percentile(ratio, 0.5).alias("ratio"))
    return out.withColumn("passed", F.col("ratio").between(low, high))


def seen_share(points: DataFrame, fx: Column, fy: Column, width: int, height: int, *keys: str) -> DataFrame:
    """Share of camera points (x, y, z; centre in the middle) that fall inside the image."""
    u, v = fx * F.col("x") / F.col("z") + width / 2, fy * F.col("y") / F.col("z") + height / 2
    inside = (F.col("z") > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return points.groupBy(*keys).agg(F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("share"))


def owned_counts(owned: DataFrame, *keys: str) -> DataFrame:
    """Rows of each owner, the outside (-1) among them."""
    return owned.groupBy(*keys, "owner").agg(F.count("*").alias("n"))
