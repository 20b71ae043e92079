"""Feature matches: pair evidence, rays and parallax, best pairs, priors, registration of other frames to keyframes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import symmetric
from tracklake.functions.keys import pair_members


def trusted_std(valid: Column, quality: Column, covariance: symmetric.Symmetric) -> Column:
    """Largest standard deviation of a valid position of known quality with a positive definite covariance, else null."""
    return F.when(valid & quality.isNotNull() & (quality != "invalid") & symmetric.positive_definite(covariance), symmetric.largest_std(covariance))


def static_override(df: DataFrame, variance: str, declared: float, effective: float, tolerance: float, key: str) -> DataFrame:
    """``variance_effective``: another value where every row of a stream has the declared placeholder."""
    static = df.groupBy(key).agg(F.bool_and(F.abs(F.col(variance) - declared) <= tolerance).alias("overridden"))
    return df.join(static, key).withColumn("variance_effective", F.when(F.col("overridden"), F.lit(effective)).otherwise(F.col(variance)))


def clamped_window(start: Column, stop: Column, pad: int, first: Column, last: Column) -> tuple[Column, Column]:
    return F.greatest(start - pad, first), F.least(stop + pad, last)


def resolved_covariance(stored: Column, derived: Column, tolerance: float) -> Column:
    """accept if equal within the tolerance, replace if there is a derivation, else fail."""
    return F.when(F.abs(stored - derived) <= tolerance, "accept").when(derived.isNotNull(), "replace").otherwise("fail")


def floored_covariance(df: DataFrame, floor: float, columns: tuple[str, ...] = ("xx", "xy", "xz", "yy", "yz", "zz")) -> DataFrame:
    """Symmetric matrices with eigenvalues raised to the floor; nulls stay null. Batched in Arrow."""
    at = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    out = df.schema

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            v = b[list(columns)].to_numpy(float)
            good = np.isfinite(v).all(axis=1)
            m = np.zeros((good.sum(), 3, 3))
            for k, (i, j) in enumerate(at):
                m[:, i, j] = m[:, j, i] = v[good, k]
            values, vectors = np.linalg.eigh(m)
            m = (vectors * np.maximum(values, floor)[:, None, :]) @ vectors.transpose(0, 2, 1)
            b = b.astype(dict.fromkeys(columns, float))
            for k, (i, j) in enumerate(at):
                b.loc[good, columns[k]] = m[:, i, j]
            yield pd.DataFrame(b)

    return df.mapInPandas(run, out)


def registration_edges(frames: DataFrame, keyframes: DataFrame, k: int, max_dt: int, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, frame, keyframe, rank: each other frame's k nearest keyframes in time (then lowest index) within max_dt."""
    cell = lambda t: F.floor(t / F.lit(max_dt)).cast("long")
    others = frames.join(keyframes.select(key, index), [key, index], "left_anti").select(key, F.col(index).alias("frame"), F.col(time).alias("_t")).withColumn("_c", cell(F.col("_t")))
    near = keyframes.select(key, F.col(index).alias("keyframe"), F.col(time).alias("_k")).withColumn("_c", F.explode(F.array(cell(F.col("_k")) - 1, cell(F.col("_k")), cell(F.col("_k")) + 1)))
    dt = F.abs(F.col("_t") - F.col("_k"))
    met = others.join(near, [key, "_c"]).where(dt <= max_dt)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(key, "frame").orderBy(dt, "keyframe"))).where(F.col("rank") <= k).select(key, "frame", "keyframe", "rank")


def pair_evidence(matches: DataFrame, geometries: DataFrame, images: DataFrame) -> DataFrame:
    """pair_id, image_a, image_b, frame_a, frame_b, raw and verified matches (0 where a table lacks the pair)."""
    low, high = pair_members(F.col("pair_id"))
    both = matches.select("pair_id", F.col("n").alias("raw")).join(geometries.select("pair_id", F.col("n").alias("verified")), "pair_id", "full").fillna(0, ["raw", "verified"])
    both = both.withColumn("image_a", low).withColumn("image_b", high)
    for side in "ab":
        both = both.join(images.select(F.col("image_id").alias(f"image_{side}"), F.col("frame").alias(f"frame_{side}")), f"image_{side}", "left")
    return both.select("pair_id", "image_a", "image_b", "frame_a", "frame_b", "raw", "verified")


def rays(correspondences: DataFrame, keypoints: DataFrame, cameras: DataFrame) -> DataFrame:
    """pair_id, idx1, idx2 with unit rays (ax, ay, az) and (bx, by, bz) of both keypoints.

    Keypoints are joined by (image_id, idx), the large joins here; ``cameras`` has a row an image: fx, fy, cx, cy.
    """
    k = keypoints.join(cameras, "image_id")
    x, y = (F.col("x") - F.col("cx")) / F.col("fx"), (F.col("y") - F.col("cy")) / F.col("fy")
    n = F.sqrt(x * x + y * y + 1)
    k = k.select("image_id", "idx", (x / n).alias("rx"), (y / n).alias("ry"), (1 / n).alias("rz"))
    out = correspondences
    for side, image, idx in (("a", "image_a", "idx1"), ("b", "image_b", "idx2")):
        out = out.join(k.select(F.col("image_id").alias(image), F.col("idx").alias(idx), *[F.col(f"r{c}").alias(f"{side}{c}") for c in "xyz"]), [image, idx])
    return out


def parallax(ray_pairs: DataFrame) -> DataFrame:
    """pair_id, n, least, median and largest angle (degrees) between rays."""
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    return ray_pairs.withColumn("_a", angle).groupBy("pair_id").agg(F.count("*").alias("n"), F.min("_a").alias("least"), F.percentile("_a", 0.5).alias("median"), F.max("_a").alias("largest"))


def best_pair(pairs: DataFrame, eligible: Column, score: list[str], *keys: str) -> DataFrame:
    """The eligible pair with the lexicographically largest score of each key; the lowest pair_id on ties."""
    top = F.max_by(F.struct("pair_id", *score), F.struct(*score, -F.col("pair_id")))
    return pairs.where(eligible).groupBy(*keys).agg(top.alias("_p")).select(*keys, "_p.*")


def feature_inventory(images: DataFrame, features: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: images, images without features, features, pairs, and whether the output is partial."""
    held = images.select("image_id").join(features.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left")
    out = held.agg(F.count("*").alias("images"), F.count_if(F.col("n").isNull()).alias("without"), F.coalesce(F.sum("n"), F.lit(0)).alias("features"))
    return out.crossJoin(pairs.agg(F.count("*").alias("pairs"))).withColumn("partial", (F.col("without") > 0) | (F.col("pairs") == 0))


def calibration_targets(rows: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Mean source (x, y, z) over windows of each name, its target (u, v, w), and whether the targets agree."""
    same = F.lit(True)
    for c in "uvw":
        same = same & (F.max(c) - F.min(c) <= tolerance)
    return rows.groupBy(*keys).agg(F.count("*").alias("windows"), *[F.avg(c).alias(c) for c in "xyz"], *[F.min(c).alias(c) for c in "uvw"], same.alias("agree"))
