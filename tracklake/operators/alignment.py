"""Rigid alignment from moments: Spark sums, a worker solves one 3x3 problem per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import rotation, symmetric

_AXES = "xyz"


def moments(pairs: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """Weighted sums of source (x, y, z) and target (u, v, w): one row a group, whatever its size.

    Give coordinates relative to an origin near the group, or the sums lose digits.
    """
    renamed = pairs.withColumnRenamed("w", "w_target")
    w = weight if weight is not None else F.lit(1.0)
    target = {"u": F.col("u"), "v": F.col("v"), "w_target": F.col("w_target")}
    sums = [F.sum(w).alias("s_w"), F.count("*").alias("n")] + [F.sum(w * F.col(a)).alias(f"s_{a}") for a in (*_AXES, *target)]
    sums += [F.sum(w * F.col(a) * c).alias(f"s_{a}{b[0]}") for a in _AXES for b, c in target.items()]
    sums += [F.sum(w * F.col(a) * F.col(a)).alias(f"s_{a}{a}") for a in _AXES]
    return renamed.groupBy(*keys).agg(*sums)


def orientation_moments(a: rotation.Quaternion, b: rotation.Quaternion) -> list[Column]:
    """Sums o0 to o8 of the rotations that turn b's world into a's (row-major), of poses whose cameras are the same."""
    m, n = rotation.matrix(a), rotation.matrix(b)
    return [F.sum(sum((m[3 * i + k] * n[3 * j + k] for k in (1, 2)), m[3 * i] * n[3 * j])).alias(f"o{3 * i + j}") for i in range(3) for j in range(3)]


def _nearest_rotation(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation that fits a sum of outer products best, and the signed sizes."""
    left, size, right = np.linalg.svd(m)
    sign = np.array([1, 1, np.sign(np.linalg.det(left @ right)) or 1.0])
    return left @ np.diag(sign) @ right, size * sign


def rigid_fit(sums: DataFrame, *keys: str, min_rank_ratio: float = 1e-9) -> DataFrame:
    """rotation (9, row-major), translation (3), scale (a diagnostic, never applied), rank, n, observed_by from moments().

    ``observed_by``: ``centers`` where the points span a plane; else ``orientations``, if the sums have those of
    orientation_moments() and the points are not all in one place: the rotation about the line is theirs then. Null
    where neither tells the rotation, or the target runs backwards. ``min_rank_ratio``: a plane's second singular
    value by the first, so the square of a line's width by its length.
    """
    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    turned = "o0" in sums.columns

    def solve(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                w = r.s_w
                p, q = np.array([r.s_x, r.s_y, r.s_z]) / w, np.array([r.s_u, r.s_v, r.s_w_target]) / w
                cross = (np.array([[getattr(r, f"s_{a}{t}") for t in "uvw"] for a in "xyz"]) / w - np.outer(p, q)).T
                spread = sum(getattr(r, f"s_{a}{a}") for a in "xyz") / w - p @ p
                rotation, size = _nearest_rotation(cross)
                rank = int((np.abs(size) > min_rank_ratio * max(size[0], 1e-300)).sum())
                by = "centers" if rank >= 2 else None
                if by is None and turned and spread > 1e-12:
                    rotation, by = _nearest_rotation(np.array([getattr(r, f"o{k}") for k in range(9)]).reshape(3, 3))[0], "orientations"
                scale = float((rotation * cross).sum() / spread) if spread > 0 else None
                if turned and not (scale or 0) > 0:
                    by = None
                out.append((*(getattr(r, k) for k in keys), rotation.ravel().tolist(), (q - rotation @ p).tolist(), scale, rank, r.n, by))
            yield pd.DataFrame(out, columns=[*keys, "rotation", "translation", "scale", "rank", "n", "observed_by"])

    return sums.mapInPandas(solve, f"{kinds + ', ' if kinds else ''}rotation array<double>, translation array<double>, scale double, rank int, n long, observed_by string")


def aligned(pairs: DataFrame, fit: DataFrame, *keys: str) -> DataFrame:
    """Pairs with residual (ex, ey, ez) and residual_m of target minus transformed source. ``fit``: one row a group."""
    r = [F.element_at("rotation", k + 1) for k in range(9)]
    t = [F.element_at("translation", k + 1) for k in range(3)]
    joined = pairs.join(fit.select(*keys, "rotation", "translation"), list(keys)) if keys else pairs.crossJoin(F.broadcast(fit.select("rotation", "translation")))
    error = {f"e{a}": F.col(c) - (r[3 * k] * F.col("x") + r[3 * k + 1] * F.col("y") + r[3 * k + 2] * F.col("z") + t[k]) for k, (a, c) in enumerate(zip("xyz", "uvw", strict=True))}
    out = joined.withColumns(error).drop("rotation", "translation")
    return out.withColumn("residual_m", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))


def residual_quality(residuals: DataFrame, threshold_m: Column, covariance: symmetric.Symmetric, *keys: str) -> DataFrame:
    """Median, p95, inlier share, median squared Mahalanobis distance and share within the 0.95 quantile of chi-square(3).

    7.8147 is that quantile.
    """
    m2 = symmetric.mahalanobis2((F.col("ex"), F.col("ey"), F.col("ez")), covariance)
    rows = residuals.withColumn("_m2", m2).withColumn("_in", F.col("residual_m") <= threshold_m)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile("residual_m", 0.5).alias("median_m"), F.percentile("residual_m", 0.95).alias("p95_m"),
        F.avg(F.col("_in").cast("double")).alias("inlier_share"), F.percentile(F.when(F.col("_in"), F.col("residual_m")), 0.95).alias("inlier_p95_m"),
        F.percentile("_m2", 0.5).alias("median_mahalanobis2"), F.avg((F.col("_m2") <= 7.8147).cast("double")).alias("chi2_share"),
    )
