"""Symmetric 3x3 matrices given by xx, xy, xz, yy, yz, zz."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Symmetric = tuple[Column, Column, Column, Column, Column, Column]


def eigenvalues(m: Symmetric) -> tuple[Column, Column, Column]:
    """Ascending, by the trigonometric closed form."""
    xx, xy, xz, yy, yz, zz = m
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(F.lit(1.0))
    phi = F.acos(r) / 3
    top, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return low, 3 * q - top - low, top


def largest_std(m: Symmetric) -> Column:
    return F.sqrt(F.greatest(eigenvalues(m)[2], F.lit(0.0)))


def _minors(m: Symmetric) -> tuple[Column, Column, Column]:
    xx, xy, xz, yy, yz, zz = m
    return xx, xx * yy - xy * xy, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def positive_definite(m: Symmetric) -> Column:
    a, b, c = _minors(m)
    return (a > 0) & (b > 0) & (c > 0)


def mahalanobis2(v: tuple[Column, Column, Column], m: Symmetric) -> Column:
    """v' m^-1 v, null unless m is positive definite."""
    xx, xy, xz, yy, yz, zz = m
    x, y, z = v
    det = _minors(m)[2]
    value = (yy * zz - yz * yz) * x * x + (xx * zz - xz * xz) * y * y + (xx * yy - xy * xy) * z * z
    value = value + 2 * ((xz * yz - xy * zz) * x * y + (xy * yz - xz * yy) * x * z + (xy * xz - xx * yz) * y * z)
    return F.when(positive_definite(m), value / det)


def dominant_axis(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """Unit vector of the larger second moment in the plane; its x (or, at 0, its y) is not negative."""
    angle = F.atan2(2 * xy, xx - yy) / 2
    x, y = F.cos(angle), F.sin(angle)
    flip = F.when((x < 0) | ((x == 0) & (y < 0)), -1.0).otherwise(1.0)
    return x * flip, y * flip
