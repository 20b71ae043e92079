"""Quaternions (x, y, z, w) and rotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quaternion = tuple[Column, Column, Column, Column]


def clipped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalized(q: Quaternion) -> Quaternion:
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return tuple(x / n for x in q)  # type: ignore[return-value]


def matrix(q: Quaternion) -> tuple[Column, ...]:
    """Row-major 3x3 rotation of a unit quaternion."""
    x, y, z, w = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Quaternion:
    """Of rotations about x, then y, then z."""
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def to_euler(q: Quaternion) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw in radians."""
    x, y, z, w = q
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(clipped(2 * (w * y - z * x))), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def angle_between(a: Quaternion, b: Quaternion) -> Column:
    """Rotation angle in radians from one unit quaternion to another."""
    return 2 * F.acos(clipped(F.abs(sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0]))))


def slerp(a: Quaternion, b: Quaternion, t: Column) -> Quaternion:
    """The shorter way round; only where the angle is lost in the last digits of a double is it a line."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign, near = F.when(dot < 0, -1.0).otherwise(1.0), F.abs(dot) > 1 - 1e-12
    theta = F.acos(clipped(F.abs(dot)))
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    wb = sign * F.when(near, t).otherwise(F.sin(t * theta) / F.sin(theta))
    return normalized(tuple(wa * x + wb * y for x, y in zip(a, b, strict=True)))  # type: ignore[arg-type]


def relative_angle_from_matrices(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Angle of the rotation between two row-major matrices, from the trace."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.acos(clipped((trace - 1) / 2))


def camera_center(view: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """Centre -R't of a row-major 4x4 world-to-camera matrix."""
    t = [view[3], view[7], view[11]]
    return tuple(-(view[k] * t[0] + view[4 + k] * t[1] + view[8 + k] * t[2]) for k in range(3))  # type: ignore[return-value]


def product4(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Row-major 4x4 product."""
    return tuple(a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j] for i in range(4) for j in range(4))
