"""WGS84 coordinates and local frames as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of WGS84: semi-major axis and first eccentricity squared.
WGS84_A = 6378137.0
WGS84_E2 = 6.69437999014e-3


def ecef(lat_deg: Column, lon_deg: Column, alt_m: Column) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return (n + alt_m) * F.cos(lat) * F.cos(lon), (n + alt_m) * F.cos(lat) * F.sin(lon), (n * (1 - WGS84_E2) + alt_m) * F.sin(lat)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north, up of a point from an origin."""
    x, y, z = (a - b for a, b in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0), strict=True))
    p, q = F.radians(lat0), F.radians(lon0)
    east = -F.sin(q) * x + F.cos(q) * y
    north = -F.sin(p) * F.cos(q) * x - F.sin(p) * F.sin(q) * y + F.cos(p) * z
    return east, north, F.cos(p) * F.cos(q) * x + F.cos(p) * F.sin(q) * y + F.sin(p) * z


def ned_to_enu(n: Column, e: Column, d: Column) -> tuple[Column, Column, Column]:
    return e, n, -d


def ned_to_enu_covariance(nn: Column, ne: Column, nd: Column, ee: Column, ed: Column, dd: Column) -> tuple[Column, ...]:
    """Components ee, en, eu, nn, nu, uu of a covariance given in north, east, down."""
    return ee, ne, -ed, nn, -nd, dd


def circular_difference(a: Column, b: Column) -> Column:
    """Angle a - b in radians, in (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


@F.pandas_udf(DoubleType())
def atan2_c(y: pd.Series, x: pd.Series) -> pd.Series:
    """atan2 to the last bit as the C library has it, which decides where two directions are exactly half a turn apart; Java's may differ there."""
    return pd.Series([*map(math.atan2, y, x)], dtype=float)
