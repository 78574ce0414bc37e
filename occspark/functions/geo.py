"""Coordinates: projection, distance, tiles (O-4.29, O-7.6, O-10.1, O-10.6)."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, col

#: Radius of the projection's sphere, and half of the world's width in it, in metres.
RADIUS = 6378137.0
HALF = pi * RADIUS
#: Mean radius for distances.
MEAN_RADIUS = 6371008.8
#: Metres that count as a degree in the radius filter's box.
METRES_PER_DEGREE = 111320.0
EXTENT = 4096


def mercator_x(lon: ColumnLike) -> Column:
    """O-4.29: easting of EPSG:3857."""
    return F.radians(col(lon).cast("double")) * RADIUS


def mercator_y(lat: ColumnLike) -> Column:
    """O-4.29: northing of EPSG:3857."""
    return F.log(F.tan(F.lit(pi / 4) + F.radians(col(lat).cast("double")) / 2)) * RADIUS


def haversine_m(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Metres on the sphere."""
    a, b, x, y = (F.radians(col(c).cast("double")) for c in (lat1, lat2, lon1, lon2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((y - x) / 2), 2)
    return F.lit(2 * MEAN_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def ellipsoid_m(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Metres on the WGS-84 ellipsoid by Lambert's formula, in the JVM: within some metres anywhere, within two centimetres up to the radius filter's 10 km."""
    flat = 1 / 298.257223563
    a, b = (F.atan((1 - flat) * F.tan(F.radians(col(c).cast("double")))) for c in (lat1, lat2))
    half = (F.radians(col(lon2).cast("double")) - F.radians(col(lon1).cast("double"))) / 2
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half), 2)
    arc = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (a + b) / 2, (b - a) / 2
    x = (arc - F.sin(arc)) * F.pow(F.sin(p) * F.cos(q), 2) / F.greatest(1 - h, F.lit(1e-300))
    y = (arc + F.sin(arc)) * F.pow(F.cos(p) * F.sin(q), 2) / F.greatest(h, F.lit(1e-300))
    return F.lit(RADIUS) * (arc - flat / 2 * (x + y))


def vincenty_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid; the iteration is capped, which only near antipodes costs accuracy."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(np.asarray(lon2) - np.asarray(lon1))
    lam = span
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(50):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s > 0, sin_s, 1), 0.0)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 > 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 > 0, cos2, 1), 0.0)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = span + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            if np.nanmax(np.abs(new - lam), initial=0) < 1e-12:
                break
            lam = new
    k = cos2 * (a**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    return b * big * (s - small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3))))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """H-2: metres on the ellipsoid by iteration, as a vectorised helper, for distances of any length."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty_m(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float), d.to_numpy(float)))

    return run(*[x.cast("double") for x in (lat1, lon1, lat2, lon2)])


def tile_size(zoom: ColumnLike) -> Column:
    """Side of a tile in metres."""
    return F.lit(2 * HALF) / F.pow(F.lit(2.0), col(zoom))


def tile_xy(x: ColumnLike, y: ColumnLike, zoom: ColumnLike) -> tuple[Column, Column]:
    """O-10.1: column and row of the tile that a point is in. A point on an edge is in the eastern or southern tile alone."""
    return F.floor((col(x) + HALF) / tile_size(zoom)).cast("long"), F.floor((F.lit(HALF) - col(y)) / tile_size(zoom)).cast("long")


def tile_pixel(x: ColumnLike, y: ColumnLike, zoom: ColumnLike) -> tuple[Column, Column]:
    """O-10.6: place in the grid of 4096 of its tile, y down."""
    tx, ty = tile_xy(x, y, zoom)
    side = tile_size(zoom)
    return F.round((col(x) + HALF - tx * side) / side * EXTENT).cast("int"), F.round((F.lit(HALF) - col(y) - ty * side) / side * EXTENT).cast("int")
