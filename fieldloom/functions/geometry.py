"""Projection, tiles, distances and polygon tests as column expressions.

Angles are degrees, lengths metres. A ring is an array of struct<x,z>, closed or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6378137.0
MEAN_EARTH_KM = 6371.0088
MERCATOR_LIMIT = 85.05112878


def project_x(lon: Column, lon0: float, lat0: float) -> Column:
    """East of the origin on the local grid."""
    return (lon - lon0) * (math.pi / 180 * EARTH_M * math.cos(math.radians(lat0)))


def project_z(lat: Column, lat0: float) -> Column:
    """South of the origin: z grows to the south."""
    return -(lat - lat0) * (math.pi / 180 * EARTH_M)


def unproject_lon(x: Column, lon0: float, lat0: float) -> Column:
    return x / (math.pi / 180 * EARTH_M * math.cos(math.radians(lat0))) + lon0


def unproject_lat(z: Column, lat0: float) -> Column:
    return -z / (math.pi / 180 * EARTH_M) + lat0


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * MEAN_EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    phi = F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat)))
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(y))).cast("int")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Interleaved digits, the coarsest first."""
    digits = [(F.shiftright(x, b).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, b).bitwiseAND(F.lit(1))).cast("string") for b in reversed(range(zoom))]
    return F.concat(*digits)


def gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Distance of two intervals; 0 if they meet."""
    return F.greatest(F.lit(0.0), low_a - high_b, low_b - high_a)


def bounds_distance(a: str, b: str) -> Column:
    """Distance of two bounds structs (min_x, min_z, max_x, max_z)."""
    c = lambda t, f: F.col(f"{t}.{f}")
    return F.hypot(gap(c(a, "min_x"), c(a, "max_x"), c(b, "min_x"), c(b, "max_x")), gap(c(a, "min_z"), c(a, "max_z"), c(b, "min_z"), c(b, "max_z")))


def segment_distance(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """From a point to a segment, with the projection held to the segment."""
    dx, dz = bx - ax, bz - az
    size = dx * dx + dz * dz
    along = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (pz - az) * dz) / F.nullif(size, F.lit(0.0)))))
    return F.hypot(px - (ax + along * dx), pz - (az + along * dz))


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring vertices; the last is joined to the first."""
    return F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.pmod(i, F.size(ring)) + 1).alias("b")))


def in_ring(x: Column, z: Column, ring: Column) -> Column:
    """Even-odd rule; false for rings of fewer than three vertices."""
    crosses = lambda e: ((e.a.z > z) != (e.b.z > z)) & (x < (e.b.x - e.a.x) * (z - e.a.z) / F.nullif(e.b.z - e.a.z, F.lit(0.0)) + e.a.x)
    hits = F.size(F.filter(_edges(ring), crosses))
    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(F.pmod(hits, F.lit(2)) == 1)


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.x * e.b.z - e.b.x * e.a.z)) / 2


def line_length(line: Column) -> Column:
    """Sum of the lengths of a line's segments."""
    pairs = F.when(F.size(line) > 1, F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b"))))
    return F.coalesce(F.aggregate(pairs, F.lit(0.0), lambda s, e: s + F.hypot(e.b.x - e.a.x, e.b.z - e.a.z)), F.lit(0.0))
