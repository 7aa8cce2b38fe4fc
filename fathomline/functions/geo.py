"""Distances and directions as Column expressions. Points are latitude and longitude in degrees, or x and y in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth and length of a degree, in metres.
EARTH_M = 6_371_000.0
LON_M, LAT_M = 111_320.0, 110_540.0
GOLDEN_ANGLE = 137.50776405003785


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with the longitude shrunk at the mean latitude."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * LON_M
    return F.hypot(x, (lat2 - lat1) * LAT_M)


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local metres around a reference point."""
    return (lon - lon0) * LON_M * F.cos(F.radians(lat0)), (lat - lat0) * LAT_M


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def undirected_bearing(dx: Column, dy: Column) -> Column:
    """Direction of a line, 0 to 180 degrees from the x axis."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle bearing, 0 to 360 degrees from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Signed change of bearing, -180 (exclusive) to 180; right is positive."""
    d = F.pmod(after - before, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def maneuver(angle: Column) -> Column:
    """straight below 15 degrees, slight below 45, turn below 135, else sharp; with its side."""
    size = F.abs(angle)
    kind = F.when(size < 45, "slight").when(size < 135, "turn").otherwise("sharp")
    return F.when(size < 15, "straight").otherwise(F.concat(kind, F.when(angle > 0, "-right").otherwise("-left")))


def closest_in_band(angles: Column, low: float, high: float, wanted: float = GOLDEN_ANGLE) -> Column:
    """Of an array of angles the one nearest to wanted within low to high; null if there is none."""
    inside = F.filter(angles, lambda a: (a >= low) & (a <= high))
    return F.array_min(F.transform(inside, lambda a, i: F.struct(F.abs(a - wanted).alias("d"), i.alias("i"), a.alias("a"))))["a"]


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a line segment."""
    length2 = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2))).otherwise(F.lit(0.0))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area of a closed ring given as arrays of coordinates."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(xs, i) * F.get(ys, i + 1) - F.get(xs, i + 1) * F.get(ys, i))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


DEGREE = math.pi / 180


def cell_area(lat: Column, degrees: float) -> Column:
    """Square kilometres of a grid cell of so many degrees around a latitude."""
    return F.lit(degrees * LAT_M / 1000) * F.lit(degrees * LON_M / 1000) * F.cos(F.radians(lat))
