"""Projections, rings, distances and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius of the spherical web projection, mean radius of the earth, both in metres.
WEB_RADIUS = 6378137.0
MEAN_RADIUS = 6371008.8


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * WEB_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WEB_RADIUS


def inverse_mercator_lon(x: Column) -> Column:
    return F.degrees(x / WEB_RADIUS)


def inverse_mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / WEB_RADIUS)))


def ref_label(lat: Column, lon: Column) -> Column:
    """``lat, lon`` with four decimals; null without a place."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.4f, %.4f", lat, lon))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; within 0.6 % of the ellipsoid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of points (x, y); the ring closes itself."""
    n = F.size(ring)
    step = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + step(i))) / 2)


def ring_centroid(ring: Column, axis: str) -> Column:
    """The area centroid's coordinate on an axis; null for degenerate rings."""
    n = F.size(ring)
    cross = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + cross(i))
    weighted = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + (F.get(ring, i)[axis] + F.get(ring, (i + 1) % n)[axis]) * cross(i))
    return F.when((n >= 3) & (total != 0), weighted / (3 * total))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda inside, i: inside != F.coalesce(crosses(i), F.lit(False)))


def affine(west: float, north: float, east: float, south: float, columns: int, rows: int) -> tuple[float, ...]:
    """The six numbers that take pixels to coordinates."""
    return (east - west) / columns, 0.0, west, 0.0, (south - north) / rows, north
