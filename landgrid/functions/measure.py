"""Planar and ellipsoid measures, projections, affine transforms and raster surfaces, as Column functions.

A ring is an array of structs (x, y) whose last point repeats the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CGCS2000 ellipsoid.
MAJOR, MINOR = 6378137.0, 6356752.3141403561
E2 = 0.0066943800229008


def _series() -> tuple[float, ...]:
    """Coefficients of the authalic area series in the ellipsoid's squared eccentricity."""
    e2, e4, e6, e8 = (E2**k for k in (1, 2, 3, 4))
    return (
        1 + e2 / 2 + e4 * 3 / 8 + e6 * 35 / 112 + e8 * 630 / 2304,
        e2 / 6 + e4 * 15 / 80 + e6 * 21 / 112 + e8 * 420 / 2304,
        e4 * 3 / 80 + e6 * 7 / 112 + e8 * 180 / 2304,
        e6 / 112 + e8 * 45 / 2304,
        e8 * 5 / 2304,
    )


SERIES = _series()


def _edges(ring: Column, f) -> Column:
    """Sum of f(from, to) over a ring's or path's segments."""
    first, rest = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(first, rest, f), F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    """Signed planar area, positive for counter-clockwise rings."""
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def path_length(path: Column) -> Column:
    return _edges(path, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def _area_strip(l1: Column, b1: Column, l2: Column, b2: Column) -> Column:
    """Area between a segment and the prime meridian; radians."""
    mean, delta, mid = (l1 + l2) / 2, b2 - b1, (b1 + b2) / 2
    total = None
    for k, c in enumerate(SERIES):
        n = 2 * k + 1
        term = F.lit(c if k % 2 == 0 else -c) * F.sin(F.lit(n / 2) * delta) * F.cos(F.lit(float(n)) * mid)
        total = term if total is None else total + term
    return F.lit(2 * MINOR * MINOR) * mean * total


def ellipsoid_ring_area(ring: Column) -> Column:
    """Square metres on CGCS2000 of a ring in degrees, signed like ring_area."""
    rad = lambda v: v * F.lit(math.pi) / 180
    return _edges(ring, lambda p, q: _area_strip(rad(p["x"]), rad(p["y"]), rad(q["x"]), rad(q["y"])))


def ellipsoid_distance(l1: Column, b1: Column, l2: Column, b2: Column, legacy: bool = False) -> Column:
    """Metres between near points in degrees, by the mid-latitude formula. legacy: with the squared eccentricity squared once more."""
    rad = lambda v: v * F.lit(math.pi) / 180
    l1, b1, l2, b2 = map(rad, (l1, b1, l2, b2))
    e2 = (MAJOR * MAJOR - MINOR * MINOR) / (MAJOR * MAJOR)
    dl, db, mid = l2 - l1, b2 - b1, (b1 + b2) / 2
    cos, tan2 = F.cos(mid), F.tan(mid) * F.tan(mid)
    eta = F.lit(e2 * e2 if legacy else e2 * MAJOR * MAJOR / (MINOR * MINOR)) * cos * cos
    v2 = 1 + eta
    n = F.lit(MAJOR * MAJOR / MINOR) / F.sqrt(v2)
    east = n * cos * dl + n * cos * (1 + eta - 9 * eta * tan2) / (24 * v2 * v2) * dl * db * db - n * cos * cos * cos * tan2 / 24 * dl * dl * dl
    north = n / v2 * db - n * cos * cos * (2 + 3 * tan2 + 3 * tan2 * eta) / (24 * v2) * db * dl * dl + n * (eta - eta * tan2) / (8 * v2 * v2 * v2) * db * db * db
    return F.sqrt(east * east + north * north)


def ellipsoid_path_length(path: Column, legacy: bool = False) -> Column:
    return _edges(path, lambda p, q: ellipsoid_distance(p["x"], p["y"], q["x"], q["y"], legacy))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """By crossing number; points on an edge count as the half-open rule has it."""

    def crossing(p, q):
        over = (p["y"] > y) != (q["y"] > y)
        return F.when(over & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(over, q["y"] - p["y"]).otherwise(1.0) + p["x"]), 1.0).otherwise(0.0)

    return _edges(ring, crossing).cast("bigint") % 2 == 1


def affine(points: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    return F.transform(points, lambda p: F.struct((F.lit(a) * p["x"] + F.lit(b) * p["y"] + F.lit(c)).alias("x"), (F.lit(d) * p["x"] + F.lit(e) * p["y"] + F.lit(f)).alias("y")))


def shift(points: Column, dx: float, dy: float) -> Column:
    return affine(points, 1.0, 0.0, dx, 0.0, 1.0, dy)


def scale(points: Column, sx: float, sy: float) -> Column:
    return affine(points, sx, 0.0, 0.0, 0.0, sy, 0.0)


def rotate(points: Column, angle: float) -> Column:
    return affine(points, math.cos(angle), -math.sin(angle), 0.0, math.sin(angle), math.cos(angle), 0.0)


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The counter-clockwise ring of an envelope."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def box_overlap(x0, y0, x1, y1, u0, v0, u1, v1) -> Column:
    """Area common to two envelopes."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(x1, u1) - F.greatest(x0, u0)) * F.greatest(zero, F.least(y1, v1) - F.greatest(y0, v0))


def boxes_meet(x0, y0, x1, y1, u0, v0, u1, v1) -> Column:
    return (x0 <= u1) & (u0 <= x1) & (y0 <= v1) & (v0 <= y1)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = lon * F.lit(math.pi / 180 * MAJOR)
    return x, F.ln(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) * F.lit(MAJOR)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / F.lit(math.pi / 180 * MAJOR), (F.atan(F.exp(y / F.lit(MAJOR))) * 2 - F.lit(math.pi / 2)) * F.lit(180 / math.pi)


def gauss_kruger(lon: Column, lat: Column, meridian: Column, false_easting: float = 500_000.0) -> tuple[Column, Column]:
    """Transverse Mercator on CGCS2000 about a central meridian, scale 1: easting, northing in metres."""
    ep2 = (MAJOR * MAJOR - MINOR * MINOR) / (MINOR * MINOR)
    b, l = lat * F.lit(math.pi / 180), (lon - meridian) * F.lit(math.pi / 180)  # noqa: E741
    e2 = 1 - (MINOR / MAJOR) ** 2
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384
    m2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096
    m4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384
    m6 = 35 * e2**3 / 3072 + 175 * e2**4 / 12288
    arc = F.lit(MAJOR) * (F.lit(m0) * b - F.lit(m2) * F.sin(2 * b) + F.lit(m4) * F.sin(4 * b) - F.lit(m6) * F.sin(6 * b))
    cos, t2 = F.cos(b), F.tan(b) * F.tan(b)
    eta2 = F.lit(ep2) * cos * cos
    n = F.lit(MAJOR) / F.sqrt(1 - F.lit(e2) * F.sin(b) * F.sin(b))
    m = l * cos
    m_2 = m * m
    north = arc + n * F.tan(b) * m_2 * (0.5 + m_2 * ((5 - t2 + 9 * eta2 + 4 * eta2 * eta2) / 24 + m_2 * (61 - 58 * t2 + t2 * t2) / 720))
    east = n * m * (1 + m_2 * ((1 - t2 + eta2) / 6 + m_2 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) / 120))
    return east + F.lit(false_easting), north


#: A raster cell's neighbours as (row, column) steps, clockwise from the north.
NEIGHBOURS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
NO_DATA = 10_000.0


def raster_value(h: Column) -> Column:
    """Heights of 10,000 and beyond, either way, count as 0."""
    return F.when(F.abs(h) >= NO_DATA, F.lit(0.0)).otherwise(h.cast("double"))


def raster_cell_surface(centre: Column, around: list[Column], size: Column) -> Column:
    """Surface area of a raster cell from its 8 neighbours' heights (NEIGHBOURS; null outside the raster).

    Eight triangles; a triangle takes its slope from the centre to the straight neighbour of its pair and along the
    edge between neighbours.
    """
    around = [F.coalesce(raster_value(h), centre) for h in around]
    total = F.lit(0.0)
    for i in range(8):
        rise, edge = around[i - i % 2] - centre, around[i] - around[i - 1]
        total = total + F.sqrt(size * size + rise * rise) * F.sqrt(size * size + edge * edge) / 8
    return total
