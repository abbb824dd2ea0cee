"""Plane geometry and map projection as Column expressions, for generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the transverse Mercator zone 37 north.
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _LON0, _FALSE_EAST = 0.9996, 39.0, 500000.0
_N = _F / (2 - _F)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees, by the series in the third flattening."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FALSE_EAST + _K0 * _RECTIFYING * east, _K0 * _RECTIFYING * north


def utm_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = north / (_K0 * _RECTIFYING), (east - _FALSE_EAST) / (_K0 * _RECTIFYING)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return _LON0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def web_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile at a zoom level."""
    n = float(2**zoom)
    r = F.radians(lat)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def place_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Parameter from 0 to 1 of the point of a segment that is nearest to p; 0 for a segment without length."""
    d2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(d2.cast("double"), F.lit(0.0))
    return F.when(t.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))  # greatest and least pass over nulls


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = place_on_segment(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """-1, 0 or 1: p is right of, on, or left of the line from a to b."""
    return F.signum(((bx - ax) * (py - ay) - (by - ay) * (px - ax)).cast("double")).cast("int")


def properly_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two segments (x1, y1, x2, y2) cross inside both; touching and overlapping do not count."""
    return (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Change of direction at b; null if two neighbours coincide. The cosine is clamped before acos."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy).cast("double"))
    cosine = (ux * vx + uy * vy) / F.nullif(norm, F.lit(0.0))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def clip_to_rectangle(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(from, to) parameters of the part of a segment that lies in a rectangle; from > to if none does."""
    big = F.lit(2.0)

    def slab(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        div = F.nullif(d.cast("double"), F.lit(0.0))
        t, u = (low - a) / div, (high - a) / div
        inside = (a >= low) & (a <= high)
        return F.when(d == 0, F.when(inside, -big).otherwise(big)).otherwise(F.least(t, u)), F.when(d == 0, F.when(inside, big).otherwise(-big)).otherwise(F.greatest(t, u))

    (tx0, tx1), (ty0, ty1) = slab(ax, bx - ax, x0, x1), slab(ay, by - ay, y0, y1)
    return F.greatest(F.lit(0.0), tx0, ty0), F.least(F.lit(1.0), tx1, ty1)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a closed ring, an array of structs x, y; the last point repeats the first."""
    crossed = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b"))),
        lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x),
    )
    return F.when(F.size(ring) > 3, F.size(crossed) % 2 == 1).otherwise(False)


def line_length(line: Column) -> Column:
    """Length of an array of structs x, y; 0 for fewer than two points."""
    step = lambda i: distance(F.get(line, i - 1).x, F.get(line, i - 1).y, F.get(line, i).x, F.get(line, i).y)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), step)
    return F.when(F.size(line) > 1, F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)).otherwise(0.0)


def ring_area(ring: Column) -> Column:
    """Unsigned area of a closed ring."""
    cross = lambda i: F.get(ring, i - 1).x * F.get(ring, i).y - F.get(ring, i).x * F.get(ring, i - 1).y
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), cross)
    return F.when(F.size(ring) > 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda a, d: a + d)) / 2).otherwise(0.0)


def ring_sense(ring: Column) -> Column:
    """1 for a closed ring drawn against the clock, -1 for one drawn with it, 0 without area."""
    cross = lambda i: F.get(ring, i - 1).x * F.get(ring, i).y - F.get(ring, i).x * F.get(ring, i - 1).y
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: cross(i).cast("double"))
    return F.coalesce(F.signum(F.aggregate(parts, F.lit(0.0), lambda a, d: a + d)), F.lit(0.0)).cast("int")


def _on(px: Column, py: Column, s: tuple[Column, ...]) -> Column:
    """Whether a point lies on a segment, its ends included."""
    return (side(*s, px, py) == 0) & px.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & py.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two segments (x1, y1, x2, y2) have a point in common: crossing, touching or overlapping."""
    return properly_cross(a, b) | _on(a[0], a[1], b) | _on(a[2], a[3], b) | _on(b[0], b[1], a) | _on(b[2], b[3], a)


def meets_ring(s: tuple[Column, ...], ring: Column) -> Column:
    """A segment has a point in common with the area of a closed ring: it meets an edge, or begins inside."""
    edge = lambda i: (F.get(ring, i - 1).x, F.get(ring, i - 1).y, F.get(ring, i).x, F.get(ring, i).y)
    return F.exists(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: segments_meet(s, edge(i))) | ring_contains(ring, s[0], s[1])


def area_of(polygons: Column) -> Column:
    """Area of polygons, each an array of closed rings: the first less the others, which are holes."""
    one = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(polygons, one), F.lit(0.0), lambda a, x: a + x)
