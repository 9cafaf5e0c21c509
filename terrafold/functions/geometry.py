"""Geometry as nested arrays, and scalar functions of it as Catalyst expressions.

A geometry is ``array<array<array<struct<x, y>>>>``: parts, rings (the first is
the exterior) and closed rings of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(POINT_TYPE)))
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A one-part geometry, counter-clockwise from its lower left corner."""
    ring = F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))
    return F.array(F.array(ring))


def _edges(ring: Column) -> Column:
    """array<struct<p, q>> of the ring's segments."""
    n = F.greatest(F.size(ring) - 1, F.lit(1))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def edges(geometry: Column) -> Column:
    return F.flatten(F.transform(F.flatten(geometry), _edges))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + value(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(_edges(ring), _cross)) / 2


def area(geometry: Column) -> Column:
    """Exterior rings less their holes."""
    return F.aggregate(
        geometry,
        F.lit(0.0),
        lambda acc, part: acc
        + ring_area(F.get(part, 0))
        - F.aggregate(F.slice(part, 2, F.size(part)), F.lit(0.0), lambda a, hole: a + ring_area(hole)),
    )


def perimeter(geometry: Column) -> Column:
    """Length of all rings, holes too."""
    return _sum(edges(geometry), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def line_length(points: Column) -> Column:
    return _sum(_edges(points), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> Column:
    xs, ys = F.transform(points(geometry), lambda p: p["x"]), F.transform(points(geometry), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )


def vertex_count(geometry: Column) -> Column:
    """Points of exterior rings, closing points excluded."""
    return F.aggregate(geometry, F.lit(0), lambda acc, part: acc + F.greatest(F.size(F.get(part, 0)) - 1, F.lit(0)))


def centroid(geometry: Column) -> Column:
    """Area-weighted, holes negative; the mean of the bounds where there is no area."""

    def moments(ring: Column, sign: Column) -> Column:
        way = F.signum(_sum(_edges(ring), _cross)) * sign
        return F.aggregate(
            _edges(ring),
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda acc, e: F.struct(
                (acc["a"] + way * _cross(e)).alias("a"),
                (acc["x"] + way * _cross(e) * (e["p"]["x"] + e["q"]["x"])).alias("x"),
                (acc["y"] + way * _cross(e) * (e["p"]["y"] + e["q"]["y"])).alias("y"),
            ),
        )

    rings = F.flatten(
        F.transform(geometry, lambda part: F.transform(part, lambda ring, i: moments(ring, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))))
    )
    total = F.aggregate(
        rings,
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, m: F.struct((acc["a"] + m["a"]).alias("a"), (acc["x"] + m["x"]).alias("x"), (acc["y"] + m["y"]).alias("y")),
    )
    box = bounds(geometry)
    return F.struct(
        F.coalesce(F.try_divide(total["x"], 3 * total["a"]), (box["minx"] + box["maxx"]) / 2).alias("x"),
        F.coalesce(F.try_divide(total["y"], 3 * total["a"]), (box["miny"] + box["maxy"]) / 2).alias("y"),
    )


def contains_point(segments: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the segments of all rings."""
    return F.aggregate(
        segments,
        F.lit(False),
        lambda acc, e: acc
        != (
            ((e["p"]["y"] > y) != (e["q"]["y"] > y))
            & (x < e["p"]["x"] + F.coalesce(F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]), F.lit(0.0)))
        ),
    )


def meets_open_box(segments: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the closed polygon of these segments and the open box have a point in common."""
    inf = F.lit(float("inf"))

    def span(start: Column, step: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(lo - start, step), F.try_divide(hi - start, step)
        still = F.when((start > lo) & (start < hi), F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.coalesce(F.least(a, b), -inf * still), F.coalesce(F.greatest(a, b), inf * still)

    def crosses(e: Column) -> Column:
        ax, bx = span(e["p"]["x"], e["q"]["x"] - e["p"]["x"], x0, x1)
        ay, by = span(e["p"]["y"], e["q"]["y"] - e["p"]["y"], y0, y1)
        lo, hi = F.greatest(ax, ay), F.least(bx, by)
        return (lo < hi) & (F.greatest(lo, F.lit(0.0)) <= F.least(hi, F.lit(1.0))) & (lo < 1) & (hi > 0)

    return F.exists(segments, crosses) | contains_point(segments, (x0 + x1) / 2, (y0 + y1) / 2)


def utm_from_wgs84(lon: Column, lat: Column, zone: int = 50) -> Column:
    """Transverse Mercator easting and northing (northern hemisphere) by Krueger's
    series to the third order, in metres."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(6 * zone - 183)))
    s = F.sin(phi)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(s) - F.lit(e) * atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(F.lit(500000.0) + F.lit(k0 * big) * east, F.lit(k0 * big) * north)


def reproject(geometry: Column, zone: int = 50) -> Column:
    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: utm_from_wgs84(p["x"], p["y"], zone))))


def cosine(a: Column, b: Column) -> Column:
    """Of two double arrays; 0 where one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_softmax(values: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(values)
    scaled = F.transform(values, lambda v: (v - top) / F.lit(temperature))
    return F.transform(
        F.array(F.log(F.aggregate(scaled, F.lit(0.0), lambda acc, v: acc + F.exp(v)))), lambda z: F.transform(scaled, lambda v: v - z)
    )[0]
