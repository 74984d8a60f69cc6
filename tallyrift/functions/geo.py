"""Geometry as Column expressions. A ring is an array of (x, y) structs, a shape an array of outer rings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<{RING}>"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _edges(ring: Column, fold: Callable[[Column, Column, Column], Column], zero: Column) -> Column:
    """``fold`` (state, from, to) over the ring's edges; the last goes back to the first point."""
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), zero, lambda acc, i: fold(acc, F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges. A ring without points holds none."""
    def cross(inside: Column, a: Column, b: Column) -> Column:
        meets = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return inside != F.coalesce(meets, F.lit(False))

    return F.when(F.size(ring) > 0, _edges(ring, cross, F.lit(False))).otherwise(False)


def in_shape(shape: Column, x: Column, y: Column) -> Column:
    """Outer rings only; holes don't count."""
    return F.coalesce(F.exists(shape, lambda ring: in_ring(ring, x, y)), F.lit(False))


def _moments(ring: Column) -> Column:
    """(a, x, y): twice the signed area and the sums that the centroid is made of."""
    def add(acc: Column, p: Column, q: Column) -> Column:
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (p["x"] + q["x"]) * cross).alias("x"), (acc["y"] + (p["y"] + q["y"]) * cross).alias("y"))

    return _edges(ring, add, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def area(ring: Column) -> Column:
    return F.abs(_moments(ring)["a"]) / 2


def vertex_mean(ring: Column) -> Column:
    total = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k])
    return _point(total("x") / F.size(ring), total("y") / F.size(ring))


def ring_centroid(ring: Column, least: float = 1e-10) -> Column:
    """By the shoelace formula; of a ring without an area its first point."""
    m = _moments(ring)
    first = F.get(ring, 0)
    flat = F.abs(m["a"]) / 2 < least
    return _point(F.when(flat, first["x"]).otherwise(m["x"] / (3 * m["a"])), F.when(flat, first["y"]).otherwise(m["y"] / (3 * m["a"])))


def box(ring: Column) -> Column:
    edge = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"))


def within_box(x: Column, y: Column, b: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def shape_centroid(shape: Column) -> Column:
    """The centroid of the largest ring, the first on a tie; the middle of its box where the centroid isn't in that."""
    sizes = F.transform(shape, area)
    ring = F.get(shape, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))
    c, b = ring_centroid(ring), box(ring)
    inside = within_box(c["x"], c["y"], b)
    return _point(F.when(inside, c["x"]).otherwise((b["x0"] + b["x1"]) / 2), F.when(inside, c["y"]).otherwise((b["y0"] + b["y1"]) / 2))


def weighted_centroid(shape: Column, least: float = 1e-12) -> Column:
    """The rings' centroids by their areas; where no ring has one, the mean of the first ring's points."""
    def add(acc: Column, ring: Column) -> Column:
        m = _moments(ring)
        some = F.abs(m["a"]) >= least
        w = F.when(some, F.abs(m["a"]) / 2).otherwise(0.0)
        part = lambda k: F.when(some, m[k] / (3 * m["a"]) * w).otherwise(0.0)
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + part("x")).alias("x"), (acc["y"] + part("y")).alias("y"))

    t = F.aggregate(shape, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)
    mean = vertex_mean(F.get(shape, 0))
    return _point(F.when(t["w"] > 0, t["x"] / t["w"]).otherwise(mean["x"]), F.when(t["w"] > 0, t["y"] / t["w"]).otherwise(mean["y"]))


def longest_ring_mean(shape: Column) -> Column:
    """The mean of the points of the ring that has most of them, the first on a tie; null without any."""
    sizes = F.transform(shape, F.size)
    ring = F.get(shape, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))
    return F.when(F.size(ring) > 0, vertex_mean(ring))


def flat_distance(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """Squared, on a plane that touches the globe at the first point; good for finding the nearest."""
    dx, dy = (to_lng - lng) * F.cos(F.radians(lat)), to_lat - lat
    return dx * dx + dy * dy
