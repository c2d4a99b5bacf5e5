"""Geometric values as structs of doubles: point (x, y), box (high, low), circle (center, radius), lseg (a, b); path and polygon as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    high = point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
    low = point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]))
    return F.struct(high.alias("high"), low.alias("low"))


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("center"), radius.cast("double").alias("radius"))


def lseg(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def distance(a: Column, b: Column) -> Column:
    """point <-> point."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def width(b: Column) -> Column:
    return b["high"]["x"] - b["low"]["x"]


def height(b: Column) -> Column:
    return b["high"]["y"] - b["low"]["y"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def circle_area(c: Column) -> Column:
    return F.pi() * c["radius"] * c["radius"]


def diameter(c: Column) -> Column:
    return 2 * c["radius"]


def center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def diagonal(b: Column) -> Column:
    return lseg(b["high"], b["low"])


def bound_box(a: Column, b: Column) -> Column:
    return box(point(F.greatest(a["high"]["x"], b["high"]["x"]), F.greatest(a["high"]["y"], b["high"]["y"])), point(F.least(a["low"]["x"], b["low"]["x"]), F.least(a["low"]["y"], b["low"]["y"])))


def box_contains(b: Column, p: Column) -> Column:
    """box @> point."""
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def boxes_overlap(a: Column, b: Column) -> Column:
    """box && box."""
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c["center"], p) <= c["radius"]


def slope(a: Column, b: Column) -> Column:
    return F.when(a["x"] == b["x"], F.lit(float("inf"))).otherwise((b["y"] - a["y"]) / (b["x"] - a["x"]))


def is_horizontal(s: Column) -> Column:
    return s["a"]["y"] == s["b"]["y"]


def is_vertical(s: Column) -> Column:
    return s["a"]["x"] == s["b"]["x"]


def _cross(s: Column, t: Column) -> Column:
    return (s["b"]["x"] - s["a"]["x"]) * (t["b"]["y"] - t["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (t["b"]["x"] - t["a"]["x"])


def is_parallel(s: Column, t: Column) -> Column:
    return F.abs(_cross(s, t)) < 1e-6


def is_perpendicular(s: Column, t: Column) -> Column:
    dot = (s["b"]["x"] - s["a"]["x"]) * (t["b"]["x"] - t["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (t["b"]["y"] - t["a"]["y"])
    return F.abs(dot) < 1e-6


def closest_point(s: Column, p: Column) -> Column:
    """Point of a segment nearest to p (lseg ## point)."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    t = F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def polygon_area(points: Column) -> Column:
    """By the shoelace rule."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def path_length(points: Column) -> Column:
    steps = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), distance)
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def length(s: Column) -> Column:
    return distance(s["a"], s["b"])


def radius(c: Column) -> Column:
    return c["radius"]


def npoints(points: Column) -> Column:
    return F.size(points)


def polygon_of(b: Column) -> Column:
    """polygon(box): its four corners."""
    low, high = b["low"], b["high"]
    return F.array(low, point(low["x"], high["y"]), high, point(high["x"], low["y"]))


def isclosed(path: Column) -> Column:
    """Whether a path, as (points, closed), is closed."""
    return path["closed"]


def pclose(path: Column) -> Column:
    return path.withField("closed", F.lit(True))


def popen(path: Column) -> Column:
    return path.withField("closed", F.lit(False))


def line(a: Column, b: Column) -> Column:
    """The line through two points as a, b, c of ax + by + c = 0."""
    up = a["x"] == b["x"]
    m = F.when(~up, (b["y"] - a["y"]) / F.when(~up, b["x"] - a["x"]))
    return F.struct(F.when(up, -1.0).otherwise(m).alias("a"), F.when(up, 0.0).otherwise(-1.0).alias("b"), F.when(up, a["x"]).otherwise(a["y"] - m * a["x"]).alias("c"))


def segments_intersect(s: Column, t: Column) -> Column:
    """lseg ?# lseg."""

    def side(p: Column, a: Column, b: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))

    def on(p: Column, a: Column, b: Column) -> Column:
        return (side(p, a, b) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    crossing = (side(s["a"], t["a"], t["b"]) * side(s["b"], t["a"], t["b"]) < 0) & (side(t["a"], s["a"], s["b"]) * side(t["b"], s["a"], s["b"]) < 0)
    return crossing | on(s["a"], t["a"], t["b"]) | on(s["b"], t["a"], t["b"]) | on(t["a"], s["a"], s["b"]) | on(t["b"], s["a"], s["b"])
