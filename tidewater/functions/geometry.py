"""Points, segments, boxes, circles and polygons, as Column expressions.

A point is a struct of x and y; a box has its upper right (``high``) and lower
left (``low``) corners; a polygon is an array of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def slope(a: Column, b: Column) -> Column:
    """Of the line through two points; infinite for an upright one."""
    return F.when(a["x"] == b["x"], F.lit(float("inf"))).otherwise((b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """From a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long = dx * dx + dy * dy
    t = F.when(long == 0, 0.0).otherwise(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(long, F.lit(0.0)))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def box(a: Column, b: Column) -> Column:
    """The box of two opposite corners, in whatever order."""
    high = point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
    low = point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]))
    return F.struct(high.alias("high"), low.alias("low"))


def box_area(b: Column) -> Column:
    return (b["high"]["x"] - b["low"]["x"]) * (b["high"]["y"] - b["low"]["y"])


def box_center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["high"]["x"] >= b["high"]["x"]) & (a["low"]["x"] <= b["low"]["x"]) & (a["high"]["y"] >= b["high"]["y"]) & (a["low"]["y"] <= b["low"]["y"])


def box_left_of(a: Column, b: Column) -> Column:
    return a["high"]["x"] < b["low"]["x"]


def box_intersection(a: Column, b: Column) -> Column:
    """Null where two boxes do not meet."""
    high = point(F.least(a["high"]["x"], b["high"]["x"]), F.least(a["high"]["y"], b["high"]["y"]))
    low = point(F.greatest(a["low"]["x"], b["low"]["x"]), F.greatest(a["low"]["y"], b["low"]["y"]))
    return F.when(box_overlaps(a, b), F.struct(high.alias("high"), low.alias("low")))


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("center"), radius.cast("double").alias("radius"))


def circle_area(c: Column) -> Column:
    return c["radius"] * c["radius"] * math.pi


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c["center"], p) <= c["radius"]


def circle_overlaps(a: Column, b: Column) -> Column:
    return distance(a["center"], b["center"]) <= a["radius"] + b["radius"]


def path_length(points: Column) -> Column:
    """Of an open path."""
    steps = F.transform(points, lambda p, i: F.when(i > 0, distance(p, F.get(points, i - 1))).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _sides(points: Column) -> Column:
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b")))


def polygon_area(points: Column) -> Column:
    turns = F.aggregate(_sides(points), F.lit(0.0), lambda s, z: s + z["a"]["x"] * z["b"]["y"] - z["a"]["y"] * z["b"]["x"])
    return F.abs(turns) / 2


def polygon_contains(points: Column, p: Column) -> Column:
    """Whether a ray from the point crosses the border an odd number of times."""

    def crosses(z: Column) -> Column:
        a, b = z["a"], z["b"]
        at = a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < at)

    return F.size(F.filter(_sides(points), crosses)) % 2 == 1
