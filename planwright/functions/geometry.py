"""Geometry as Column expressions: rings are arrays of struct<x double, y double>, boxes struct<min_x, min_y, max_x, max_y>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def point(x: Num, y: Num) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def box(min_x: Num, min_y: Num, max_x: Num, max_y: Num) -> Column:
    return F.struct(_c(min_x).alias("min_x"), _c(min_y).alias("min_y"), _c(max_x).alias("max_x"), _c(max_y).alias("max_y"))


def rectangle(x: Num, y: Num, w: Num, h: Num) -> Column:
    x, y, w, h = map(_c, (x, y, w, h))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def coordinates(ring: Column, axis: str) -> Column:
    return F.transform(ring, lambda p: p[axis])


def _around(ring: Column, f) -> Column:
    """The sum of f(point, next point) over the closed ring."""
    n = F.size(ring)
    each = F.transform(ring, lambda p, i: f(p, F.element_at(ring, (i + 1) % n + 1)))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 below three points."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(_around(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) * 0.5)


def ring_perimeter(ring: Column) -> Column:
    return _around(ring, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))


def ring_box(ring: Column) -> Column:
    xs, ys = coordinates(ring, "x"), coordinates(ring, "y")
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted; the mean of the points where they are on a line."""
    twice = _around(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    cx = _around(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    cy = _around(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    mean = [F.aggregate(coordinates(ring, k), F.lit(0.0), lambda a, v: a + v) / F.size(ring) for k in "xy"]
    flat = F.abs(twice) < 1e-9
    return point(F.when(flat, mean[0]).otherwise(cx / (3 * twice)), F.when(flat, mean[1]).otherwise(cy / (3 * twice)))


def clean_ring(ring: Column, digits: int = 2) -> Column:
    """Points with NaN or null go, the rest is rounded half to even."""
    kept = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.transform(kept, lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def to_pixels(ring: Column, min_x: Num, max_y: Num, per_unit: Num) -> Column:
    """World to image: y points down, fractions are cut off toward zero."""
    return F.transform(ring, lambda p: F.struct(((p["x"] - _c(min_x)) * _c(per_unit)).cast("long").alias("x"), ((_c(max_y) - p["y"]) * _c(per_unit)).cast("long").alias("y")))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["max_x"] - b["min_x"]) * F.greatest(F.lit(0.0), b["max_y"] - b["min_y"])


def box_valid(b: Column) -> Column:
    return (b["max_x"] > b["min_x"]) & (b["max_y"] > b["min_y"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Edges count."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def box_contains(outer: Column, inner: Column) -> Column:
    return (outer["min_x"] <= inner["min_x"]) & (outer["min_y"] <= inner["min_y"]) & (outer["max_x"] >= inner["max_x"]) & (outer["max_y"] >= inner["max_y"])


def box_has_point(b: Column, x: Num, y: Num, margin: float = 0.0) -> Column:
    return _c(x).between(b["min_x"] - margin, b["max_x"] + margin) & _c(y).between(b["min_y"] - margin, b["max_y"] + margin)


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height of what two boxes share, 0 if nothing."""
    return (
        F.greatest(F.lit(0.0), F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])),
        F.greatest(F.lit(0.0), F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    w, h = overlap(a, b)
    return _ratio(w * h, box_area(a) + box_area(b) - w * h)


def overlap_metrics(a: Column, b: Column) -> dict[str, Column]:
    """All 0 if either box isn't valid."""
    w, h = overlap(a, b)
    fine = box_valid(a) & box_valid(b)
    width = F.least(a["max_x"] - a["min_x"], b["max_x"] - b["min_x"])
    height = F.least(a["max_y"] - a["min_y"], b["max_y"] - b["min_y"])
    found = {"intersection_area": w * h, "smaller_area_ratio": _ratio(w * h, F.least(box_area(a), box_area(b))), "width_ratio": _ratio(w, width), "height_ratio": _ratio(h, height)}
    return {k: F.when(fine, v).otherwise(0.0) for k, v in found.items()}


def overlaps_much(a: Column, b: Column, area_ratio: float = 0.05, axis_ratio: float = 0.15) -> Column:
    m = overlap_metrics(a, b)
    return (m["intersection_area"] > 0) & (m["smaller_area_ratio"] >= area_ratio) & (m["width_ratio"] >= axis_ratio) & (m["height_ratio"] >= axis_ratio)


def box_distance(b: Column, x: Num, y: Num) -> Column:
    dx = F.greatest(b["min_x"] - _c(x), F.lit(0.0), _c(x) - b["max_x"])
    dy = F.greatest(b["min_y"] - _c(y), F.lit(0.0), _c(y) - b["max_y"])
    return F.sqrt(dx * dx + dy * dy)


def grow(b: Column, by: Num) -> Column:
    return box(b["min_x"] - _c(by), b["min_y"] - _c(by), b["max_x"] + _c(by), b["max_y"] + _c(by))


def clamp(b: Column, width: Num, height: Num) -> Column:
    return box(F.greatest(F.lit(0.0), b["min_x"]), F.greatest(F.lit(0.0), b["min_y"]), F.least(_c(width), b["max_x"]), F.least(_c(height), b["max_y"]))


def sub_box(b: Column, left: Num, top: Num, right: Num, bottom: Num) -> Column:
    """Fractions of an image (y down) -> the part of the world box (y up)."""
    w, h = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    return box(b["min_x"] + w * _c(left), b["max_y"] - h * _c(bottom), b["min_x"] + w * _c(right), b["max_y"] - h * _c(top))


def insert_matrix(tx: Num, ty: Num, sx: Num, sy: Num, rotation: Num, degrees: bool | None = None) -> Column:
    """Affine struct a, b, c, d, tx, ty of a placed block. ``degrees`` None: radians unless over a full turn."""
    r = _c(rotation)
    r = F.radians(r) if degrees else r if degrees is False else F.when(F.abs(r) > 2 * math.pi + 1e-6, F.radians(r)).otherwise(r)
    return F.struct((_c(sx) * F.cos(r)).alias("a"), (-_c(sy) * F.sin(r)).alias("b"), (_c(sx) * F.sin(r)).alias("c"), (_c(sy) * F.cos(r)).alias("d"), _c(tx).alias("tx"), _c(ty).alias("ty"))


def apply_matrix(m: Column, x: Num, y: Num) -> Column:
    return point(m["a"] * _c(x) + m["b"] * _c(y) + m["tx"], m["c"] * _c(x) + m["d"] * _c(y) + m["ty"])


def compose(outer: Column, inner: Column) -> Column:
    return F.struct(
        (outer["a"] * inner["a"] + outer["b"] * inner["c"]).alias("a"), (outer["a"] * inner["b"] + outer["b"] * inner["d"]).alias("b"),
        (outer["c"] * inner["a"] + outer["d"] * inner["c"]).alias("c"), (outer["c"] * inner["b"] + outer["d"] * inner["d"]).alias("d"),
        (outer["a"] * inner["tx"] + outer["b"] * inner["ty"] + outer["tx"]).alias("tx"), (outer["c"] * inner["tx"] + outer["d"] * inner["ty"] + outer["ty"]).alias("ty"),
    )


def arc_points(cx: Num, cy: Num, radius: Num, start: Num, end: Num, steps: int = 36) -> Column:
    """``steps`` + 1 points from start to end (degrees), counter-clockwise; an end before the start is a turn on."""
    stop = F.when(_c(end) < _c(start), _c(end) + 360).otherwise(_c(end))
    at = lambda i: F.radians(_c(start) + (stop - _c(start)) * i / steps)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(_c(cx) + _c(radius) * F.cos(at(i)), _c(cy) + _c(radius) * F.sin(at(i))))


def has_point(ring: Column, x: Num, y: Num) -> Column:
    """Even-odd rule."""
    crossed = lambda p, q: F.when(((p["y"] > _c(y)) != (q["y"] > _c(y))) & (_c(x) < (q["x"] - p["x"]) * (_c(y) - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]), 1.0).otherwise(0.0)
    return _around(ring, crossed) % 2 == 1


def segment_angle(x1: Num, y1: Num, x2: Num, y2: Num) -> Column:
    """Folded to 0 .. pi/2."""
    a = F.abs(F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1)))
    return F.least(a, math.pi - a)


def is_orthogonal(angle: Column, within: float = 12.0) -> Column:
    return (angle <= math.radians(within)) | (angle >= math.radians(90 - within))


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(0.0)
