"""Scalar geometry as Column expressions; boxes are structs or prefixes of x1, y1, x2, y2 columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def box_of(struct: Column) -> Box:
    return Box(*(struct[c] for c in ("x1", "y1", "x2", "y2")))


def box_at(array: Column) -> Box:
    return Box(*(array[i] for i in range(4)))


def foot(b: Box) -> tuple[Column, Column]:
    """Bottom-centre point."""
    return (b.x1 + b.x2) * 0.5, b.y2 * F.lit(1.0)


def foot_of_array(bbox: Column) -> tuple[Column, Column]:
    """Bottom-centre of an array box; (0, 0) if it has fewer than four numbers."""
    ok = F.size(bbox) >= 4
    x, y = foot(Box(*(F.get(bbox, F.lit(i)) for i in range(4))))
    return F.when(ok, x).otherwise(0.0), F.when(ok, y).otherwise(0.0)


def foot_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = foot(a), foot(b)
    return F.hypot(ax - bx, ay - by)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0)) * F.greatest(b.y2 - b.y1, F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def size_ratio(a: Box, b: Box) -> Column:
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return F.when(large > 0, small / large).otherwise(0.0)


def contains(outer: Box, inner: Box) -> Column:
    return (inner.x1 >= outer.x1) & (inner.y1 >= outer.y1) & (inner.x2 <= outer.x2) & (inner.y2 <= outer.y2)


def clip(b: Box, width: Column | int, height: Column | int, least: int = 5) -> Column:
    """The box inside a picture as a struct; null if a side is under ``least`` pixels."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    inside = Box(F.greatest(b.x1, F.lit(0)), F.greatest(b.y1, F.lit(0)), F.least(b.x2, w), F.least(b.y2, h))
    ok = (inside.x2 - inside.x1 >= least) & (inside.y2 - inside.y1 >= least)
    return F.when(ok, F.struct(*(c.alias(n) for c, n in zip(inside, Box._fields))))


def expanded(b: Box, share: float, least: int) -> Box:
    """Grown on each side by a share of its longer side, at least ``least`` pixels."""
    m = F.greatest(F.lit(least), F.floor(F.greatest(b.x2 - b.x1, b.y2 - b.y1) * F.lit(share)))
    return Box(b.x1 - m, b.y1 - m, b.x2 + m, b.y2 + m)


def holds(b: Box, x: Column, y: Column) -> Column:
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def near_edge(b: Box, width: Column, margin: int) -> Column:
    return (b.x1 <= margin) | (b.x2 >= width - margin)


def project(h: Column, x: Column, y: Column, guard: float = 0.0) -> tuple[Column, Column]:
    """A 3x3 homography (row-major array) applied to a point; null where the scale is within ``guard`` of 0."""
    g = [F.get(h, F.lit(i)) for i in range(9)]
    w = g[6] * x + g[7] * y + g[8]
    ok = F.abs(w) > guard
    return F.when(ok, (g[0] * x + g[1] * y + g[2]) / w), F.when(ok, (g[3] * x + g[4] * y + g[5]) / w)


def to_court(h: Column, b: Box, width: Column | int, height: Column | int, length: float, breadth: float) -> tuple[Column, Column]:
    """The foot point in metres from the court's centre."""
    fx, fy = foot(b)
    x, y = project(h, fx / width, fy / height)
    return x * length, y * breadth


def inverse(h: Column) -> Column:
    """The closed-form inverse of a 3x3 matrix; null if singular."""
    a, b, c, d, e, f, g, i, j = (F.get(h, F.lit(k)) for k in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    cof = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return F.when(F.abs(det) > 1e-12, F.array(*(x / det for x in cof)))


def product(a: Column, b: Column) -> Column:
    """The product of two 3x3 matrices (row-major arrays)."""
    x, y = ([F.get(m, F.lit(i)) for i in range(9)] for m in (a, b))
    return F.array(*(x[3 * i] * y[j] + x[3 * i + 1] * y[3 + j] + x[3 * i + 2] * y[6 + j] for i in range(3) for j in range(3)))


def homography_distance(a: Column, b: Column, image_side: bool = True) -> Column:
    """How far two homographies turn nine probe vectors, both ways; probes in the picture (or on the court). Null if one is null or singular."""
    own = F.struct(a.alias("a"), b.alias("b"), inverse(a).alias("ia"), inverse(b).alias("ib"))
    at = (0.0, 0.5, 1.0) if image_side else (-0.5, 0.0, 0.5)
    probes = F.array(*(F.array(F.lit(x), F.lit(y), F.lit(1.0)) for x in at for y in at))

    def turned(d: Column) -> Column:
        def one(total: Column, v: Column) -> Column:
            x = [F.get(v, F.lit(i)) for i in range(3)]
            w = [F.get(d, F.lit(3 * i)) * x[0] + F.get(d, F.lit(3 * i + 1)) * x[1] + F.get(d, F.lit(3 * i + 2)) * x[2] for i in range(3)]
            dot = w[0] * x[0] + w[1] * x[1] + w[2] * x[2]
            size = lambda c: F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
            return total + 1 - dot / (size(w) * size(x))

        return F.aggregate(probes, F.lit(0.0), one)

    ways = lambda s: F.array(product(s["ia"], s["b"]), product(s["ib"], s["a"])) if image_side else F.array(product(s["b"], s["ia"]), product(s["a"], s["ib"]))
    both = F.get(F.transform(F.array(own), ways), F.lit(0))
    return F.aggregate(F.transform(both, turned), F.lit(0.0), lambda s, x: s + x)


def metres_to_unit(x: Column, y: Column, length: float, breadth: float) -> tuple[Column, Column]:
    return x / length + 0.5, y / breadth + 0.5


def unit_to_pixel(x: Column, y: Column, width: int, height: int, flip: bool = True) -> tuple[Column, Column]:
    return x * width, (1 - y if flip else y) * height


def affine(x: Column, y: Column, angle: float = 0.0, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> tuple[Column, Column]:
    """Turned and scaled about (0.5, 0.5), then moved."""
    from math import cos, sin

    u, v = x - 0.5, y - 0.5
    return scale * (cos(angle) * u - sin(angle) * v) + 0.5 + dx, scale * (sin(angle) * u + cos(angle) * v) + 0.5 + dy


def affine_from_points(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float]:
    """The six numbers of the affine map of three points onto three others."""
    import numpy as np

    a = np.array([[x, y, 1.0] for x, y in src])
    return [*np.linalg.solve(a, np.array([p[0] for p in dst])), *np.linalg.solve(a, np.array([p[1] for p in dst]))]


def apply_affine(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


# Lines a x + b y + c = 0 with a^2 + b^2 = 1.


class Line(NamedTuple):
    a: Column
    b: Column
    c: Column


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> Line:
    n = F.hypot(x2 - x1, y2 - y1)
    a, b = (y1 - y2) / n, (x2 - x1) / n
    return Line(a, b, -(a * x1 + b * y1))


def line_distance(m: Line, x: Column, y: Column) -> Column:
    return F.abs(m.a * x + m.b * y + m.c)


def line_foot(m: Line, x: Column, y: Column) -> tuple[Column, Column]:
    d = m.a * x + m.b * y + m.c
    return x - m.a * d, y - m.b * d


def line_meet(m: Line, n: Line) -> tuple[Column, Column]:
    """Where two lines meet; null if parallel."""
    det = m.a * n.b - n.a * m.b
    ok = F.abs(det) > 1e-12
    return F.when(ok, (m.b * n.c - n.b * m.c) / det), F.when(ok, (n.a * m.c - m.a * n.c) / det)


def crop_segment(x1: Column, y1: Column, x2: Column, y2: Column, low: Column, high: Column) -> Column:
    """The part of a segment between two x, as a struct; null if none of it lies there. An upright segment stays whole or goes."""
    dx = x2 - x1
    at = lambda x: F.when(dx == 0, y1).otherwise(y1 + (y2 - y1) * ((x - x1) / F.when(dx != 0, dx)))
    a, b = F.greatest(F.least(x1, x2), low), F.least(F.greatest(x1, x2), high)
    upright = F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))
    cut = F.struct(a.cast("double").alias("x1"), at(a).cast("double").alias("y1"), b.cast("double").alias("x2"), at(b).cast("double").alias("y2"))
    return F.when((dx == 0) & x1.between(low, high), upright).when((dx != 0) & (a < b), cut)


def extend_segment(x1: Column, y1: Column, x2: Column, y2: Column, by: Column | float) -> Column:
    """The segment made longer by ``by`` at both ends, as a struct; a point stays."""
    n = F.hypot(x2 - x1, y2 - y1)
    ux, uy = F.when(n > 0, (x2 - x1) / n * by).otherwise(0.0), F.when(n > 0, (y2 - y1) / n * by).otherwise(0.0)
    return F.struct((x1 - ux).alias("x1"), (y1 - uy).alias("y1"), (x2 + ux).alias("x2"), (y2 + uy).alias("y2"))


def hands(keypoints: Column, least: float = 0.1) -> Column:
    """Wrists (keypoints 9 and 10) seen with at least that confidence."""
    return F.filter(F.slice(keypoints, 10, 2), lambda p: p["c"] >= least)


def event_time(frame: Column, fps: Column | float) -> Column:
    f = fps if isinstance(fps, Column) else F.lit(fps)
    return F.when(f > 0, F.bround(frame / f, 2)).otherwise(0.0)


def clock(seconds: Column) -> Column:
    """MM:SS."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def hue(track: Column) -> Column:
    return (F.abs(track) * 137) % 360
