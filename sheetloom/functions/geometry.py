"""Geometry as column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c; its sign is the orientation."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def orientation(ax, ay, bx, by, cx, cy, eps: float = 0.0) -> Column:
    """1, 0 or -1. Where the double result is within eps of zero, decimals decide exactly."""
    d = cross(ax, ay, bx, by, cx, cy)
    exact = cross(*(c.cast("decimal(18,6)") for c in (ax, ay, bx, by, cx, cy)))
    return F.when(F.abs(d) > eps, F.signum(d)).otherwise(F.signum(exact.cast("double"))).cast("int")


def ring_area(points: Column) -> Column:
    """Signed shoelace area of an array of structs x, y; positive is counter-clockwise.

    Places are taken from the first point, so the digits of a ring far from zero are not lost, and a box has the product of its sides."""
    n = F.size(points)
    first = F.try_element_at(points, F.lit(1))
    off = lambda p, c: p[c] - first[c]
    after = lambda i, c: off(F.element_at(points, (i + 1) % n + 1), c)
    pair = lambda p, i: off(p, "x") * after(i, "y") - after(i, "x") * off(p, "y")
    return F.aggregate(F.transform(points, pair), F.lit(0.0), lambda a, v: a + v) / 2


def ring_perimeter(points: Column) -> Column:
    n = F.size(points)
    side = lambda p, i: distance(p["x"], p["y"], F.element_at(points, (i + 1) % n + 1)["x"], F.element_at(points, (i + 1) % n + 1)["y"])
    return F.aggregate(F.transform(points, side), F.lit(0.0), lambda a, v: a + v)


def compactness(area: Column, perimeter: Column) -> Column:
    return F.try_divide(F.lit(4 * 3.141592653589793) * F.abs(area), perimeter * perimeter)


def point_in_ring(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule with half-open edges."""
    n = F.size(points)

    def crosses(p, i):
        q = F.element_at(points, (i + 1) % n + 1)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"]) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(points, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def on_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies on a side of a ring; decimals of six digits decide, as orientation does near zero."""
    n = F.size(points)

    def on(p, i):
        q = F.element_at(points, (i + 1) % n + 1)
        inside = (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
        return inside & (orientation(p["x"], p["y"], q["x"], q["y"], x, y, 1e-6) == 0)

    return F.exists(F.transform(points, on), lambda v: v)


def closest_on_segment(px, py, x0, y0, x1, y1) -> tuple[Column, Column]:
    """Nearest point of a segment, its parameter kept within 0 and 1."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x0 + t * dx, y0 + t * dy


def intersection(ax, ay, bx, by, cx, cy, dx, dy, closed: bool = True, eps: float = 1e-10) -> Column:
    """Struct x, y where segments ab and cd meet, else null. closed: touching counts; parallels never meet."""
    d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    safe = F.when(F.abs(d) > eps, d)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / safe
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / safe
    inside = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) if closed else (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return F.when(inside, F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def overlap_1d(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def interval_overlap_ratio(a0, a1, b0, b1) -> Column:
    """Overlap over the shorter interval."""
    return F.coalesce(F.try_divide(overlap_1d(a0, a1, b0, b1), F.least(a1 - a0, b1 - b0)), F.lit(0.0))


def box_area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def box_intersection(a: list[Column], b: list[Column]) -> Column:
    return overlap_1d(a[0], a[2], b[0], b[2]) * overlap_1d(a[1], a[3], b[1], b[3])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes given as x0, y0, x1, y1."""
    both = box_intersection(a, b)
    return both / F.greatest(F.lit(1e-9), box_area(*a) + box_area(*b) - both)


def containment(inner: list[Column], outer: list[Column]) -> Column:
    return box_intersection(inner, outer) / F.greatest(F.lit(1e-9), box_area(*inner))


def box_within(inner: list[Column], outer: list[Column]) -> Column:
    """Whether a box lies in another one, sides that touch included."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def centre(box: list[Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def centre_covered(inner: list[Column], outer: list[Column], margin: float = 2.0) -> Column:
    x, y = centre(inner)
    return (x >= outer[0] - margin) & (x <= outer[2] + margin) & (y >= outer[1] - margin) & (y <= outer[3] + margin)


def box_gap(a: list[Column], b: list[Column]) -> Column:
    """Distance between two boxes, 0 where they touch or overlap."""
    gap = lambda i: F.greatest(F.lit(0.0), a[i] - b[i + 2], b[i] - a[i + 2])
    return F.sqrt(gap(0) * gap(0) + gap(1) * gap(1))


def wasserstein_similarity(a: list[Column], b: list[Column], scale: float = 32.0) -> Column:
    """exp(-W/scale) of the boxes as Gaussians: centre and half-size distances."""
    ca, cb = centre(a), centre(b)
    d2 = (ca[0] - cb[0]) ** 2 + (ca[1] - cb[1]) ** 2 + (((a[2] - a[0]) - (b[2] - b[0])) / 2) ** 2 + (((a[3] - a[1]) - (b[3] - b[1])) / 2) ** 2
    return F.exp(-F.sqrt(d2) / scale)


def expand_box(box: list[Column], by: Column) -> list[Column]:
    return [box[0] - by, box[1] - by, box[2] + by, box[3] + by]


def clip_box(box: list[Column], page: list[Column]) -> list[Column]:
    return [F.greatest(box[0], page[0]), F.greatest(box[1], page[1]), F.least(box[2], page[2]), F.least(box[3], page[3])]


def union_box(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def box_orientation(box: list[Column]) -> Column:
    return F.when(box[2] - box[0] >= box[3] - box[1], "horizontal").otherwise("vertical")


def adjacent_boxes(a: list[Column], b: list[Column], gap: float = 4.0, overlap: float = 0.03) -> Column:
    """Near on both axes, and sharing a part of the shorter side on one of them."""
    near = lambda i: F.greatest(a[i] - b[i + 2], b[i] - a[i + 2]) <= gap
    side = lambda i: interval_overlap_ratio(a[i], a[i + 2], b[i], b[i + 2]) >= overlap
    return near(0) & near(1) & (side(0) | side(1))


def direction_class(dx: Column, dy: Column, tol: float = 1e-6) -> Column:
    return F.when(F.abs(dy) <= tol, "horizontal").when(F.abs(dx) <= tol, "vertical").otherwise("sloped")


def apply_affine(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """2x3 matrix in rows."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def compose_affine(m: list[float], n: list[float]) -> list[float]:
    """First n, then m."""
    return [m[0] * n[0] + m[1] * n[3], m[0] * n[1] + m[1] * n[4], m[0] * n[2] + m[1] * n[5] + m[2], m[3] * n[0] + m[4] * n[3], m[3] * n[1] + m[4] * n[4], m[3] * n[2] + m[4] * n[5] + m[5]]


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def aic(rms: Column, n: Column, k: int) -> Column:
    return 2 * k + n * F.log(2 * 3.141592653589793 * (rms * rms + 1e-10)) + n


def softmax(values: Column) -> Column:
    """Shares of exp(value) of an array, stable for large values."""
    top = F.array_max(values)
    up = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(up, F.lit(0.0), lambda a, v: a + v)
    return F.transform(up, lambda v: v / total)


def incircle(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """1 where d lies inside the circle through the counter-clockwise a, b, c, 0 on it, -1 outside; each is (x, y)."""
    (ax, ay), (bx, by), (cx, cy) = ((p[0] - d[0], p[1] - d[1]) for p in (a, b, c))
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return F.signum(det).cast("int")


def orient3d(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Side of the plane a, b, c that d lies on, as 1, 0 or -1; each is (x, y, z)."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (tuple(u - v for u, v in zip(p, d, strict=True)) for p in (a, b, c))
    return F.signum(ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)).cast("int")


def checked_box(values: Column) -> Column:
    """Four numbers as an array of doubles, else null."""
    return F.when((F.size(values) == 4) & ~F.exists(values, lambda v: v.try_cast("double").isNull()), F.transform(values, lambda v: v.try_cast("double")))


def on_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column, tol: float) -> Column:
    """Whether a point lies on a segment, ends included: twice the area it spans with it is tol at most, and it is within tol of its box."""
    area = (px - x0) * (y1 - y0) - (py - y0) * (x1 - x0)
    inside = lambda p, a, b: (p >= F.least(a, b) - tol) & (p <= F.greatest(a, b) + tol)
    return inside(px, x0, x1) & inside(py, y0, y1) & (F.abs(area) <= tol)


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: list[float]) -> Column:
    """The part of a segment within a box, as a struct x0, y0, x1, y1, touching included; null where they do not meet.

    Shares of the segment between the box's sides are cut with each other; a segment along an axis lies between that
    axis' sides as a whole or not at all."""

    def between(p: Column, d: Column, lo: float, hi: float) -> tuple[Column, Column]:
        a, b = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        return F.when(d != 0, F.least(a, b)).when(p.between(lo, hi), 0.0).otherwise(2.0), F.when(d != 0, F.greatest(a, b)).otherwise(1.0)

    dx, dy = x1 - x0, y1 - y0
    (ex, lx), (ey, ly) = between(x0, dx, box[0], box[2]), between(y0, dy, box[1], box[3])
    enter, leave = F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)
    whole = lambda t, own, other, d: F.when(t == 1, other).otherwise(own + d * t)
    return F.when(enter <= leave, F.struct(whole(enter, x0, x1, dx).alias("x0"), whole(enter, y0, y1, dy).alias("y0"), whole(leave, x0, x1, dx).alias("x1"), whole(leave, y0, y1, dy).alias("y1")))
