"""Curves as arrays of points: bulged sides, ellipses and splines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
#: A side whose sagitta is under this part of the tolerance is straight; sides of an ellipse at least.
STRAIGHT, LEAST_SIDES = 0.1, 8


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bulge_points(x0: Column, y0: Column, x1: Column, y1: Column, bulge: Column, tol: float) -> Column:
    """Points of the arc between two points whose bulge is the tangent of a quarter of its angle, its chords within tol of it;
    the two points alone where the arc is as good as straight."""
    n = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    straight = (n * F.abs(bulge) / 2 < tol * STRAIGHT) | (F.abs(bulge) < 2 * tol * STRAIGHT / F.greatest(n, F.lit(tol)))
    angle = 4 * F.atan(bulge)
    r = n / 2 / F.abs(F.sin(angle / 2))
    side = F.signum(bulge)
    away = r * F.cos(angle / 2)
    cx, cy = (x0 + x1) / 2 - side * (y1 - y0) / n * away, (y0 + y1) / 2 + side * (x1 - x0) / n * away
    start = F.atan2(y0 - cy, x0 - cx)
    step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - tol / F.greatest(r, F.lit(tol))))
    k = F.greatest(F.lit(1), F.ceil(F.abs(angle) / step)).cast("int")
    arc = F.transform(F.sequence(F.lit(0), k), lambda i: _point(cx + r * F.cos(start + angle * i / k), cy + r * F.sin(start + angle * i / k)))
    return F.when(straight | (n == 0), F.array(_point(x0, y0), _point(x1, y1))).otherwise(arc)


def ellipse_points(cx: Column, cy: Column, mx: Column, my: Column, ratio: Column, start: Column, end: Column, tol: float) -> Column:
    """Points of an ellipse arc, counter-clockwise from start to end degrees; mx, my is half the long axis, ratio the short one's share."""
    major = F.sqrt(mx * mx + my * my)
    minor = major * ratio
    span = F.radians(F.when(end - start <= 0, end - start + 360).otherwise(end - start))
    mean = (major + minor) / 2
    k = F.greatest(F.lit(LEAST_SIDES), F.ceil(mean * span / (2 * F.sqrt(2 * tol * mean)))).cast("int")
    turn = F.atan2(my, mx)

    def at(i):
        a = F.radians(start) + span * i / k
        x, y = major * F.cos(a), minor * F.sin(a)
        return _point(cx + x * F.cos(turn) - y * F.sin(turn), cy + x * F.sin(turn) + y * F.cos(turn))

    return F.transform(F.sequence(F.lit(0), k), at)


def basis(i: int, p: int, t: float, knots: np.ndarray) -> float:
    """Value at t of the spline basis function i of degree p, by its recurrence; the last piece is closed."""
    if p == 0:
        last = knots[i + 1] == knots[-1] and t == knots[-1] and knots[i] < knots[i + 1]
        return 1.0 if knots[i] <= t < knots[i + 1] or last else 0.0
    part = lambda a, b, v: (a / b) * v if b else 0.0
    return part(t - knots[i], knots[i + p] - knots[i], basis(i, p - 1, t, knots)) + part(knots[i + p + 1] - t, knots[i + p + 1] - knots[i + 1], basis(i + 1, p - 1, t, knots))


def spline_point(t: float, p: int, knots: np.ndarray, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    b = np.array([basis(i, p, t, knots) for i in range(len(points))]) * weights
    return b @ points / b.sum()


def _refined(p: int, knots: np.ndarray, points: np.ndarray, weights: np.ndarray, tol: float, depth: int = 12) -> list[np.ndarray]:
    at = lambda t: spline_point(t, p, knots, points, weights)

    def half(a, b, pa, pb, left):
        m = (a + b) / 2
        pm = at(m)
        d = pb - pa
        n = math.hypot(*d)
        off = abs(d[0] * (pm[1] - pa[1]) - d[1] * (pm[0] - pa[0])) / n if n else math.hypot(*(pm - pa))
        if left == 0 or (off <= tol and left < depth):
            return [pb]
        return half(a, m, pa, pm, left - 1) + half(m, b, pm, pb, left - 1)

    inner = np.unique(knots[(knots >= knots[p]) & (knots <= knots[-p - 1])])
    out = [at(inner[0])]
    for a, b in zip(inner, inner[1:], strict=False):
        out += half(a, b, at(a), at(b), depth)
    return out


def spline_points(curves: DataFrame, tol: float) -> DataFrame:
    """(id, points) of curves (id, degree, knots, points, weights): halved until the middle of each piece lies within tol of its
    chord, starting from the knots. Each curve is one row; null weights are ones."""

    def work(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                pts = np.array([(q["x"], q["y"]) for q in r.points], float)
                w = np.ones(len(pts)) if r.weights is None else np.array(r.weights, float)
                out.append([{"x": float(x), "y": float(y)} for x, y in _refined(int(r.degree), np.array(r.knots, float), pts, w, tol)])
            yield pd.DataFrame({"id": f["id"], "points": out})

    return curves.select("id", "degree", "knots", "points", "weights").mapInPandas(work, f"id {curves.schema['id'].dataType.simpleString()}, points {POINTS}")
