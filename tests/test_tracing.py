"""Contours, strokes, stroke faces and fits against plain restatements."""

import math
from collections import Counter

import numpy as np
import pytest

from sheetloom.operators import fitting, raster, tracing

WIDTH, HEIGHT = 160, 120


def drawing(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a = np.zeros((HEIGHT, WIDTH), int)
    for _ in range(n):
        x0, y0, x1, y1 = rng.integers(0, [WIDTH, HEIGHT, WIDTH, HEIGHT])
        k = max(abs(int(x1) - int(x0)), abs(int(y1) - int(y0)), 1)
        a[np.rint(np.linspace(y0, y1, k + 1)).astype(int), np.rint(np.linspace(x0, x1, k + 1)).astype(int)] = 255
    return a


def images(spark, arrays):
    return spark.createDataFrame([(i, a.reshape(-1).tolist()) for i, a in enumerate(arrays)], "image long, grey array<int>")


def flood(ink, steps):
    """{first pixel: pixels} of ink's regions, by plain search."""
    seen, out = set(), {}
    for start in zip(*np.nonzero(ink), strict=True):
        if start in seen:
            continue
        todo, own = [start], set()
        while todo:
            p = todo.pop()
            if p in own:
                continue
            own.add(p)
            todo += [q for q in ((p[0] + dr, p[1] + dc) for dr, dc in steps) if 0 <= q[0] < ink.shape[0] and 0 <= q[1] < ink.shape[1] and ink[q] and q not in own]
        seen |= own
        out[start[0] * ink.shape[1] + start[1]] = own
    return out


EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
FOUR = [(-1, 0), (0, 1), (1, 0), (0, -1)]


def test_contours_are_regions_with_their_outer_borders(spark):
    rng = np.random.default_rng(7)
    arrays = [drawing(1, 9), 255 * (rng.random((HEIGHT, WIDTH)) < 0.35), 255 * (rng.random((HEIGHT, WIDTH)) < 0.55), np.zeros((HEIGHT, WIDTH), int), np.full((HEIGHT, WIDTH), 255)]
    got = {}
    for r in tracing.contours(images(spark, arrays), WIDTH, 128, least=40).collect():
        got.setdefault(r.image, {})[r.contour] = r
    for i, a in enumerate(arrays):
        want = {k: v for k, v in flood(a > 128, EIGHT).items() if len(v) >= 40}
        assert {k: r.n for k, r in got.get(i, {}).items()} == {k: len(v) for k, v in want.items()}
        for k, own in want.items():
            mask = np.zeros((HEIGHT + 2, WIDTH + 2), bool)
            for r, c in own:
                mask[r + 1, c + 1] = True
            outside = next(v for v in flood(~mask, FOUR).values() if (0, 0) in v)
            edge = {p for p in own if any((p[0] + 1 + dr, p[1] + 1 + dc) in outside for dr, dc in FOUR)}
            path = [(int(q.y), int(q.x)) for q in got[i][k].border]
            assert set(path) == edge and path[0] == divmod(k, WIDTH)
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(path, path[1:] + path[:1], strict=True))
    assert tracing.contours(images(spark, [255 - arrays[0]]), WIDTH, 128, least=40, dark=True).count() == len(got[0])


@pytest.mark.parametrize("seed", range(6))
def test_strokes_hold_every_pixel_and_link_once(seed):
    rng = np.random.default_rng(seed)
    a = raster.thin(drawing(seed, 12)) if seed < 4 else (rng.random((HEIGHT, WIDTH)) < (0.2, 0.5)[seed - 4]).astype(int)
    link = tracing.links(a)
    degree, inner, pairs = link.sum(axis=0), Counter(), Counter()
    for closed, path in tracing.trace(a):
        ring = closed and degree[path[0]] == 2
        inner.update(path[:-1] if ring else path[1:-1])
        assert ring or (degree[path[0]] != 2 and degree[path[-1]] != 2)
        pairs.update(frozenset(p) for p in zip(path, path[1:], strict=False))
    assert inner == Counter({(int(r), int(c)): 1 for r, c in zip(*np.nonzero(degree == 2), strict=True)})
    want = {frozenset(((int(r), int(c)), (int(r) + tracing.STEPS[k][0], int(c) + tracing.STEPS[k][1]))) for k, r, c in zip(*np.nonzero(link), strict=True)}
    assert pairs == Counter(dict.fromkeys(want, 1))
    assert len(flood(a, EIGHT)) == len({min(p) for p in components(a, want)})


def components(a, pairs):
    near = {}
    for p in pairs:
        u, v = sorted(p)
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out, seen = [], set()
    for p in zip(*map(list, np.nonzero(a)), strict=True):
        p = (int(p[0]), int(p[1]))
        if p in seen:
            continue
        todo, own = [p], set()
        while todo:
            q = todo.pop()
            if q not in own:
                own.add(q)
                todo += near.get(q, ())
        seen |= own
        out.append(own)
    return out


def test_strokes_of_worked_shapes(spark):
    a = np.zeros((HEIGHT, WIDTH), int)
    a[20, 10:51] = a[60, 10:51] = a[20:61, 10] = a[20:61, 50] = 255  # a ring
    a[100, 20:100] = 255
    a[80:120, 60] = 255  # a cross
    rows = tracing.strokes(images(spark, [a]), WIDTH).collect()
    ring = [r for r in rows if r.closed]
    # The corners' diagonals are no links, so a ring is whole.
    assert [(r.n, r.length) for r in ring] == [(159, 160.0)] and sorted(r.length for r in rows if not r.closed) == [19.0, 20.0, 39.0, 40.0]
    refined = tracing.refined_points(images(spark, [a]), spark.createDataFrame([(0, 100, 30), (0, 100, 21), (0, 20, 10)], "image long, r int, c int"), WIDTH).collect()
    assert [(r.x, r.y) for r in refined] == [(30.0, 100.0), (pytest.approx(21.5), 100.0), (pytest.approx(10.6), pytest.approx(20.6))]


def test_faces_obey_euler_and_nest(spark):
    a = np.zeros((HEIGHT, WIDTH), int)

    def box(r0, c0, r1, c1):
        a[r0, c0 : c1 + 1] = a[r1, c0 : c1 + 1] = 255
        a[r0 : r1 + 1, c0] = a[r0 : r1 + 1, c1] = 255

    box(5, 5, 110, 150)
    a[5:111, 80] = 255
    box(20, 15, 90, 70)
    box(30, 25, 50, 60)
    box(60, 100, 70, 110)
    a[65, 120:130] = 255
    arrays = [a, raster.thin(drawing(3, 14)), raster.thin(drawing(4, 25))]
    s = tracing.strokes(images(spark, arrays), WIDTH)
    snapped = tracing.snapped_strokes(s, 0.0)
    f = tracing.stroke_faces(s, 0.0, least_edges=1).collect()
    kept = snapped.collect()
    for i in range(3):
        own = [r for r in f if r.image == i]
        edges = [(r.u, r.v) for r in kept if r.image == i]
        points = {p for e in edges for p in e}
        parts = {r.part for r in own}
        assert len(points) - len(edges) + len(own) == 2 * len(parts)
        assert sum(r.role == "outer" for r in own) == len(parts)
        for part in parts:
            assert sum(r.area for r in own if r.part == part) == pytest.approx(0, abs=1e-6)
        for r in own:
            shoelace = sum(p.x * q.y - q.x * p.y for p, q in zip(r.points, r.points[1:] + r.points[:1], strict=True)) / 2
            assert shoelace == pytest.approx(r.area, abs=1e-6)
    inner = {round(r.area): r for r in f if r.image == 0 and r.role == "inner"}
    assert set(inner) == {105 * 75, 105 * 70, 70 * 55, 20 * 35, 100}
    assert [inner[k].level for k in (7875, 7350, 3850, 700, 100)] == [0, 0, 1, 2, 1]
    assert (inner[3850].parent, inner[700].parent, inner[100].parent) == (inner[7875].face, inner[3850].face, inner[7350].face)
    stick = [r for r in f if r.image == 0 and r.role == "outer" and r.area == 0]
    assert len(stick) == 1 and stick[0].parent == inner[7350].face
    inside = lambda p, ring: sum((a.y > p.y) != (b.y > p.y) and p.x < a.x + (p.y - a.y) / (b.y - a.y) * (b.x - a.x) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1
    for r in f:
        over = [q for q in f if q.image == r.image and q.part != r.part and q.role == "inner" and inside(next(x for x in f if x.part == r.part).points[0], q.points)]
        assert r.level == len(over) and (r.parent is None) == (not over)


def test_snapping_joins_ends(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [(9, 0, False, 0, 100.0, line((0, 0), (50, 1), (100, 0))), (9, 1, False, 0, 100.0, line((101, 0), (100, 100))), (9, 2, False, 0, 100.0, line((100, 101), (0, 100))), (9, 3, False, 0, 100.0, line((0, 101), (0.5, 0.5))), (9, 4, False, 0, 1.0, line((0, 0), (1, 1))), (7, 0, False, 0, 9.0, line((0, 0), (9, 0)))]
    s = spark.createDataFrame(rows, "image long, stroke int, closed boolean, n int, length double, points array<struct<x:double,y:double>>")
    f = tracing.stroke_faces(s).collect()
    assert {(r.image, r.role, r.edges) for r in f} == {(9, "inner", 4), (9, "outer", 4)} and all(9900 < abs(r.area) < 10200 for r in f)
    assert tracing.stroke_faces(s.filter("false")).count() == 0


def test_inversions_count_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 200):
        z = rng.integers(0, 12, n)
        assert fitting.inversions(z) == sum(z[i] >= z[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("grid", [False, True])
def test_median_lines_equal_all_pairs(monkeypatch, grid):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, 90).astype(float) if grid else rng.normal(0, 50, 90)
    y = np.rint(2 * x + rng.integers(-5, 6, 90)) if grid else 0.7 * x + rng.normal(0, 3, 90)
    want = fitting.theil_sen(x, y)
    pairs = sorted((y[j] - y[i]) / (x[j] - x[i]) for i in range(90) for j in range(90) if x[i] < x[j])
    assert want[0] == pairs[len(pairs) // 2]
    monkeypatch.setattr(fitting, "PAIR_POINTS", 10)
    assert fitting.theil_sen(x, y) == (pytest.approx(want[0], abs=1e-9), -1.0, pytest.approx(want[2], abs=1e-9))


def test_median_line_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-100, 100, 60_000)
    y = 3 * x - 7 + rng.normal(0, 1, 60_000)
    y[:15_000] = rng.uniform(-900, 900, 15_000)
    a, b, c = fitting.theil_sen(x, y)
    assert a == pytest.approx(3, abs=0.02) and c == pytest.approx(-7, abs=0.5)
    assert fitting.theil_sen(np.array([2.0, 2.0]), np.array([1.0, 5.0])) == (1.0, 0.0, -2.0) and fitting.theil_sen(x[:1], y[:1]) is None


def test_fits_choose_the_right_primitive(spark):
    rng = np.random.default_rng(11)
    t = np.linspace(0, 1, 80)
    shapes = {"line": (100 * t, 20 + 30 * t), "arc": (50 + 40 * np.cos(3 * t), 60 + 40 * np.sin(3 * t)), "bezier": (90 * t * (1 - t) ** 2 + 270 * (1 - t) * t * t + 100 * t**3, 240 * t * (1 - t) ** 2 - 240 * (1 - t) * t * t)}
    rows = [(name, k, float(px + rng.normal(0, 0.05)), float(py + rng.normal(0, 0.05))) for name, (xs, ys) in shapes.items() for k, (px, py) in enumerate(zip(xs, ys, strict=True))]
    rows += [("two", 0, 0.0, 0.0), ("two", 1, 3.0, 4.0), ("one", 0, 1.0, 1.0), ("same", 0, 1.0, 1.0), ("same", 1, 1.0, 1.0), ("none", 0, None, 1.0)]
    rows += [("ring", k, 10 + 5 * math.cos(k), 20 + 5 * math.sin(k)) for k in range(40)] + [("ring", 40 + k, float(k), 90.0) for k in range(15)]
    p = spark.createDataFrame(rows, "shape string, k int, x double, y double")
    got = {(r["shape"], r.kind): r for r in fitting.primitive_fits(p, "shape").collect()}
    assert {s: k for (s, k), r in got.items() if r.best and s != "ring"} == {"line": "line", "arc": "arc", "bezier": "bezier", "two": "line", "same": "line"}
    assert got["arc", "arc"]["values"] == [pytest.approx(v, abs=0.1) for v in (50, 60, 40)] and got["bezier", "bezier"].rms < 0.1
    for r in got.values():
        fit = r.n * math.log(2 * math.pi * (r.rms**2 + 1e-10)) + r.n
        k = {"line": 2, "arc": 3, "bezier": 6}[r.kind]
        assert r.score == pytest.approx(0.7 * (2 * k + fit) + 0.3 * (k * math.log(r.n) + fit))
    ring = {r["shape"]: r for r in fitting.circle_fits(p, "shape", 0.5).collect()}["ring"]
    assert ring.inliers == 40 and (ring.cx, ring.cy, ring.r) == (pytest.approx(10), pytest.approx(20), pytest.approx(5))
    lines = {r["shape"]: r for r in fitting.line_fits(p, "shape").collect()}
    assert lines["line"].a == pytest.approx(0.3, abs=0.01) and lines["two"].a == pytest.approx(4 / 3) and "one" not in lines
