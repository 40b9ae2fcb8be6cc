"""Curves, skeletons and mask boxes against plain numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.functions import curves
from sheetloom.operators import raster
from sheetloom.plans import drawing_queries


def test_bulge_is_an_arc(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 1.0), (0.0, 0.0, 10.0, 0.0, -0.5), (0.0, 0.0, 10.0, 0.0, 0.0)], "x0 double, y0 double, x1 double, y1 double, b double")
    half, flat, line = (r.p for r in d.select(curves.bulge_points(*map(F.col, ("x0", "y0", "x1", "y1", "b")), 0.01).alias("p")).collect())
    assert all(math.hypot(q.x - 5, q.y) == pytest.approx(5) for q in half) and half[len(half) // 2].y < -4
    assert (half[0].x, half[-1].x) == (pytest.approx(0), pytest.approx(10)) and max(q.y for q in flat) == pytest.approx(2.5, abs=0.01) and len(line) == 2


def test_spline(spark):
    assert sum(curves.basis(i, 2, 0.3, np.array([0, 0, 0, 0.5, 1, 1, 1.0])) for i in range(4)) == pytest.approx(1)
    w = math.sqrt(0.5)
    d = spark.createDataFrame([(1, 2, [0.0, 0.0, 0.0, 1.0, 1.0, 1.0], [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [1.0, w, 1.0])], "id long, degree int, knots array<double>, points array<struct<x:double,y:double>>, weights array<double>")
    p = curves.spline_points(d, 1e-4).first().points
    assert all(math.hypot(q.x, q.y) == pytest.approx(1) for q in p) and 8 < len(p) < 200
    assert all(math.hypot((a.x + b.x) / 2, (a.y + b.y) / 2) > 1 - 5e-4 for a, b in zip(p, p[1:], strict=False))


@pytest.mark.parametrize("way", ("zhang_suen", "guo_hall"))
def test_skeletons_are_thin_and_whole(way):
    rng = np.random.default_rng(2)

    def parts(a):
        seen, n = set(), 0
        for q in zip(*np.nonzero(a), strict=True):
            n += q not in seen
            todo = [] if q in seen else [q]
            while todo:
                r, c = todo.pop()
                if (r, c) not in seen and 0 <= r < a.shape[0] and 0 <= c < a.shape[1] and a[r, c]:
                    seen.add((r, c))
                    todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        return n

    bar = np.zeros((12, 30), int)
    bar[4:9, 3:27] = 1
    t = raster.thin(bar, way)
    assert (t <= bar).all() and parts(t) == 1 and t.sum() < 32 and not (t[:-1, :-1] & t[1:, :-1] & t[:-1, 1:] & t[1:, 1:]).any()
    for _ in range(20):
        a = np.kron((rng.random((5, 5)) < 0.5).astype(int), np.ones((4, 4), int))
        s = raster.thin(a, way)
        assert (s <= a).all() and parts(s) <= parts(a)


def test_junctions_and_spurs(spark):
    a = np.zeros((7, 9), int)
    a[3, 1:8] = 1
    a[0:3, 4] = 1
    d = spark.createDataFrame([(1, a.reshape(-1).tolist())], "image long, grey array<int>")
    kinds = {(r.r, r.c): r.kind for r in raster.junctions(d, 9).collect()}
    assert kinds[3, 1] == kinds[3, 7] == kinds[0, 4] == "end" and any(k in ("T", "X") for k in kinds.values())
    assert sum(raster.without_spurs(d, 9, 3).first().grey) < a.sum()


def test_mask_boxes(spark, sf):
    got = drawing_queries.QUERIES["ra_34_mask_boxes"](spark, sf).collect()
    assert got and all(2 <= r.n <= 40 and r.n <= (r.r1 - r.r0 + 1) * (r.c1 - r.c0 + 1) for r in got)


def test_clipped_segments(spark):
    """Points along a segment lie in the box if and only if they lie between the ends of its clipped part."""
    import random

    from sheetloom.functions import geometry as g

    rng = random.Random(8)
    box, rows = [2.0, 3.0, 8.0, 7.0], []
    for i in range(300):
        p = [float(rng.randint(0, 10)) for _ in range(4)]
        rows.append((i, *(p if i % 3 else [p[0], p[1], p[0], p[3]])))
    d = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.p for r in d.select("id", g.clip_segment(*map(F.col, ("x0", "y0", "x1", "y1")), box).alias("p")).collect()}
    assert sum(p is None for p in got.values()) > 50
    for i, x0, y0, x1, y1 in rows:
        inside = [k / 840 for k in range(841) if 2 - 1e-9 <= x0 + (x1 - x0) * k / 840 <= 8 + 1e-9 and 3 - 1e-9 <= y0 + (y1 - y0) * k / 840 <= 7 + 1e-9]
        if got[i] is None:
            assert not inside
        else:
            at = lambda t: (x0 + (x1 - x0) * t, y0 + (y1 - y0) * t)  # noqa: E731, B023
            step = max(abs(x1 - x0), abs(y1 - y0)) / 840 + 1e-9
            p = got[i]
            assert 2 - 1e-9 <= min(p.x0, p.x1) and max(p.x0, p.x1) <= 8 + 1e-9 and 3 - 1e-9 <= min(p.y0, p.y1) and max(p.y0, p.y1) <= 7 + 1e-9
            if inside:
                assert max(abs(a - b) for a, b in zip((p.x0, p.y0, p.x1, p.y1), (*at(inside[0]), *at(inside[-1])), strict=True)) <= step


def test_faces_by_tiles(spark, sf, monkeypatch):
    """Faces and rings traced in many small tiles are those of half-edges followed in rounds, and few files are written."""
    from pathlib import Path

    from sheetloom.operators import graphs, topology
    from sheetloom.plans.tables import segments

    s = segments(spark, sf).filter("id < 120")
    pieces = graphs.written(topology.split_at_crossings(s, 60.0))
    half = graphs.written(topology.half_edges(graphs.written(topology.graph(pieces))))
    monkeypatch.setattr(topology, "TILE_EDGES", 100)
    got, want = ({r.face: r for r in f.collect()} for f in (topology.faces_of(pieces), topology.faces(half)))
    assert {k: r.n for k, r in got.items()} == {k: r.n for k, r in want.items()}
    assert all(abs(got[k].area - r.area) < 1e-6 for k, r in want.items())
    got, want = ({r.ring_id: r for r in f.collect()} for f in (topology.loops_of(pieces, 1e-3, 0.5), topology.loops(half, 0.5)))
    place = lambda r: [(round(p.x, 6), round(p.y, 6)) for p in r.points]
    assert {k: place(r) for k, r in got.items()} == {k: place(r) for k, r in want.items()}
    assert all(abs(got[k].signed_area - r.signed_area) < 1e-6 for k, r in want.items())
    assert topology.faces_of(pieces.limit(0)).count() == topology.loops_of(pieces.limit(0)).count() == 0
    monkeypatch.undo()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    import __spark_entry__ as entry

    assert entry.queries()["gr_06_faces"](spark, sf).count() > 20_000
    assert size() - before < 20_000_000


def test_numbers_in_the_order_of_their_text():
    import numpy as np

    from sheetloom.operators.topology import _text_order

    v = np.array([0, -1, 1, 9, 10, 11, 12, 99, 100, 101, 110, 119, 1000, -10, -11, -100, -9, 123456789, 12345678, -123456789, 999999999999, 10**12])
    assert [int(v[i]) for i in np.argsort(_text_order(v))] == sorted(map(int, v), key=lambda k: f"{k}:")
