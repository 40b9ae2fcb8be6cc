"""Scan repair against its definitions, pixel by pixel, and a perspective undone."""

import math

import numpy as np
import pytest

from sheetloom.operators import scans


def table(spark, *arrays):
    return spark.createDataFrame([(i, a.reshape(-1).tolist()) for i, a in enumerate(arrays)], "image long, grey array<int>")


def test_non_local_means_is_its_definition(spark):
    a = np.random.default_rng(1).integers(0, 60, (9, 13))
    got = np.array(scans.non_local_means(table(spark, a), 13, 30.0).first().grey).reshape(9, 13)
    for y in range(9):
        for x in range(13):
            total = weight = 0.0
            for ny in range(max(y - 2, 0), min(max(y - 2, 0) + 5, 9)):
                for nx in range(max(x - 2, 0), min(max(x - 2, 0) + 5, 13)):
                    off = 0
                    for py in range(3):
                        for px in range(3):
                            q = (max(y - 1, 0) + py, max(x - 1, 0) + px, max(ny - 1, 0) + py, max(nx - 1, 0) + px)
                            if q[0] < 9 and q[2] < 9 and q[1] < 13 and q[3] < 13:
                                off += int(a[q[0], q[1]] - a[q[2], q[3]]) ** 2
                    w = math.exp(-off / 900)
                    total, weight = total + w * a[ny, nx], weight + w
            assert abs(got[y, x] - total / weight) <= 1 and got[y, x] <= total / weight + 1e-3


def test_local_contrast_by_tiles(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(90, 140, (120, 160))
    out = np.array(scans.local_contrast(table(spark, a), 160, 4.0, 50).first().grey).reshape(120, 160)
    for i in range(0, 120, 50):
        for j in range(0, 160, 50):
            part = a[i : i + 50, j : j + 50].reshape(-1).tolist()
            most = int(4.0 * len(part) / 256)
            n = [part.count(g) for g in range(256)]
            more = sum(max(0, k - most) for k in n) // 256
            n = [min(min(k, most) + more, most) for k in n]
            run = np.cumsum(n)
            want = np.floor(run[a[i : i + 50, j : j + 50]] / max(run[-1], 1) * 255)
            assert np.abs(out[i : i + 50, j : j + 50] - want).max() <= 1
    flat = scans.equalised(a, 4.0, 200, False)
    assert (scans.equalised(a, 4.0, 200, True) == flat).all() and out.std() > a.std()
    ramp = scans.equalised(np.tile(np.arange(160), (120, 1)), 40.0, 40, True)
    assert np.abs(np.diff(ramp, axis=1)).max() < 30


def test_known_perspective_is_undone(spark):
    h, w = 120, 160
    quad = np.array([(30, 14), (139, 24), (150, 104), (12, 96)], float)
    u, v = 90, 70  # the paper's own size
    to_paper = scans.homography(quad, np.array([(0, 0), (u, 0), (u, v), (0, v)], float))
    y, x = np.indices((h, w))
    q = to_paper @ np.stack([x.reshape(-1), y.reshape(-1), np.ones(h * w)])
    px, py = (q[:2] / q[2]).reshape(2, h, w)
    inside = (px >= -1e-9) & (py >= -1e-9) & (px <= u + 1e-9) & (py <= v + 1e-9)
    a = np.where(inside, np.rint(150 + px * 0.6 + py * 0.4), 20).astype(int)
    found = {r.image: r for r in scans.papers(table(spark, a, np.full((h, w), 9)), w).collect()}
    assert set(found) == {0} and found[0].kind == "quad"
    assert np.abs(np.array([(c.x, c.y) for c in found[0].corners]) - quad).max() <= 2
    exact = spark.createDataFrame([(0, [tuple(p) for p in quad.tolist()])], "image long, corners array<struct<x:double,y:double>>")
    rows = {r.image: r for r in scans.corrected(table(spark, a, a), exact, w).collect()}
    flat = np.array(rows[0].grey).reshape(rows[0].height, rows[0].width)
    assert (rows[0].width, rows[0].height) == (round(math.hypot(138, 8)), round(math.hypot(11, 80)) if math.hypot(11, 80) > math.hypot(18, 82) else round(math.hypot(18, 82)))
    fy, fx = np.indices(flat.shape)
    want = 150 + fx / (flat.shape[1] - 1) * u * 0.6 + fy / (flat.shape[0] - 1) * v * 0.4
    assert np.abs(flat - want)[2:-2, 2:-2].max() <= 1 and rows[1].grey == a.reshape(-1).tolist()


def test_erased_boxes(spark):
    a = np.zeros((20, 30), int)
    boxes = spark.createDataFrame([(0, 5, 6, 7, 9), (0, 19, 29, 19, 29)], "image long, r0 int, c0 int, r1 int, c1 int")
    got = {r.image: np.array(r.grey).reshape(20, 30) for r in scans.erased(table(spark, a, a), boxes, 30).collect()}
    want = a.copy()
    want[3:10, 4:12] = want[17:, 27:] = 255
    assert (got[0] == want).all() and not got[1].any()
    assert pytest.approx(got[0].sum()) == 255 * (7 * 8 + 9)
