"""Queries and operators that SQL does not express, against plain Python on the smallest tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import drawing, evaluation, graphs, metrics, models, raster, scene, selection, sets, spatial, topology, validation
from sheetloom.plans import data_queries, drawing_queries, geometry_queries, scene_queries
from sheetloom.plans.tables import boxes, segments


@pytest.fixture(scope="module")
def segs(spark, sf):
    return {r.id: r for r in segments(spark, sf).collect()}


@pytest.fixture(scope="module")
def box(spark, sf):
    return {r.id: r for r in boxes(spark, sf).collect()}


def iou(a, b):
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    both = max(0, w) * max(0, h)
    return both / max(1e-9, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - both)


def plain_suppress(rows, limit, inclusive=False):
    kept = []
    for r in sorted(rows, key=lambda r: (-r.score, r.id)):
        if not any(iou(r, k) >= limit if inclusive else iou(r, k) > limit for k in kept):
            kept.append(r)
    return {r.id for r in kept}


@pytest.mark.parametrize("most", (4096, 0))
def test_suppression(spark, sf, box, most):
    pages = {p: [r for r in box.values() if r.page == p] for p in {r.page for r in box.values()}}
    got = {r.id for r in selection.suppress(boxes(spark, sf), ["page"], 0.3, most_rows=most).collect()}
    assert got == set().union(*(plain_suppress(x, 0.3) for x in pages.values()))
    groups = {}
    for r in box.values():
        groups.setdefault((r.page, r.label), []).append(r)
    got = {r.id for r in selection.suppress(boxes(spark, sf), ["page", "label"], 0.3, inclusive=True, most_rows=most).collect()}
    assert got == set().union(*(plain_suppress(x, 0.3, True) for x in groups.values()))
    got = {r.id for r in geometry_queries.QUERIES["tk_01_nms"](spark, sf).collect()}
    assert got == set().union(*(plain_suppress(x, 0.3) for x in pages.values()))
    filled = scene_queries.QUERIES["tk_05_diverse"](spark, sf).collect()
    for p, rows in pages.items():
        kept = plain_suppress(rows, 0.3)
        order = sorted(rows, key=lambda r: (r.id not in kept, -r.score, r.id))[:40]
        assert {r.id for r in filled if r.page == p} == {r.id for r in order}


def plain_match(pairs):
    used, out = set(), set()
    for _, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


def test_greedy_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(a), int(b), float(np.round(s, 1))) for g, a, b, s in zip(rng.integers(0, 4, 400), rng.integers(0, 20, 400), rng.integers(0, 20, 400), rng.random(400), strict=True)]
    rows = list({r[:3]: r for r in rows}.values())
    got = selection.match_one_to_one(spark.createDataFrame(rows, "page long, a long, b long, score double"), ["page"]).collect()
    for g in range(4):
        assert {(r.a, r.b) for r in got if r.page == g} == plain_match([r[1:] for r in rows if r[0] == g])


def test_optimal_assignment(spark):
    rng = np.random.default_rng(2)
    for n, m in ((4, 6), (6, 4), (5, 5)):
        cost = rng.integers(0, 50, (n, m))
        rows = [(1, i, j, float(cost[i, j])) for i in range(n) for j in range(m)]
        got = scene.optimal_assignment(spark.createDataFrame(rows, "page long, a long, b long, cost double"), ["page"]).collect()
        short, long = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(short[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(long), min(n, m)))
        assert len(got) == min(n, m) and sum(r.cost for r in got) == best


def test_budget_and_caps(spark, sf, box):
    got = {r.id for r in geometry_queries.QUERIES["tk_07_budget"](spark, sf).collect()}
    kept = {}
    for p in sorted({r.page for r in box.values()}):
        seen, own = {}, []
        for r in sorted((r for r in box.values() if r.page == p), key=lambda r: (-r.score, r.id)):
            seen[r.label] = seen.get(r.label, 0) + 1
            own += [r] if seen[r.label] <= 3 else []
        kept[p] = own[:8]
    left, want = 30, set()
    for p in sorted(kept, key=lambda p: (-sum(r.score for r in kept[p]), p)):
        if len(kept[p]) <= left:
            want |= {r.id for r in kept[p]}
            left -= len(kept[p])
    assert got == want
    got = {r.id for r in drawing_queries.QUERIES["tk_08_multi_cap"](spark, sf).collect()}
    want = set()
    for p in {r.page for r in box.values()}:
        n = {}
        for r in sorted((r for r in box.values() if r.page == p), key=lambda r: (-r.score, r.id)):
            if n.get(("l", r.label), 0) < 4 and n.get(("s", r.id % 3), 0) < 9:
                want.add(r.id)
                for k in (("l", r.label), ("s", r.id % 3)):
                    n[k] = n.get(k, 0) + 1
    assert got == want


def test_hull_and_simplify(spark, sf, segs):
    hull = drawing_queries.QUERIES["ag_20_convex_hull"](spark, sf).collect()
    for layer in {r.layer for r in segs.values()}:
        pts = [(r.x0, r.y0) for r in segs.values() if r.layer == layer]
        own = [(h.x, h.y) for h in sorted((h for h in hull if h.layer == layer), key=lambda h: h.k)]
        assert set(own) <= set(pts)
        for a, b in zip(own, own[1:] + own[:1], strict=True):
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-6 for p in pts)

    def thin(p, tol):
        if len(p) < 3:
            return p
        (ax, ay), (bx, by) = p[0], p[-1]
        n = math.hypot(bx - ax, by - ay)
        far = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / n if n else math.hypot(x - ax, y - ay) for x, y in p[1:-1]]
        k = max(range(len(far)), key=far.__getitem__)
        return thin(p[: k + 2], tol)[:-1] + thin(p[k + 1 :], tol) if far[k] > tol else [p[0], p[-1]]

    got = drawing_queries.QUERIES["sc_11_simplify"](spark, sf).collect()
    for layer in {r.layer for r in segs.values()}:
        pts = [(r.x0, r.y0) for _, r in sorted(segs.items()) if r.layer == layer]
        assert [(g.x, g.y) for g in sorted((g for g in got if g.layer == layer), key=lambda g: g.idx)] == thin(pts, 40.0)


def test_gap_forest(spark, sf, segs):
    """The forest that taking all pairs by distance, and keeping those that join two components, gives."""
    ends = [(i, k, *((r.x0, r.y0), (r.x1, r.y1))[k]) for i, r in segs.items() for k in (0, 1)]
    pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[0], a[1], b[0], b[1]) for a, b in itertools.combinations(sorted(ends), 2) if a[0] != b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 12)
    root = {i: i for i in segs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, a, _, b, _ in pairs:
        if d <= 1e-6:
            root[find(b)] = find(a)
    want = set()
    for d, a, ea, b, eb in pairs:
        if find(a) != find(b):
            root[find(b)] = find(a)
            want.add((a, ea, b, eb))
    got = {(r.a, r.ea, r.b, r.eb) for r in drawing.fill_gaps(segments(spark, sf), 12.0).collect()}
    assert got == want and len(want) > 5


def test_faces_of_squares_and_spurs(spark):
    """Two squares that share a side, one far square with a line sticking into it, and a crossing."""
    lines = [(0, 0, 10, 0), (10, 0, 20, 0), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0), (10, 0, 10, 10), (100, 0, 110, 0), (110, 0, 110, 10), (110, 10, 100, 10), (100, 10, 100, 0), (100, 5, 104, 5)]
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "id long, x0 double, y0 double, x1 double, y1 double")
    edges = graphs.written(topology.graph(topology.split_at_crossings(s)))
    half = graphs.written(topology.half_edges(edges))
    f = sorted((round(r.area, 6), r.n) for r in topology.faces(half).collect())
    assert f == [(-200.0, 6), (-100.0, 5), (100.0, 4), (100.0, 4), (100.0, 7)]
    v = edges.select("u").union(edges.select("v")).distinct().count()
    assert v - edges.count() + len(f) == 2 * 2
    rings = {r.ring_id: r for r in topology.loops(half).collect()}
    assert sorted(round(abs(r.signed_area)) for r in rings.values()) == [100, 100, 100, 100, 200]
    assert all(len(r.points) >= 4 for r in rings.values())


def test_faces_of_a_table(spark, sf, segs):
    """Euler's formula, and inner areas that add up to the outer boundaries'."""
    s = segments(spark, sf)
    edges = graphs.written(topology.graph(topology.split_at_crossings(s, 60.0)))
    f = topology.faces(graphs.written(topology.half_edges(edges))).collect()
    parts = graphs.components(edges.select("u", "v")).select("component").distinct().count()
    nodes = edges.select("u").union(edges.select("v")).distinct().count()
    assert nodes - edges.count() + len(f) == 2 * parts
    assert sum(r.area for r in f) == pytest.approx(0, abs=1e-3)
    assert sum(r.area < 0 for r in f) <= parts


def test_nesting_paths(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)]
    got = {r.ring_id: (r.root_id, r.depth, r.path) for r in graphs.nesting_paths(spark.createDataFrame(rows, "ring_id long, parent_id long")).collect()}
    assert got == {1: (1, 0, []), 2: (1, 1, [1]), 3: (1, 2, [2, 1]), 4: (1, 3, [3, 2, 1]), 5: (5, 0, []), 6: (5, 1, [5])}


def test_nesting_needs_a_larger_ring(spark):
    square = lambda d, a, b: [(float(x), float(y)) for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rows = [(1, 1, square(1, 0, 30)), (1, 2, square(1, 10, 20)), (1, 3, square(1, 14, 16)), (2, 4, square(2, 15, 16))]
    got = {r.ring_id: (r.parent_id, r.depth) for r in graphs.nesting(spark.createDataFrame(rows, "drawing long, ring_id long, points array<struct<x:double,y:double>>")).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (None, 0)}


def test_regions_on_the_grid_equal_the_range_join(spark, sf, monkeypatch):
    s = segments(spark, sf)
    r = spark.createDataFrame([("a", -100.0, -100.0, 0.0, 0.0), ("b", -20.0, -50.0, 90.0, 120.0)], "name string, lo_x double, lo_y double, hi_x double, hi_y double")
    want = sorted((x.name, x.id) for x in spatial.in_regions(s, r).collect())
    monkeypatch.setattr(spatial, "MOST_REGIONS", 1)
    assert sorted((x.name, x.id) for x in spatial.in_regions(s, r).collect()) == want and len(want) > 20


def test_holes(spark):
    sq = lambda a, b: [(float(x), float(y)) for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rows = [(1, 1, sq(0, 30), "outer"), (1, 2, sq(5, 10), "hole"), (1, 3, sq(8, 12), "hole"), (1, 4, sq(25, 33), "hole"), (1, 5, sq(40, 50), "hole")]
    r = spark.createDataFrame(rows, "drawing long, ring_id long, points array<struct<x:double,y:double>>, role string")
    assert sorted((x.code, x.ring_id) for x in validation.check_holes(r).collect()) == [("E004", 5), ("E005", 4), ("E006", 3)]


def test_bow_tie(spark):
    rows = [(1, 1, [(0.0, 0.0), (100.0, 100.0), (100.0, 0.0), (0.0, 100.0)]), (1, 2, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (1, 3, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (5.0, 0.0), (0.0, 9.0)])]
    r = spark.createDataFrame(rows, "drawing long, ring_id long, points array<struct<x:double,y:double>>")
    assert {x.ring_id for x in validation.check_self_intersection(r).collect()} == {1, 3}


def test_greedy_clusters(spark, sf, box):
    got = {(r.page, r.id): r.cluster for r in scene_queries.QUERIES["gr_23_clusters"](spark, sf).collect()}
    families = ["boundary", "boundary", "space", "text", "text"]
    for p in {r.page for r in box.values()}:
        for fam in set(families):
            reps = []
            for r in sorted((r for r in box.values() if r.page == p and families[r.id % 5] == fam), key=lambda r: (-r.score, r.id)):
                near = [(iou(r, k) + 1 / max(1, math.hypot((r.x0 + r.x1 - k.x0 - k.x1) / 2, (r.y0 + r.y1 - k.y0 - k.y1) / 2)), -k.id) for k in reps if iou(r, k) > 0.3]
                assert got[p, r.id] == (-max(near)[1] if near else r.id)
                reps += [] if near else [r]
    at = {(r.page, r.id): r.cluster for r in scene_queries.QUERIES["gr_26_overlap_clusters"](spark, sf).collect()}
    for p in {r.page for r in box.values()}:
        heads = []
        for r in sorted((r for r in box.values() if r.page == p), key=lambda r: r.id):
            k = next((i for i, h in enumerate(heads) if iou(r, h) >= 0.25), len(heads))
            heads += [r] if k == len(heads) else []
            assert at[p, r.id] == k


def test_repairs_take_the_nearest(spark, sf, box):
    nodes, edges = scene_queries._nodes(spark, sf), scene_queries._edges(spark, sf)
    n = {r.id: r for r in nodes.collect()}
    gap = lambda a, b: math.hypot(max(0, a.x0 - b.x1, b.x0 - a.x1), max(0, a.y0 - b.y1, b.y0 - a.y1))
    lone = [r for r in scene.constraint_warnings(nodes, edges).collect() if r.id is not None]
    fit = {"opening_without_wall_relation": lambda x: x.family == "boundary", "room_without_boundary_relation": lambda x: x.family == "boundary", "dimension_text_without_link": lambda x: x.label == "dimension_line"}
    want = set()
    for r in lone:
        near = [(gap(n[r.id], x), x.id) for x in n.values() if x.page == r.page and x.id != r.id and fit[r.warning](x) and gap(n[r.id], x) <= 30]
        want |= {(r.id, min(near)[1])} if near else set()
    assert {(r.source, r.target) for r in scene.repairs(nodes, edges, 30.0).collect()} == want and want


def test_contours_and_lines(spark, segs, sf):
    got = {r.id: r.contour for r in topology.joined_contours(segments(spark, sf), 20.0).collect()}
    assert set(got) == set(segs)
    pairs = drawing.gap_candidates(segments(spark, sf), 20.0, 0.95).select("a", "b").collect()
    assert all(got[r.a] == got[r.b] for r in pairs) and len(set(got.values())) > 1
    row = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * i + 8, 0.0) for i in range(5)] + [(9, 0.0, 50.0, 0.0, 90.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    merged = {r.contour: (r.x0, r.x1, r.n) for r in topology.merged_collinear(row, 3.0).collect()}
    assert merged[0] == (0.0, 48.0, 5) and merged[9][2] == 1
    assert {r.contour: r.dashed for r in topology.line_types(row, 3.0).collect()} == {0: True, 9: False}


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(3)
    x = rng.random(4000)
    d = spark.createDataFrame([(i, float(v), float(v + 0.1 + rng.normal(0, 0.2))) for i, v in enumerate(x)], "id long, base double, other double")
    r = evaluation.bootstrap_interval(d, "base", "id").first()
    assert r.low < x.mean() < r.high and r.deviation == pytest.approx(x.std() / 4000**0.5, rel=0.15)
    p = evaluation.paired_bootstrap(d, "base", "other", "id").first()
    assert p.low < p.delta < p.high and p.chance == 1.0 and p.delta == pytest.approx(0.1, abs=0.02)


def test_samples_and_splits(spark, sf):
    d = spark.range(20_000).withColumnRenamed("id", "k")
    n = {r.split: r["count"] for r in sets.shuffled_split(d, "k", {"dev": 0.1, "locked": 0.2, "train": 0.7}, 7).groupBy("split").count().collect()}
    assert n == {"dev": 2000, "locked": 4000, "train": 14_000}
    w = sets.weighted_sample(d.withColumn("w", F.when(F.col("k") < 10_000, 9.0).otherwise(1.0)), F.col("w"), F.col("k") < 5, "k", 2000, 1).collect()
    assert sum(r.forced for r in w) == 5 and len(w) == 2000 and 0.8 < np.mean([r.k < 10_000 for r in w]) < 0.95
    s = sets.balanced_sample(d.withColumn("l", F.col("k") % 3), "l", "k", 50, 1).groupBy("l").count().collect()
    assert [r["count"] for r in s] == [50] * 3


def test_otsu_and_logistic(spark, sf):
    images = {r.image: np.array(r.grey) for r in drawing_queries._images(spark, sf).collect()}
    for r in raster.otsu(drawing_queries._images(spark, sf)).collect():
        v = images[r.image]
        spread = lambda t: (v <= t).mean() * (v > t).mean() * ((v[v <= t].mean() if (v <= t).any() else 0) - (v[v > t].mean() if (v > t).any() else 0)) ** 2  # noqa: B023, E731
        assert spread(r.threshold) == pytest.approx(max(spread(t) for t in range(255)), rel=1e-9)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    y = rng.random(3000) < 1 / (1 + np.exp(-(x @ [1.5, -2.0])))
    rows, _ = models.standardised(spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, gold int"), ["a", "b"])
    got = models.score_logistic(rows, ["a", "b"], models.fit_logistic(rows, ["a", "b"], "gold")).toPandas().sort_values("id")
    best = ((x @ [1.5, -2.0] > 0) == y).mean()
    assert ((got.score > 0.5).to_numpy() == y).mean() > best - 0.01 and np.corrcoef(got.score, 1 / (1 + np.exp(-(x @ [1.5, -2.0]))))[0, 1] > 0.98


def test_breaker(spark, sf):
    rows = data_queries.QUERIES["stm_07_breaker"](spark, sf).toPandas()
    assert set(rows.state) <= {"closed", "open", "half_open"} and len(rows) > 0


def test_percentile_by_rank(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(np.round(v, 1))) for k, v in zip(rng.integers(0, 5, 500), rng.random(500) * 9, strict=True)]
    d = spark.createDataFrame(rows, "k long, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        for r in metrics.nearest_rank(d, ["k"], "v", q).collect():
            own = sorted(v for k, v in rows if k == r.k)
            assert r.p == own[round((len(own) - 1) * q)]
