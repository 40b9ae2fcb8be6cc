"""Graphs of polylines and their features, by worked cases."""

import math

import pytest

from sheetloom.operators import graph_features as gf


def table(spark, *polylines, drawing=0):
    rows = [(drawing, p, i, float(x), float(y)) for p, line in enumerate(polylines) for i, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, "drawing int, poly int, idx int, x double, y double")


def test_corner_makes_its_ends_adjacent(spark):
    nodes, edges = gf.polyline_graph(table(spark, [(0, 0), (1, 0), (1, 1)]))
    assert [(r.idx, r.kind, r.degree, r.memberships) for r in nodes.orderBy("idx").collect()] == [(0, "L", 2, 1), (1, "midpoint", 2, 1), (2, "L", 2, 1)]
    got = sorted((r.src, r.dst, r.kind) for r in edges.collect())
    assert got == [(0, 1, "line"), (0, 2, "adjacent"), (1, 2, "line")]
    v = {r.idx: r.features for r in gf.node_vectors(nodes).collect()}
    assert v[0] == pytest.approx([0, 0, 0, 1, 0, 0, 0, 0.2, 0.2, 0, 0.1]) and v[1] == pytest.approx([1, 0, 0.5, 0.5, 0, 0, 0, 0.2, 0.2, 0, 0.1])
    e = {(r.src, r.dst): r.features for r in gf.edge_vectors(edges).collect()}
    assert e[0, 1] == pytest.approx([1, 0, 0, 0, 0.001, 1, 0.5, 1, 0, 0, 0])
    half = (math.sqrt(0.5) + 1) / 2
    assert e[0, 2] == pytest.approx([0, 0, 1, 0, math.sqrt(2) / 1000, half, half, 0, 0, 0, 0])
    assert sorted(tuple(r)[1:] for r in gf.coo(edges, True).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_first_point_decides_place_and_kind(spark):
    """A point met first inside a polyline stays a midpoint, one met first as an end takes its degree's kind; shared steps count twice."""
    nodes, edges = gf.polyline_graph(table(spark, [(0, 0), (5, 0), (9, 0)], [(5.0004, 0), (5, 7)], [(0, 0), (5, 0)], [(3, 3)]), 1e-2)
    n = {r.idx: r for r in nodes.collect()}
    assert len(n) == 4 and (n[1].x, n[1].kind, n[1].memberships) == (5.0, "midpoint", 3)
    assert sorted((r.src, r.dst, r.poly) for r in edges.filter("kind = 'line'").collect()) == [(0, 1, 0), (0, 1, 2), (1, 2, 0), (1, 3, 1)]
    assert sorted((r.src, r.dst) for r in edges.filter("kind = 'adjacent'").collect()) == [(0, 2), (0, 3), (2, 3)]
    assert (n[0].degree, n[0].kind) == (4, "X") and (n[2].degree, n[2].kind) == (3, "T")


def test_drawings_stay_apart_and_odd_rows_go(spark):
    rows = table(spark, [(0, 0), (1, 0)]).union(table(spark, [(0, 0), (1, 0), (1, 0)], drawing=1)).union(spark.createDataFrame([(1, 9, 0, None, 1.0), (1, 9, 1, 1.0, 1.0)], "drawing int, poly int, idx int, x double, y double"))
    nodes, edges = gf.polyline_graph(rows)
    assert sorted((r.drawing, r.idx, r.kind) for r in nodes.collect()) == [(0, 0, "endpoint"), (0, 1, "endpoint"), (1, 0, "endpoint"), (1, 1, "midpoint")]
    assert edges.count() == 2
    empty = gf.polyline_graph(rows.limit(0))
    assert empty[0].count() == 0 and gf.node_vectors(empty[0]).count() == 0 and gf.edge_vectors(empty[1]).count() == 0
