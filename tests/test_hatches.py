"""Hatches of worked files: every boundary kind, areas, nesting, odd pairs."""

import math

import pytest

from sheetloom.sources import hatches


def dxf(*entities):
    pairs = [(0, "SECTION"), (2, "ENTITIES"), *(p for e in entities for p in e), (0, "ENDSEC"), (0, "EOF")]
    return "\n".join(f"{c:>3}\n{v}" for c, v in pairs) + "\n"


def square(a, b):
    return [p for x, y in ((a, a), (b, a), (b, b), (a, b)) for p in ((10, x), (20, y))]


def hatch(*paths, layer="H", solid=0, head=(), tail=()):
    return [(0, "HATCH"), (5, "A1"), (8, layer), (62, 3), (10, 0), (20, 0), (2, "BRICK"), (70, solid), *head, (91, len(paths)), *(p for path in paths for p in path), (75, 0), (76, 1), (52, 45), (41, 2.5), (98, 1), (10, 777), (20, 777), *tail]


@pytest.fixture
def write(tmp_path):
    def put(*entities):
        f = tmp_path / "h.dxf"
        f.write_text(dxf(*entities))
        return str(f)

    return put


def test_kinds_of_whole_boundaries(spark, write):
    polyline = [(92, 1), (72, 0), (73, 1), (93, 4), *square(0, 10)]
    disc = [(92, 1), (73, 1), (93, 2), (10, 0), (20, 0), (42, 1), (10, 10), (20, 0), (42, 1)]
    arc = [(92, 2), (10, 1), (20, 2), (40, 3), (50, 0), (51, 180), (73, 1)]
    ellipse = [(92, 3), (10, 0), (20, 0), (11, 0), (21, 4), (40, 0.5), (50, 0), (51, 360), (73, 1)]
    spline = [(92, 4), (94, 3), (96, 6), (97, 2), *((40, k) for k in (0, 0, 0, 1, 1, 1)), (10, 0), (20, 0), (10, 5), (20, 10), (10, 10), (20, 0)]
    path = write(hatch(polyline), [(0, "LINE"), (8, "x"), (10, 0), (20, 0), (11, 5), (21, 5)], hatch(disc, arc), hatch(ellipse), hatch(spline, layer="S", solid=1), hatch([(92, 9), (10, 1), (20, 1)]), hatch())
    loops = {(r.ord, r.loop): r for r in hatches.hatch_loops(hatches.read_hatch_edges(spark, path, tol=1e-4)).collect()}
    areas = [r.area for _, r in sorted(loops.items())]
    assert areas == [pytest.approx(v, rel=1e-3) for v in (100, 25 * math.pi, 4.5 * math.pi, 8 * math.pi, -100 / 3)]
    rows = sorted(hatches.read_hatches(spark, path, tol=1e-4).collect(), key=lambda r: r.hatch)
    assert [(r.hatch, r.layer, r.color, r.pattern, r.solid_fill, r.scale, r.angle, len(r.boundary_paths)) for r in rows] == [(0, "H", "ACI_3", "BRICK", False, 2.5, 45.0, 1), (1, "H", "ACI_3", "BRICK", False, 2.5, 45.0, 2), (2, "H", "ACI_3", "BRICK", False, 2.5, 45.0, 1), (3, "S", "ACI_3", "BRICK", True, 2.5, 45.0, 1)]
    assert [p.kind for r in rows for p in r.boundary_paths] == ["polyline", "polyline", "arc", "ellipse", "spline"]
    assert [(v.x, v.y, v.bulge) for v in rows[1].boundary_paths[0].vertices] == [(0.0, 0.0, 1.0), (10.0, 0.0, 1.0)]
    assert hatches.read_hatches(spark, path, solid=False).count() == 3


def test_edges_by_flags_and_nested_loops(spark, write):
    half = [(92, 1), (93, 2), (72, 1), (10, -5), (20, 0), (11, 5), (21, 0), (72, 2), (10, 0), (20, 0), (40, 5), (50, 0), (51, 180), (73, 1), (97, 0)]
    back = [(92, 0), (93, 2), (72, 1), (10, 5), (20, 0), (11, -5), (21, 0), (72, 2), (10, 0), (20, 0), (40, 5), (50, 180), (51, 360), (73, 0), (97, 0)]
    mixed = [(92, 16), (93, 2), (72, 4), (94, 2), (95, 6), (96, 3), *((40, k) for k in (0, 0, 0, 1, 1, 1)), (10, 0), (20, 0), (10, 5), (20, -10), (10, 10), (20, 0), (72, 1), (10, 10), (20, 0), (11, 0), (21, 0)]
    nested = [[(92, 2 + k), (72, 0), (73, 1), (93, 4), *square(*s)] for k, s in ((0, (20, 30)), (1, (0, 100)), (16, (10, 50)))]
    path = write(hatch(half), hatch(back), hatch(mixed), hatch(*nested))
    loops = sorted(hatches.hatch_loops(hatches.read_hatch_edges(spark, path, flags=True, tol=1e-4)).collect(), key=lambda r: (r.ord, r.loop))
    assert [r.area for r in loops] == [pytest.approx(v, rel=1e-3) for v in (12.5 * math.pi, -12.5 * math.pi, 100 / 3, 100, 10000, 1600)] and [r.edges for r in loops] == [2, 2, 2, 1, 1, 1]
    rows = sorted(hatches.read_hatches(spark, path, flags=True).collect(), key=lambda r: r.hatch)
    assert rows[-1].area == pytest.approx(10000 - 1600 + 100) and rows[0].area == pytest.approx(12.5 * math.pi, rel=1e-2)


def test_file_without_hatches(spark, write):
    path = write([(0, "LINE"), (8, "x"), (10, 0), (20, 0)])
    assert hatches.read_hatches(spark, path).count() == 0
