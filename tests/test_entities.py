"""Drawings with curves and nested blocks as edges, against plain Python."""

import math

import pytest

from sheetloom.sources import entities


def write(folder, blocks, drawn):
    pairs = [(0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, 4), (0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS")]
    for name, base, rows in blocks:
        pairs += [(0, "BLOCK"), (8, "0"), (2, name), (70, 0), (10, base[0]), (20, base[1]), *(p for r in rows for p in r), (0, "ENDBLK"), (8, "0")]
    pairs += [(0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), *(p for r in drawn for p in r), (0, "ENDSEC"), (0, "EOF")]
    (folder / "a.dxf").write_text("".join(f"{c}\n{v}\n" for c, v in pairs))
    return str(folder)


def line(x0, y0, x1, y1, layer="L"):
    return [(0, "LINE"), (8, layer), (10, x0), (20, y0), (11, x1), (21, y1)]


def insert(name, x, y, sx=None, sy=None, turn=None, layer="I"):
    return [(0, "INSERT"), (8, layer), (2, name), (10, x), (20, y), *([(41, sx)] if sx is not None else []), *([(42, sy)] if sy is not None else []), *([(50, turn)] if turn is not None else [])]


def lengths(spark, folder, tol):
    out = {}
    for r in entities.drawn_edges(entities.read_dxf_parts(spark, folder), tol).collect():
        out.setdefault(r.layer, []).append(math.hypot(r.x1 - r.x0, r.y1 - r.y0))
    return {k: (len(v), sum(v)) for k, v in out.items()}


def test_curves_have_their_lengths(spark, tmp_path):
    half = [(0, "LWPOLYLINE"), (8, "BULGE"), (90, 2), (70, 1), (10, 0), (20, 0), (42, 1), (10, 10), (20, 0), (42, 1)]
    old = [(0, "POLYLINE"), (8, "OLD"), (66, 1), (70, 1), (10, 0), (20, 0), *((c, v) for x, y in ((0, 0), (3, 0), (3, 4)) for c, v in ((0, "VERTEX"), (8, "OLD"), (10, x), (20, y))), (0, "SEQEND"), (8, "OLD")]
    ellipse = [(0, "ELLIPSE"), (8, "ELL"), (10, 5), (20, 5), (11, 0), (21, 4), (40, 1.0), (41, 0), (42, math.pi)]
    arc = [(0, "ARC"), (8, "ARC"), (10, 0), (20, 0), (40, 2), (50, 270), (51, 90)]
    circle = [(0, "CIRCLE"), (8, "CIRCLE"), (10, 0), (20, 0), (40, 3)]
    spline = [(0, "SPLINE"), (8, "SPL"), (70, 8), (71, 1), *((40, k) for k in (0, 0, 1, 2, 2)), *((c, v) for x, y in ((0, 0), (1, 0), (1, 2)) for c, v in ((10, x), (20, y)))]
    broken = [(0, "SPLINE"), (8, "BAD"), (71, 3), (40, 0), (10, 0), (20, 0)]
    flat = [[(0, "CIRCLE"), (8, "BAD"), (10, 0), (20, 0), (40, 0)], [(0, "LWPOLYLINE"), (8, "BAD"), (10, 1), (20, 1)], [(0, "LINE"), (8, "BAD"), (10, 1), (20, 1)], line(1, 1, 1, 1, "BAD"), insert("NONE", 0, 0, layer="BAD"), [(0, "TEXT"), (8, "BAD"), (10, 0), (20, 0), (1, "VERTEX")]]
    got = lengths(spark, write(tmp_path, [], [half, old, ellipse, arc, circle, spline, broken, *flat]), 1e-3)
    assert {k: v[1] for k, v in got.items()} == pytest.approx({"BULGE": 10 * math.pi, "OLD": 12, "ELL": 4 * math.pi, "ARC": 2 * math.pi, "CIRCLE": 6 * math.pi, "SPL": 3}, rel=1e-3)
    assert got["OLD"][0] == 3 and got["BULGE"][0] > 30


def restated(blocks, drawn, base):
    """Edges of lines under nested references, by recursion."""
    defs = {name: (b, rows) for name, b, rows in blocks}

    def of(rows, way, m):
        out = []
        for r in rows:
            v = dict(r)
            if v[0] == "LINE":
                at = lambda x, y: (m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])
                out.append((v[8], *at(v[10], v[20]), *at(v[11], v[21])))
            elif v[2] in defs and v[2] not in way:
                b, inner = defs[v[2]]
                t, sx, sy = math.radians(v.get(50, 0)), v.get(41, 1), v.get(42, 1)
                bx, by = b if base else (0, 0)
                n = [sx * math.cos(t), -sy * math.sin(t), 0, sx * math.sin(t), sy * math.cos(t), 0]
                n[2], n[5] = v[10] - n[0] * bx - n[1] * by, v[20] - n[3] * bx - n[4] * by
                k = [m[0] * n[0] + m[1] * n[3], m[0] * n[1] + m[1] * n[4], m[0] * n[2] + m[1] * n[5] + m[2], m[3] * n[0] + m[4] * n[3], m[3] * n[1] + m[4] * n[4], m[3] * n[2] + m[4] * n[5] + m[5]]
                out += of(inner, (*way, v[2]), k)
        return out

    return sorted(tuple(round(c, 6) + 0.0 if isinstance(c, float) else c for c in e) for e in of(drawn, (), [1, 0, 0, 0, 1, 0]))


@pytest.mark.parametrize("base", [False, True])
def test_nested_blocks(spark, tmp_path, base):
    old = ("DOOR", (0, 0), [line(9, 9, 99, 99, "replaced")])
    blocks = [old, ("DOOR", (1, 2), [line(0, 0, 1, 0, "leaf"), line(1, 0, 1, 3, "leaf"), insert("ROOM", 5, 5)]), ("ROOM", (-2, 0), [line(0, 0, 10, 0, "wall"), insert("DOOR", 4, 0, 2, 0.5, 30), insert("DOOR", 8, 1, -1), insert("ROOM", 1, 1), insert("GONE", 0, 0)])]
    drawn = [line(0, 0, 1, 1, "top"), insert("ROOM", 100, 50, turn=90), insert("DOOR", 7, 7, 3, 3), insert("ROOM", 0, 0, 0.1, -0.2, -45), insert("GONE", 1, 1)]
    parts = entities.read_dxf_parts(spark, write(tmp_path, blocks, drawn))
    bases = entities.read_dxf_bases(spark, str(tmp_path))
    got = entities.drawn_edges(parts, 0.1, bases if base else None).collect()
    assert sorted((r.layer, *(round(r[c], 6) + 0.0 for c in ("x0", "y0", "x1", "y1"))) for r in got) == [tuple(float(c) if not isinstance(c, str) else c for c in e) for e in restated(blocks, drawn, base)]
    assert {r.depth for r in got} == {0, 1, 2}


def test_empty_drawing(spark, tmp_path):
    assert entities.drawn_edges(entities.read_dxf_parts(spark, write(tmp_path, [], [])), 0.1).count() == 0
