"""Nested SVG documents: transforms, path data, labels, records."""

import math

import pytest

from sheetloom.sources import svg

DOCUMENT = """<svg xmlns="http://www.w3.org/2000/svg" font-size="10"><g class="Floor" transform="translate(100,50)">
<g id="Wall-outer" transform="rotate(90)"><rect x="0" y="0" width="20" height="10"/><g transform="scale(2) translate(1 1)"><circle cx="0" cy="0" r="3" class="column"/></g>
<ellipse cx="0" cy="0" rx="4" ry="2" transform="rotate(45)"/></g>
<g class="Space Kitchen" style="display:none"><polygon points="0,0 1,0 1,1"/></g>
<g class="Space Kitchen"><polygon points="0,0 40,0 40,30"/><text x="5" y="20" class="NameLabel">KIT <tspan>CHEN</tspan></text><path d="M0 0h10v10H0z" class="Door Wall"/></g>
<polyline points="1,1 2,2" class="other"/></g></svg>"""
ALIASES = [("wallouter", "wall", "boundary", 50), ("wall", "wall", "boundary", 50), ("door", "door", "boundary", 60), ("space", "room", "space", 10), ("kitchen", "kitchen", "space", 50), ("column", "column", "symbol", 50), ("namelabel", "dimension_text", "text", 30)]


@pytest.fixture
def read(spark, tmp_path):
    for name, text in (("a", DOCUMENT), ("bad", "<svg><g></svg>"), ("evil", '<!DOCTYPE s [<!ENTITY a "b">]><svg><rect width="1" height="1" class="wall"/></svg>')):
        (tmp_path / f"{name}.svg").write_text(text)
    return svg.read_svg_elements(spark, str(tmp_path))


def test_nested_transforms_give_exact_boxes(read):
    rows = {(r.tag, r.ord): r for r in svg.with_boxes(read).collect()}
    box = {r.tag + str(len([1 for t, o in rows if t == r.tag and o < r.ord])): (r.x0, r.y0, r.x1, r.y1) for r in rows.values()}
    assert box["rect0"] == tuple(map(pytest.approx, (90, 50, 100, 70)))
    assert box["circle0"] == tuple(map(pytest.approx, (98 - 6, 52 - 6, 98 + 6, 52 + 6)))
    half = math.sqrt(8 + 2)
    assert box["ellipse0"] == tuple(map(pytest.approx, (100 - half, 50 - half, 100 + half, 50 + half)))
    assert box["polygon0"] == tuple(map(pytest.approx, (100, 50, 140, 80))) and box["path0"] == tuple(map(pytest.approx, (100, 50, 110, 60)))
    assert len([t for t, _ in rows if t == "polygon"]) == 1 and svg.with_boxes(read, 150.0).filter("tag = 'rect'").count() == 1 and svg.with_boxes(read, 150.0).filter("tag = 'path'").count() == 0


def test_labels_are_inherited_and_assembled(spark, read):
    aliases = spark.createDataFrame(ALIASES, "token string, label string, family string, priority int")
    labelled = svg.with_boxes(svg.with_labels(read, aliases))
    got = {r.tag: (r.label, r.family, r.raw_label) for r in labelled.collect()}
    assert got == {"rect": ("wall", "boundary", "Wall-outer"), "circle": ("column", "symbol", "column"), "ellipse": ("wall", "boundary", "Wall-outer"), "polygon": ("kitchen", "space", "Kitchen"), "text": ("dimension_text", "text", "NameLabel"), "path": ("door", "boundary", "Door"), "polyline": (None, None, None)}
    (r,) = svg.drawing_records(labelled).collect()
    assert [len(x) for x in (r.boundaries, r.rooms, r.symbols, r.texts, r.dimensions)] == [3, 1, 1, 1, 1] and r.texts[0].text == "KIT CHEN" and r.texts[0].font_size == 10
    assert r.label_counts == {"wall": 2, "door": 1, "kitchen": 1, "column": 1, "dimension_text": 1}


def test_path_data():
    points = lambda d: [(round(p.real, 6), round(p.imag, 6)) for p in svg.path_points(d)[0]]
    assert points("M1,2 3,4l1-1H9V0z") == [(1, 2), (3, 4), (4, 3), (9, 3), (9, 0), (1, 2)] and svg.path_points("M0 0h1z")[1] and not svg.path_points("M0 0zm5 5")[1]
    assert points("m1 1 2 0 0 2") == [(1, 1), (3, 1), (3, 3)] and points("5 5") == [] and points("M1 1 L 2") == [(1, 1)] and points(None) == []
    half = svg.path_points("M-5 0A5 5 0 0 1 5 0")[0]
    assert all(abs(p) == pytest.approx(5) for p in half) and min(p.imag for p in half) == pytest.approx(-5) and len(half) == 17
    assert max(p.imag for p in svg.path_points("M-5 0A5 5 0 1 0 5 0")[0]) == pytest.approx(5)
    curve = svg.path_points("M0 0C0 10 10 10 10 0S20-10 20 0Q25 10 30 0T40 0")[0]
    at = {round(p.real, 6): p.imag for p in curve}
    assert at[5.0] == pytest.approx(7.5) and at[15.0] == pytest.approx(-7.5) and at[25.0] == pytest.approx(5) and at[35.0] == pytest.approx(-5)


def test_transforms():
    at = lambda text, x, y: tuple(round(v, 6) for v in (lambda m: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]))(svg.transform_of(text)))
    assert at("rotate(90 10 10)", 20, 10) == (10, 20) and at("translate(5) scale(2,3)", 1, 1) == (7, 3) and at("matrix(1 0 0 1 2 3)", 1, 1) == (3, 4)
    assert at("skewX(45)", 1, 2) == (3, 2) and at("skewY(45)", 2, 1) == (2, 3) and at("nothing(1)", 2, 3) == (2, 3)
