"""Readers and writers over small files made here."""

import struct

import numpy as np
from pyspark.sql import functions as F

from sheetloom.sources import files, sinks

DXF = """0
SECTION
2
HEADER
9
$INSUNITS
70
4
0
ENDSEC
0
SECTION
2
ENTITIES
0
LINE
8
WALL
62
3
10
0.0
20
0.0
11
10.0
21
5.0
0
LWPOLYLINE
8
ROOM
70
1
10
0
20
0
10
4
20
0
10
4
20
3
0
CIRCLE
8
C
10
1
20
1
40
2
0
TEXT
8
T
10
0
20
0
1
hello
0
ENDSEC
0
EOF
"""


def test_dxf(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    rows = {r.entity_type: r for r in files.read_dxf(spark, str(tmp_path / "a.dxf")).collect()}
    assert set(rows) == {"LINE", "LWPOLYLINE", "CIRCLE", "TEXT"}
    assert rows["LINE"].layer == "WALL" and rows["LINE"].color == 3 and rows["LINE"].unit == "mm"
    assert [(p.x, p.y) for p in rows["LINE"].points] == [(0, 0), (10, 5)]
    assert rows["LWPOLYLINE"].closed and rows["TEXT"].text == "hello"
    edges = files.entity_edges(files.read_dxf(spark, str(tmp_path / "a.dxf")))
    assert {r.layer: r.n for r in edges.groupBy("layer").agg(F.count("*").alias("n")).collect()} == {"WALL": 1, "ROOM": 3, "C": 16}


def test_svg_and_back(spark, tmp_path):
    (tmp_path / "a.svg").write_text('<svg><line x1="1" y1="2" x2="3.5" y2="4" class="w"/><polygon points="0,0 4,0 4,3" style="display:none"/><g/></svg>')
    rows = {r.tag: r for r in files.read_svg(spark, str(tmp_path / "a.svg")).collect()}
    assert rows["line"].numbers == {"x1": 1, "y1": 2, "x2": 3.5, "y2": 4} and not rows["line"].hidden
    assert len(rows["polygon"].points) == 3 and rows["polygon"].hidden
    edges = spark.createDataFrame([("p", 0, "a<b", 0.0, 0.0, 2.0, 1.0), ("p", 1, None, 0.0, 0.0, 1.0, 1.0), ("p", 2, "z", 0.0, 0.0, 1.0, 1.0)], "path string, ord long, layer string, x0 double, y0 double, x1 double, y1 double")
    lines = [r.line for r in sinks.svg_lines(edges, ["a<b"]).orderBy("ord").collect()]
    assert len(lines) == 4 and 'class="a&lt;b"' in lines[1] and lines[-1] == "</svg>"
    out = str(tmp_path / "out")
    sinks.write_text(sinks.dxf_lines(edges), out)
    back = files.read_dxf(spark, f"{out}/*/")
    assert back.count() == 3


def test_stl(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.stl").write_text("solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid")
    one = struct.pack("<12fH", *([0.0] * 3 + list(np.arange(9.0))), 0)
    (tmp_path / "t/b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + one * 2)
    rows = files.read_stl(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 3 and [r.corners for r in rows if r.path.endswith("a.stl")] == [[0, 0, 0, 1, 0, 0, 0, 1, 0]]
    kinds = files.read_files(spark, str(tmp_path / "t"))
    assert {r.kind for r in kinds.collect()} == {"stl"}


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\nbroken\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").cache()
    assert rows.filter("_corrupt_record is null").count() == 2 and rows.count() == 3
    (tmp_path / "l.txt").write_text(" one \n\ntwo\n")
    assert [r.value for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    sinks.write_jsonl(rows.select("a"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 3
