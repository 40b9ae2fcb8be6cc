"""Reports of drawings, scene documents, graph text and material tables on files of a few lines."""

import json

from pyspark.sql import functions as F

from sheetloom.sources import files, sinks

DXF = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1015\n9\n$INSUNITS\n70\n4\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nA-WALL\n10\n0\n20\n0\n11\n5\n21\n0\n0\nCIRCLE\n8\nX\n10\n1\n20\n1\n0\nMTEXT\n8\nT\n10\n2\n20\n3\n40\n2.5\n1\nRoom\\P1\n0\nENDSEC\n0\nEOF\n"


def test_dxf_reports(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    (tmp_path / "b.dxf").write_bytes(b"AutoCAD Binary DXF\r\n\x1a\x00rest")
    got = {r.path[-5:]: (r.release, r.trust, r.status) for r in files.read_dxf_files(spark, str(tmp_path)).collect()}
    assert got == {"a.dxf": ("2000", 1.0, "read"), "b.dxf": ("unknown", 0.0, "rejected")}
    e = files.read_dxf(spark, str(tmp_path / "a.dxf"))
    assert {(r.entity_type, r.layer, r.n, r.unit) for r in files.dxf_report(e).collect()} == {("LINE", "A-WALL", 1, "mm"), ("CIRCLE", "X", 1, "mm"), ("MTEXT", "T", 1, "mm")}
    good, bad = files.split_entities(e)
    assert good.count() == 2 and [(r.entity_type, r.issue) for r in bad.collect()] == [("CIRCLE", "no_radius")]
    t = files.text_annotations(e).first()
    assert (t.x, t.y, t.height, t.content) == (2.0, 3.0, 2.5, "Room\n\n1")
    assert files.kept_entities(e, texts=False).count() == 2 and files.kept_entities(e, ["LINE"]).count() == 1
    release, trust = files.dxf_release(F.col("c"))
    d = spark.createDataFrame([("AC1032",), ("AC9999",), ("AC",)], "c string").select(release.alias("r"), trust.alias("t"))
    assert [(r.r, r.t) for r in d.collect()] == [("2018", 1.0), ("unknown", 0.3), ("unknown", 0.0)]
    assert files.allowed_files(files.read_files(spark, str(tmp_path)), ["dxf"]).count() == 2


def test_scene_and_graph_text(spark):
    ring = "drawing long, ring_id long, points array<struct<x:double,y:double>>, role string"
    r = spark.createDataFrame([(1, 2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "outer"), (1, 4, [(0.2, 0.2)], "hole"), (1, 3, [(0.1, 0.1)], "hole")], ring)
    doc = json.loads(sinks.scene_documents(r, spark.createDataFrame([(1, "door")], "drawing long, semantic string")).first().document)
    assert doc["version"] == "1.0" and len(doc["outer"]) == 3 and [h[0]["x"] for h in doc["holes"]] == [0.1, 0.2] and doc["boundaries"] == [{"semantic": "door"}]
    g = sinks.graphml_lines(spark.createDataFrame([("g", "a<", 0.0, 1.0), ("g", "b", 2.0, 3.0)], "path string, id string, x double, y double"), spark.createDataFrame([("g", "a<", "b", "line")], "path string, source string, target string, kind string"))
    import xml.etree.ElementTree as ET

    tree = ET.fromstring("\n".join(x.line for x in g.orderBy("ord").collect()))
    assert [n.get("id") for n in tree.iter("{http://graphml.graphdrawing.org/xmlns}node")] == ["a<", "b"]
    assert sinks.markdown_table(spark.createDataFrame([(1, 0.5, None)], "a long, b double, c string")) == "| a | b | c |\n| - | - | - |\n| 1 | 0.5 |  |"


def test_materials(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[materials]]\nname = "Concrete (混凝土)"\nabsorption_coeffs = { "125_hz" = 0.01, "1k" = 0.03 }\n')
    got = {(r.name, r.band, r.alpha) for r in files.read_materials(spark, str(tmp_path / "m.toml")).collect()}
    assert got == {(n, b, a) for n in ("concrete (混凝土)", "混凝土") for b, a in ((125, 0.01), (1000, 0.03))}
