"""Readers of drawing and data files as DataFrames; a file's parts become rows before they are parsed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First bytes by format, and the DXF unit codes.
MAGIC = {"89504E47": "png", "FFD8FF": "jpg", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff", "52494646": "webp", "25504446": "pdf"}
INSUNITS = {0: "unspecified", 1: "inch", 2: "foot", 3: "mile", 4: "mm", 5: "cm", 6: "m", 7: "kilometer", 10: "yard", 13: "micron"}
BINARY_DXF = "AutoCAD Binary DXF"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line, blank lines left out; lines that do not parse keep their text in _corrupt_record."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if "_corrupt_record" not in full.names:
        full = full.add("_corrupt_record", T.StringType())
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def file_kind(path: Column, content: Column) -> Column:
    """Kind by extension, else by first bytes, else unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head, found = F.hex(F.substring(content, 1, 8)), F.lit("unknown")
    for magic, kind in MAGIC.items():
        found = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(found)
    return F.when(ext.isin("dxf", "dwg", "pdf", "svg", "stl", "png", "jpg", "bmp", "tiff", "webp"), ext).when(ext == "jpeg", "jpg").when(ext == "tif", "tiff").otherwise(found)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sha256, content) of every file below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", file_kind(F.col("path"), F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("text"))


def read_dxf_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, code, value): the group-code pairs of text DXF files in order."""
    pairs = _texts(spark, path).filter(~F.startswith("text", F.lit(BINARY_DXF))).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"[ \t]*(\d+)[ \t]*\n([^\n]*)(?:\n|$)"), 0)).alias("i", "pair"))
    return pairs.select("path", "i", F.trim(F.substring_index("pair", "\n", 1)).cast("int").alias("code"), F.trim(F.element_at(F.split("pair", "\n"), 2)).alias("value"))


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, section, entity_type, layer, color, handle, text, radius, start_angle, end_angle, closed, unit, points).

    A row for every entity of the ENTITIES section. Pairs become entities by a running count of the
    codes 0; the points of polylines are the codes 10 and 20 in order, other ends the codes 11 and 21.
    unit is the file's $INSUNITS name."""
    pairs = read_dxf_pairs(spark, path)
    w = W.partitionBy("path").orderBy("i")
    marked = pairs.withColumns({
        "ord": F.sum((F.col("code") == 0).cast("int")).over(w),
        "section": F.last(F.when((F.col("code") == 2) & (F.lag("value").over(w) == "SECTION"), F.col("value")), ignorenulls=True).over(w),
        "header": F.last(F.when(F.col("code") == 9, F.col("value")), ignorenulls=True).over(w),
    })
    units = F.create_map(*(F.lit(x) for kv in INSUNITS.items() for x in kv))
    unit = marked.filter("header = '$INSUNITS' and code = 70").groupBy("path").agg(F.first(F.try_element_at(units, F.col("value").try_cast("int"))).alias("unit"))
    body = marked.filter("section = 'ENTITIES'")
    one = lambda code, kind="string": F.min_by(F.when(F.col("code") == code, F.col("value")).try_cast(kind), F.when(F.col("code") == code, F.col("i")))
    every = lambda code: F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == code, F.struct("i", F.col("value").try_cast("double").alias("v"))))), lambda s: s["v"])
    e = body.groupBy("path", "ord", "section").agg(
        one(0).alias("entity_type"), one(8).alias("layer"), one(62, "int").alias("color"), one(5).alias("handle"), one(1).alias("text"), one(40, "double").alias("radius"), one(50, "double").alias("start_angle"), one(51, "double").alias("end_angle"),
        (F.coalesce(one(70, "int"), F.lit(0)).bitwiseAND(F.lit(1)) == 1).alias("closed"), every(10).alias("xs"), every(20).alias("ys"), every(11).alias("xe"), every(21).alias("ye"),
    )
    points = F.arrays_zip(F.concat("xs", "xe").alias("x"), F.concat("ys", "ye").alias("y"))
    out = e.filter("entity_type not in ('SECTION', 'ENDSEC', 'EOF')").join(unit, "path", "left")
    return out.select("path", "ord", "entity_type", "layer", "color", "handle", "text", "radius", "start_angle", "end_angle", "closed", F.coalesce("unit", F.lit("unspecified")).alias("unit"), F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def entity_edges(entities: DataFrame, chords: int = 16) -> DataFrame:
    """(path, ord, layer, k, x0, y0, x1, y1): straight edges of lines and polylines, and chords of circles and arcs."""
    turn = lambda k: F.radians(F.col("a0") + (F.col("a1") - F.col("a0")) * (k / chords))
    arc = F.col("entity_type").isin("CIRCLE", "ARC")
    base = entities.withColumns({"a0": F.when(F.col("entity_type") == "ARC", F.coalesce("start_angle", F.lit(0.0))).otherwise(0.0), "a1": F.when(F.col("entity_type") == "ARC", F.coalesce("end_angle", F.lit(360.0))).otherwise(360.0)})
    base = base.withColumn("a1", F.when(F.col("a1") <= F.col("a0"), F.col("a1") + 360).otherwise(F.col("a1")))
    c = F.try_element_at("points", F.lit(1))
    curve = F.array(*(F.struct((c["x"] + F.col("radius") * F.cos(turn(k))).alias("x"), (c["y"] + F.col("radius") * F.sin(turn(k))).alias("y")) for k in range(chords + 1)))
    ring = F.when(F.col("closed") & F.col("entity_type").isin("LWPOLYLINE", "POLYLINE"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    drawn = base.filter(F.col("entity_type").isin("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC")).withColumn("p", F.when(arc, curve).otherwise(ring)).filter("size(p) > 1")
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    return drawn.select("path", "ord", "layer", F.posexplode(steps).alias("k", "s")).select("path", "ord", "layer", "k", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, tag, id, cls, numbers, points, hidden): shape elements of SVG files.

    numbers is a map of their numeric attributes; points holds those of polylines and polygons."""
    tag = r"<(line|rect|circle|ellipse|polyline|polygon|path|text)\b([^>]*)>"
    e = _texts(spark, path).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(tag), 0)).alias("ord", "e"))
    attr = lambda name: F.regexp_extract("e", rf'\s{name}\s*=\s*"([^"]*)"', 1)
    names = ["x", "y", "x1", "y1", "x2", "y2", "cx", "cy", "r", "rx", "ry", "width", "height"]
    numbers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(attr(n).try_cast("double") for n in names))), lambda k, v: v.isNotNull())
    pairs = F.transform(F.regexp_extract_all(attr("points"), F.lit(r"(-?[\d.]+(?:[eE]-?\d+)?)[\s,]+(-?[\d.]+(?:[eE]-?\d+)?)"), 0), lambda p: F.struct(F.split(p, r"[\s,]+")[0].try_cast("double").alias("x"), F.split(p, r"[\s,]+")[1].try_cast("double").alias("y")))
    hidden = F.col("e").rlike(r'display\s*[:=]\s*"?none|visibility\s*[:=]\s*"?(hidden|collapse)')
    return e.select("path", "ord", F.regexp_extract("e", tag, 1).alias("tag"), attr("id").alias("id"), attr("class").alias("cls"), numbers.alias("numbers"), pairs.alias("points"), hidden.alias("hidden"))


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(path, facet, corners): the triangles of text and binary STL files, corners as nine numbers."""
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("spare", "<u2")])

    def work(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count = int.from_bytes(raw[80:84], "little")
                if len(raw) == 84 + 50 * count:
                    corners = np.frombuffer(raw, kind, count, 84)["corners"].astype(float)
                else:
                    v = [x.split()[1:4] for x in raw.decode("utf-8", "replace").split("\n") if x.split()[:1] == ["vertex"]]
                    corners = np.array(v[: len(v) // 3 * 3], float).reshape(-1, 9)
                for at in range(0, len(corners), 50_000):
                    part = corners[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "facet", "corners"])

    return f.mapInArrow(work, "path string, facet bigint, corners array<double>")


#: DXF release codes.
DXF_RELEASES = {"AC1009": "R12", "AC1012": "R13", "AC1014": "R14", "AC1015": "2000", "AC1018": "2004", "AC1021": "2007", "AC1024": "2010", "AC1027": "2013", "AC1032": "2018"}


def dxf_release(head: Column) -> tuple[Column, Column]:
    """Release by the first six characters, and the trust in it: 1 for a known code, 0.3 for another, 0 for less than six."""
    known = F.create_map(*(F.lit(x) for kv in DXF_RELEASES.items() for x in kv))[F.substring(head, 1, 6)]
    short = F.length(F.coalesce(head, F.lit(""))) < 6
    return F.coalesce(F.when(~short, known), F.lit("unknown")), F.when(short, 0.0).when(known.isNotNull(), 1.0).otherwise(0.3)


def read_dxf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, release, trust, status): every file below path, binary DXF as rejected and text DXF as read."""
    head = F.decode(F.substring("content", 1, 22), "ISO-8859-1")
    f = spark.read.format("binaryFile").load(path).select("path", head.alias("head"), F.decode("content", "ISO-8859-1").alias("text"))
    code = F.regexp_extract("text", r"\$ACADVER\s+1\s+(\S+)", 1)
    release, trust = dxf_release(code)
    binary = F.startswith("head", F.lit(BINARY_DXF))
    return f.select("path", F.when(binary, "unknown").otherwise(release).alias("release"), F.when(binary, 0.0).otherwise(trust).alias("trust"), F.when(binary, "rejected").otherwise("read").alias("status"))


def dxf_report(entities: DataFrame) -> DataFrame:
    """(path, entity_type, layer, n, unit): counts of a drawing's entities by type and layer."""
    return entities.groupBy("path", "entity_type", "layer").agg(F.count("*").alias("n"), F.first("unit").alias("unit"))


def kept_entities(entities: DataFrame, types: list[str] | None = None, texts: bool = True, dimensions: bool = True, hatches: bool = True) -> DataFrame:
    """Entities of the named types, without texts, dimensions or hatches where these are not wanted."""
    kind, ok = F.col("entity_type"), F.lit(True)
    if types:
        ok = ok & kind.isin(types)
    for wanted, names in ((texts, ["TEXT", "MTEXT", "ATTRIB", "ATTDEF"]), (dimensions, ["DIMENSION"]), (hatches, ["HATCH"])):
        ok = ok if wanted else ok & ~kind.isin(names)
    return entities.filter(ok)


def split_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that can be drawn, and the others with the issue: no points, a number that is none, or no radius."""
    bad = F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    round_ = F.col("entity_type").isin("CIRCLE", "ARC") & ~F.coalesce(F.col("radius") > 0, F.lit(False))
    issue = F.when(F.col("entity_type").isin("LINE", "LWPOLYLINE", "CIRCLE", "ARC") & (F.size("points") == 0), "no_points").when(bad, "bad_number").when(round_, "no_radius")
    marked = entities.withColumn("issue", issue)
    return marked.filter("issue is null").drop("issue"), marked.filter("issue is not null")


def text_annotations(entities: DataFrame) -> DataFrame:
    """(path, ord, layer, x, y, height, content): texts of a drawing without their codes."""
    from ..functions.text import plain_mtext

    p = F.try_element_at("points", F.lit(1))
    return entities.filter(F.col("entity_type").isin("TEXT", "MTEXT")).select("path", "ord", "layer", p["x"].alias("x"), p["y"].alias("y"), F.col("radius").alias("height"), plain_mtext(F.col("text")).alias("content"))


def allowed_files(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Files whose kind is in kinds."""
    return files.filter(F.col("kind").isin(kinds))


#: Names of the octave bands in material tables.
BAND_NAMES = {"125": 125, "125_hz": 125, "hz125": 125, "250": 250, "250_hz": 250, "hz250": 250, "500": 500, "500_hz": 500, "hz500": 500, "1000": 1000, "1k": 1000, "1k_hz": 1000, "hz1k": 1000, "2000": 2000, "2k": 2000, "2k_hz": 2000, "hz2k": 2000, "4000": 4000, "4k": 4000, "4k_hz": 4000, "hz4k": 4000}


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """(name, band, alpha) of a TOML table of materials, a small file; a name in brackets after the name is a second name."""
    import re
    import tomllib

    rows = []
    for r in spark.read.text(path, wholetext=True).collect():
        for m in tomllib.loads(r["value"]).get("materials", []):
            other = re.search(r"\(([^)]*)", m["name"])
            for name in {m["name"].lower(), *([other[1].lower()] if other else [])}:
                rows += [(name, BAND_NAMES[k.lower()], float(v)) for k, v in m["absorption_coeffs"].items()]
    return spark.createDataFrame(rows, "name string, band int, alpha double")
