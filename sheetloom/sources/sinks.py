"""Writers: JSON lines, single reports, SVG and DXF text, split datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """An aggregate of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_dataset(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def scaled(points, factor: float):
    """An array of structs x, y times factor."""
    return F.transform(points, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def svg_lines(edges: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """(path, ord, line): SVG text of each drawing, header first; a null layer passes the layer filter."""
    e = edges.filter(F.col("layer").isNull() | F.col("layer").isin(layers)) if layers is not None else edges
    box = e.groupBy("path").agg(F.min(F.least("x0", "x1")).alias("a"), F.min(F.least("y0", "y1")).alias("b"), F.max(F.greatest("x0", "x1")).alias("c"), F.max(F.greatest("y0", "y1")).alias("d"))
    num = lambda c: F.format_string("%.4f", c)
    head = box.select("path", F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), F.concat_ws(" ", num(F.col("a")), num(F.col("b")), num(F.col("c") - F.col("a")), num(F.col("d") - F.col("b"))), F.lit('">')).alias("line"))
    body = e.select("path", F.col("ord").cast("bigint").alias("ord"), F.concat(F.lit('<line class="'), xml_escape(F.coalesce("layer", F.lit(""))), *(x for n, c in (("x1", "x0"), ("y1", "y0"), ("x2", "x1"), ("y2", "y1")) for x in (F.lit(f'" {n}="'), num(F.col(c)))), F.lit('"/>')).alias("line"))
    foot = box.select("path", F.lit((1 << 62)).cast("bigint").alias("ord"), F.lit("</svg>").alias("line"))
    return head.union(body).union(foot)


def dxf_lines(edges: DataFrame) -> DataFrame:
    """(path, ord, line): a text DXF of LINE entities for each drawing."""
    num = lambda c: F.format_string("%.6f", c)
    names = edges.select("path").distinct()
    head = names.select("path", F.lit(-1).cast("bigint").alias("ord"), F.lit("0\nSECTION\n2\nENTITIES").alias("line"))
    pairs = [F.lit("0\nLINE\n8"), F.coalesce("layer", F.lit("0")), *(x for code, c in ((10, "x0"), (20, "y0"), (11, "x1"), (21, "y1")) for x in (F.lit(str(code)), num(F.col(c))))]
    body = edges.select("path", F.col("ord").cast("bigint").alias("ord"), F.concat_ws("\n", *pairs).alias("line"))
    foot = names.select("path", F.lit(1 << 62).cast("bigint").alias("ord"), F.lit("0\nENDSEC\n0\nEOF").alias("line"))
    return head.union(body).union(foot)


def write_text(lines: DataFrame, path: str) -> None:
    """(path, ord, line) as one folder of text for each drawing, sorted within it."""
    lines.repartition("path").sortWithinPartitions("path", "ord").select(F.xxhash64("path").alias("drawing"), F.col("line").alias("value")).write.mode("overwrite").partitionBy("drawing").text(path)


#: Version of the scene documents.
SCENE_VERSION = "1.0"


def scene_documents(rings: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(drawing, document): one JSON text for each drawing with its version, outer ring, holes and boundaries. A drawing is one row."""
    outer = rings.filter("role = 'outer'").groupBy("drawing").agg(F.min_by("points", "ring_id").alias("outer"))
    holes = rings.filter("role = 'hole'").groupBy("drawing").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "points"))), lambda h: h["points"]).alias("holes"))
    sides = boundaries.groupBy("drawing").agg(F.array_sort(F.collect_list(F.struct(*[c for c in boundaries.columns if c != "drawing"]))).alias("boundaries"))
    j = outer.join(holes, "drawing", "full").join(sides, "drawing", "left")
    return j.select("drawing", F.to_json(F.struct(F.lit(SCENE_VERSION).alias("version"), "outer", "holes", "boundaries")).alias("document"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, ord, line): GraphML text of each graph's nodes (path, id, x, y) and edges (path, source, target, kind)."""
    names = nodes.select("path").distinct()
    at = lambda df, ord_, line: df.select("path", ord_.cast("bigint").alias("ord"), line.alias("line"))
    keys = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="x" for="node" attr.name="x" attr.type="double"/>\n<key id="y" for="node" attr.name="y" attr.type="double"/>\n<key id="kind" for="edge" attr.name="kind" attr.type="string"/>\n<graph edgedefault="undirected">'
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml_escape(F.col(c).cast("string")), F.lit("</data>"))
    quoted = lambda c: xml_escape(F.col(c).cast("string"))
    node = F.concat(F.lit('<node id="'), quoted("id"), F.lit('">'), data("x", "x"), data("y", "y"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), quoted("source"), F.lit('" target="'), quoted("target"), F.lit('">'), data("kind", "kind"), F.lit("</edge>"))
    return at(names, F.lit(-1), F.lit(keys)).union(at(nodes, F.lit(0), node)).union(at(edges, F.lit(1), edge)).union(at(names, F.lit(2), F.lit("</graph>\n</graphml>")))


def markdown_table(df: DataFrame) -> str:
    """An aggregate of few rows as a Markdown table."""
    rows = df.collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line([cell(v) for v in r]) for r in rows)])
