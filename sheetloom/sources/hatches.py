"""Hatches of text DXF files: their boundaries as loops of points, and one row a hatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import curves
from ..functions import geometry as g
from .files import read_dxf_pairs

HATCH = ["path", "ord"]
#: Kinds of boundary by number.
KINDS = {1: "polyline", 2: "arc", 3: "ellipse", 4: "spline"}
EDGE_KINDS = {1: "line", 2: "arc", 3: "ellipse", 4: "spline"}
#: Codes that follow a hatch's boundaries.
AFTER = (75, 98)


def _pairs(spark: SparkSession, path: str, flags: bool) -> DataFrame:
    """The pairs of hatches with loop (0 before the first boundary), edge and kind, by running counts in each hatch."""
    w = W.partitionBy("path").orderBy("i")
    p = read_dxf_pairs(spark, path).withColumns({"ord": F.sum((F.col("code") == 0).cast("int")).over(w), "entity": F.last(F.when(F.col("code") == 0, F.upper("value")), ignorenulls=True).over(w)})
    e = W.partitionBy(*HATCH).orderBy("i")
    p = p.filter("entity = 'HATCH'").withColumns({"loop": F.sum((F.col("code") == 92).cast("int")).over(e), "number": F.last(F.when(F.col("code") == 92, F.col("value").try_cast("int")), ignorenulls=True).over(e)})
    p = p.withColumn("after", (F.sum(F.when((F.col("loop") > 0) & F.col("code").isin(*AFTER), 1).otherwise(0)).over(e) > 0))
    names = lambda kinds: F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    own = W.partitionBy(*HATCH, "loop").orderBy("i")
    if not flags:
        return p.withColumns({"edge": F.lit(1).cast("long"), "kind": F.try_element_at(names(KINDS), F.col("number"))})
    whole = F.coalesce(F.col("number").bitwiseAND(2) == 2, F.lit(False))
    starts = (F.col("code") == 72) & ~whole
    edge = F.when(whole, 1).otherwise(F.sum(starts.cast("int")).over(own))
    kind = F.last(F.when(starts, F.col("value").try_cast("int")), ignorenulls=True).over(own)
    return p.withColumns({"edge": edge.cast("long"), "kind": F.when(whole, "polyline").otherwise(F.try_element_at(names(EDGE_KINDS), kind))})


def _first(code: int, kind: str = "double") -> Column:
    own = F.when(F.col("code") == code, F.col("i"))
    return F.min_by(F.when(F.col("code") == code, F.col("value")).try_cast(kind), own)


def _every(code: int) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == code, F.struct("i", F.col("value").try_cast("double").alias("v"))))), lambda s: s["v"])


def _sides(tol: float) -> Column:
    """Points of a polyline of vertices x, y, bulge, closed or not; a side's last point is the next one's first."""
    n = F.size("vertices")
    last = F.when(F.col("closed"), n).otherwise(n - 1)

    def side(k):
        a, b = F.element_at("vertices", k), F.element_at("vertices", k % n + 1)
        return curves.bulge_points(a["x"], a["y"], b["x"], b["y"], a["bulge"], tol)

    one = F.transform("vertices", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return F.when(last >= 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), side))).otherwise(one)


def read_hatch_edges(spark: SparkSession, path: str, flags: bool = False, tol: float = 0.01) -> DataFrame:
    """(path, ord, loop, edge, kind, closed, vertices, points): the boundary edges of all hatches of text DXF files.

    A hatch's boundaries begin with the code 92. Its value is the kind of the whole boundary (1 polyline, 2 arc, 3 ellipse, 4
    spline), or with flags a set of bits of which 2 means a polyline, other boundaries being edges that begin with the code 72 (1
    line, 2 arc, 3 ellipse, 4 spline). points follow the edge with chords within tol; clockwise arcs measure angles
    clockwise. Unknown kinds and edges without a point go."""
    p = _pairs(spark, path, flags).filter("loop > 0 and edge > 0 and kind is not null and not after")
    key = [*HATCH, "loop", "edge", "kind"]
    v = W.partitionBy(*key).orderBy("i")
    p = p.withColumn("vertex", F.sum((F.col("code") == 10).cast("int")).over(v))
    corner = F.struct("vertex", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("bulge", F.lit(0.0)).alias("bulge"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    corners = p.filter("vertex > 0").groupBy(*key, "vertex").agg(_first(10).alias("x"), _first(20).alias("y"), _first(42).alias("bulge"), _first(41).alias("weight")).groupBy(*key).agg(F.array_sort(F.collect_list(corner)).alias("vertices"))
    degree = 94 if flags else 97
    facts = p.groupBy(*key).agg((F.coalesce(_first(73, "int"), F.lit(0)) == 1).alias("closed"), _first(11).alias("x2"), _first(21).alias("y2"), _first(40).alias("r"), _first(50).alias("a0"), _first(51).alias("a1"), F.coalesce(_first(degree, "int"), F.lit(3)).alias("degree"), _every(40).alias("knots"))
    e = facts.join(corners, key)
    c = F.element_at("vertices", 1)
    a0, a1 = F.coalesce("a0", F.lit(0.0)), F.coalesce("a1", F.lit(360.0))
    begin, end = F.when(F.col("closed"), a0).otherwise(-a1), F.when(F.col("closed"), a1).otherwise(-a0)
    mx, my, ratio = F.coalesce("x2", F.lit(1.0)), F.coalesce("y2", F.lit(0.0)), F.coalesce("r", F.lit(1.0))
    turned = lambda points: F.when(F.col("closed"), points).otherwise(F.reverse(points))
    arc = turned(curves.ellipse_points(c["x"], c["y"], ratio, F.lit(0.0), F.lit(1.0), begin, end, tol))
    ellipse = turned(curves.ellipse_points(c["x"], c["y"], mx, my, ratio, begin, end, tol))
    line = F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")), F.struct(F.coalesce("x2", c["x"]).alias("x"), F.coalesce("y2", c["y"]).alias("y")))
    plain = e.filter("kind <> 'spline'").withColumn("points", F.when(F.col("kind") == "polyline", _sides(tol)).when(F.col("kind") == "line", line).when(F.col("kind") == "arc", arc).otherwise(ellipse))
    fit = (F.size("knots") == F.size("vertices") + F.col("degree") + 1) & (F.size("vertices") > F.col("degree"))
    named = e.filter("kind = 'spline'").filter(fit).withColumn("id", F.concat_ws("|", *key))
    spline = curves.spline_points(named.select("id", "degree", "knots", F.transform("vertices", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"), F.transform("vertices", lambda q: q["weight"]).alias("weights")), tol)
    out = [*key, "closed", "vertices", "points"]
    return plain.select(*out).union(named.join(spline, "id").select(*out))


def hatch_loops(edges: DataFrame) -> DataFrame:
    """(path, ord, loop, edges, points, area): each boundary's edges one after the other, and the area they enclose, positive counter-clockwise."""
    rows = edges.groupBy(*HATCH, "loop").agg(F.count("*").alias("edges"), F.array_sort(F.collect_list(F.struct("edge", "points"))).alias("p"))
    rows = rows.withColumn("all", F.flatten(F.transform("p", lambda q: q["points"])))
    kept = F.filter("all", lambda q, k: (k == 0) | (q != F.element_at("all", F.greatest(k, F.lit(1)))))
    return rows.select(*HATCH, "loop", "edges", kept.alias("points")).withColumn("area", g.ring_area(F.col("points")))


def read_hatches(spark: SparkSession, path: str, flags: bool = False, solid: bool = True, tol: float = 0.01) -> DataFrame:
    """(path, ord, hatch, handle, layer, color, pattern, solid_fill, scale, angle, area, boundary_paths): one row a hatch.

    hatch counts a file's hatches from 0. boundary_paths are arrays of kind, closed, vertices and points, in order. area is
    filled by the even-odd rule where loops are nested and do not cross: the sizes of loops at even depth less those at odd
    depth. Hatches without a boundary go, and solid ones too with solid false."""
    head = _pairs(spark, path, flags).filter("loop = 0 or after")
    facts = head.groupBy(*HATCH).agg(_first(5, "string").alias("handle"), _first(8, "string").alias("layer"), F.concat(F.lit("ACI_"), _first(62, "string")).alias("color"), F.coalesce(_first(2, "string"), F.lit("ANSI31")).alias("pattern"), (F.coalesce(_first(70, "int"), F.lit(0)) == 1).alias("solid_fill"), F.coalesce(_first(41), F.lit(1.0)).alias("scale"), F.coalesce(_first(52), F.lit(0.0)).alias("angle"))
    edges = read_hatch_edges(spark, path, flags, tol)
    paths = edges.groupBy(*HATCH).agg(F.transform(F.array_sort(F.collect_list(F.struct("loop", "edge", "kind", "closed", "vertices", "points"))), lambda s: F.struct(s["loop"].alias("loop"), s["kind"].alias("kind"), s["closed"].alias("closed"), s["vertices"].alias("vertices"), s["points"].alias("points"))).alias("boundary_paths"))
    loops = hatch_loops(edges).filter(F.size("points") >= 3)
    first = F.element_at("points", 1)
    other = loops.select(*HATCH, F.col("loop").alias("loop2"), F.col("points").alias("points2"))
    over = loops.join(other, HATCH).filter((F.col("loop") != F.col("loop2")) & g.point_in_ring(first["x"], first["y"], F.col("points2"))).groupBy(*HATCH, "loop").agg(F.count("*").alias("depth"))
    signed = F.abs("area") * F.when(F.coalesce("depth", F.lit(0)) % 2 == 0, 1).otherwise(-1)
    area = loops.join(over, [*HATCH, "loop"], "left").groupBy(*HATCH).agg(F.sum(signed).alias("area"))
    rows = facts.filter(F.lit(solid) | ~F.col("solid_fill")).join(paths, HATCH).join(area, HATCH, "left")
    number = (F.row_number().over(W.partitionBy("path").orderBy("ord")) - 1).alias("hatch")
    return rows.select(*HATCH, number, "handle", "layer", "color", "pattern", "solid_fill", "scale", "angle", F.coalesce("area", F.lit(0.0)).alias("area"), "boundary_paths")
