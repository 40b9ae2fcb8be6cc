"""Drawings of text DXF files as edges: bulged polylines, ellipses and splines as chords, block references placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import graphs
from .files import read_dxf_pairs

#: Entities that bound others, and those whose points come from their own rows.
FRAMES = ("SECTION", "ENDSEC", "EOF", "BLOCK", "ENDBLK", "SEQEND")
POLYLINES = ("LWPOLYLINE", "POLYLINE")
KEYS = ("path", "ord")


def read_dxf_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, block, entity_type, layer, closed, points, bulges, x2, y2, name, numbers, knots, weights, degree): a row
    for every entity of the ENTITIES section (block null) and of block definitions (block their name).

    points holds the codes 10 and 20 in order, those of a POLYLINE its VERTEX rows'; bulges the code 42 of each point, 0
    where it has none. x2, y2 are the codes 11 and 21; numbers maps the codes 40, 41, 42, 50 and 51 to their first values;
    knots and weights are all codes 40 and 41, degree is code 71. Of blocks with one name in a file the last one counts.
    A file is read as one row, so its pairs are ordered in one task."""
    w = W.partitionBy("path").orderBy("i")
    code, value = F.col("code"), F.col("value")
    last = lambda test, out: F.last(F.when(test, out), ignorenulls=True).over(w)
    pairs = read_dxf_pairs(spark, path)
    marked = pairs.withColumns({
        "ord": F.sum((code == 0).cast("int")).over(w),
        "section": last((code == 2) & (F.lag("code").over(w) == 0) & (F.lag("value").over(w) == "SECTION"), value),
        "kind": last(code == 0, value),
        "point": F.sum((code == 10).cast("int")).over(w),
    }).filter("section in ('BLOCKS', 'ENTITIES')")
    vertex = F.col("kind") == "VERTEX"
    marked = marked.withColumns({
        "own": last((code == 0) & (value != "VERTEX"), F.col("ord")),
        "block": F.when(F.col("section") == "BLOCKS", last((F.col("kind") == "BLOCK") & (code == 2), value)),
        "block_ord": F.when(F.col("section") == "BLOCKS", last(F.col("kind") == "BLOCK", F.col("ord"))),
    })
    marked = graphs.written(marked.withColumn("vertex", vertex))
    plain = marked.filter(~F.col("vertex") & ~F.col("kind").isin(*FRAMES))
    first = lambda c, kind="double": F.min_by(F.when(code == c, value).try_cast(kind), F.when(code == c, F.col("i")))
    every = lambda c: F.transform(F.array_sort(F.collect_list(F.when(code == c, F.struct("i", value.try_cast("double").alias("v"))))), lambda s: s["v"])
    numbers = F.map_filter(F.create_map(*(x for c in (40, 41, 42, 50, 51) for x in (F.lit(c), first(c)))), lambda k, v: v.isNotNull())
    rows = plain.groupBy("path", "own", "block", "block_ord").agg(
        F.first("kind").alias("entity_type"), first(8, "string").alias("layer"), first(2, "string").alias("name"), (F.coalesce(first(70, "int"), F.lit(0)).bitwiseAND(F.lit(1)) == 1).alias("closed"),
        first(11).alias("x2"), first(21).alias("y2"), numbers.alias("numbers"), every(40).alias("knots"), every(41).alias("weights"), first(71, "int").alias("degree"),
    )
    # A POLYLINE's own code 10 is a dummy; its points are those of its vertices.
    shown = marked.filter(code.isin(10, 20, 42) & (F.col("vertex") | ((F.col("kind") != "POLYLINE") & ~F.col("kind").isin(*FRAMES))))
    at = shown.groupBy("path", "own", "point").agg(first(10).alias("x"), first(20).alias("y"), F.coalesce(first(42), F.lit(0.0)).alias("bulge"))
    points = at.filter("x is not null and y is not null").groupBy("path", "own").agg(F.array_sort(F.collect_list(F.struct("point", "x", "y", "bulge"))).alias("p"))
    named = rows.groupBy("path", "block").agg(F.max("block_ord").alias("newest"))
    kept = rows.join(named, (rows["path"] == named["path"]) & rows["block"].eqNullSafe(named["block"])).select(rows["*"], "newest").filter("block_ord is null or block_ord = newest")
    p = F.coalesce("p", F.array().cast("array<struct<point:bigint,x:double,y:double,bulge:double>>"))
    return kept.join(points, ["path", "own"], "left").select(
        "path", F.col("own").alias("ord"), "block", "entity_type", "layer", "closed", F.transform(p, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"),
        F.transform(p, lambda q: q["bulge"]).alias("bulges"), "x2", "y2", "name", "numbers", "knots", "weights", "degree",
    )


def read_dxf_bases(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, base_x, base_y): base points of block definitions, of one name in a file the last one's."""
    w = W.partitionBy("path").orderBy("i")
    code, value = F.col("code"), F.col("value")
    marked = read_dxf_pairs(spark, path).withColumns({"ord": F.sum((code == 0).cast("int")).over(w), "kind": F.last(F.when(code == 0, value), ignorenulls=True).over(w)})
    first = lambda c, kind: F.min_by(F.when(code == c, value).try_cast(kind), F.when(code == c, F.col("i")))
    blocks = marked.filter("kind = 'BLOCK'").groupBy("path", "ord").agg(first(2, "string").alias("block"), first(10, "double").alias("base_x"), first(20, "double").alias("base_y"))
    newest = blocks.filter("block is not null").groupBy("path", "block").agg(F.max_by(F.struct("base_x", "base_y"), "ord").alias("b"))
    return newest.select("path", "block", "b.base_x", "b.base_y")


def _sides(tol: float) -> Column:
    """Points along a polyline: each side's arc without its first point, after the first point of all."""
    n = F.size("points")
    sides = F.when(F.col("closed"), n).otherwise(n - 1)
    p = lambda i: F.element_at("points", (i % n + 1).cast("int"))

    def side(i):
        a, b = p(i), p(i + 1)
        arc = curves.bulge_points(a["x"], a["y"], b["x"], b["y"], F.element_at("bulges", i + 1), tol)
        return F.slice(arc, 2, F.size(arc))

    return F.concat(F.slice("points", 1, 1), F.flatten(F.transform(F.sequence(F.lit(0), sides - 1), side)))


def shapes(parts: DataFrame, tol: float = 0.1) -> DataFrame:
    """(path, ord, block, layer, points): what the entities of parts draw, as points to be joined in their order.

    Lines, polylines with bulges, circles, arcs, ellipses and splines, chords within tol; circles without a positive radius,
    ellipses without axes, splines whose knots do not fit their points, polylines of one point and other entities draw nothing."""
    kind, c = F.col("entity_type"), F.try_element_at("points", F.lit(1))
    number = lambda k, other=None: F.coalesce(F.try_element_at("numbers", F.lit(k)), F.lit(other).cast("double"))
    keep = ["path", "ord", "block", "layer"]
    lines = parts.filter((kind == "LINE") & (F.size("points") > 0) & F.col("x2").isNotNull() & F.col("y2").isNotNull()).select(*keep, F.array(c, F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("points"))
    polylines = parts.filter(kind.isin(*POLYLINES) & (F.size("points") > 1)).select(*keep, _sides(tol).alias("points"))
    circle = kind.isin("CIRCLE", "ARC")
    major = F.sqrt(F.col("x2") * F.col("x2") + F.col("y2") * F.col("y2"))
    round_ = parts.filter((F.size("points") > 0) & ((circle & (number(40) > 0)) | ((kind == "ELLIPSE") & (major > 0) & (number(40) > 0))))
    ring = curves.ellipse_points(
        c["x"], c["y"], F.when(circle, number(40)).otherwise(F.col("x2")), F.when(circle, 0.0).otherwise(F.col("y2")), F.when(circle, 1.0).otherwise(number(40)),
        F.when(kind == "CIRCLE", 0.0).when(kind == "ARC", number(50, 0.0)).otherwise(F.degrees(number(41, 0.0))), F.when(kind == "CIRCLE", 360.0).when(kind == "ARC", number(51, 360.0)).otherwise(F.degrees(number(42, 6.283185307179586))), tol,
    )
    rings = round_.select(*keep, ring.alias("points"))
    n = F.size("points")
    fit = (kind == "SPLINE") & (F.col("degree") > 0) & (n > F.col("degree")) & (F.size("knots") == n + F.col("degree") + 1)
    name = F.concat_ws(":", F.col("ord").cast("string"), "path")
    splines = parts.filter(fit).withColumn("id", name)
    drawn = curves.spline_points(splines.select("id", "degree", "knots", "points", F.when(F.size("weights") == n, F.col("weights")).alias("weights")), tol).withColumnRenamed("points", "drawn")
    bent = splines.join(drawn, "id").select(*keep, F.when(F.col("closed"), F.concat("drawn", F.slice("drawn", 1, 1))).otherwise(F.col("drawn")).alias("points"))
    return lines.unionByName(polylines).unionByName(rings).unionByName(bent)


def _placed(about_base: bool) -> list[Column]:
    """Matrix a, b, c, d, e, f of an INSERT: scale, then turn, then move; missing and non-finite scales are 1."""
    number = lambda k, other: F.coalesce(F.try_element_at("numbers", F.lit(k)), F.lit(other))
    scale = lambda k: F.when(F.isnan(number(k, 1.0)) | (F.abs(number(k, 1.0)) == float("inf")), 1.0).otherwise(number(k, 1.0))
    c, turn = F.try_element_at("points", F.lit(1)), F.radians(number(50, 0.0))
    sx, sy, cos, sin = scale(41), scale(42), F.cos(turn), F.sin(turn)
    a, b, d, e = sx * cos, -sy * sin, sx * sin, sy * cos
    bx, by = (F.coalesce("base_x", F.lit(0.0)), F.coalesce("base_y", F.lit(0.0))) if about_base else (F.lit(0.0), F.lit(0.0))
    return [a, b, c["x"] - a * bx - b * by, d, e, c["y"] - d * bx - e * by]


MATRIX = ("ma", "mb", "mc", "md", "me", "mf")


def placed_shapes(drawn: DataFrame, parts: DataFrame, bases: DataFrame | None = None, limit: int = 32) -> DataFrame:
    """(path, ord, ref, depth, layer, points): drawn shapes at the place of every reference to their block.

    Shapes of no block stay, with depth 0 and ref null. Each INSERT of the drawing places the shapes of its block, and of
    blocks inside that, ord being the INSERT's and ref the shape's own; a block on the way down is not entered again, a
    missing block draws nothing. A level of references is one join on file and block and is written once, at most limit
    levels. Blocks' base points count only where bases (path, block, base_x, base_y) gives them."""
    inserts = parts.filter((F.col("entity_type") == "INSERT") & F.col("name").isNotNull() & (F.size("points") > 0))
    if bases is not None:
        inserts = inserts.join(bases.withColumnRenamed("block", "name"), ["path", "name"], "left")
    inserts = graphs.written(inserts.select("path", "ord", "block", "name", *(m.alias(c) for c, m in zip(MATRIX, _placed(bases is not None), strict=True))))
    drawn = graphs.written(drawn.select("path", "ord", "block", "layer", "points"))
    out = drawn.filter("block is null").select("path", "ord", F.lit(None).cast("long").alias("ref"), F.lit(0).alias("depth"), "layer", "points")
    level = inserts.filter("block is null").select("path", "ord", "name", F.array("name").alias("way"), *MATRIX)
    inside = drawn.filter("block is not null").select("path", F.col("block").alias("name"), F.col("ord").alias("ref"), "layer", "points")
    nested = inserts.filter("block is not null").select("path", F.col("block").alias("name"), F.col("name").alias("child"), *(F.col(m).alias(f"n{m}") for m in MATRIX))
    for depth in range(1, limit + 1):
        level = graphs.written(level)
        if level.isEmpty():
            return out
        move = lambda p: F.struct((F.col("ma") * p["x"] + F.col("mb") * p["y"] + F.col("mc")).alias("x"), (F.col("md") * p["x"] + F.col("me") * p["y"] + F.col("mf")).alias("y"))
        out = out.union(level.join(inside, ["path", "name"]).select("path", "ord", "ref", F.lit(depth).alias("depth"), "layer", F.transform("points", move).alias("points")))
        m, n = (lambda c: F.col(f"m{c}")), (lambda c: F.col(f"nm{c}"))
        both = {"ma": m("a") * n("a") + m("b") * n("d"), "mb": m("a") * n("b") + m("b") * n("e"), "mc": m("a") * n("c") + m("b") * n("f") + m("c"), "md": m("d") * n("a") + m("e") * n("d"), "me": m("d") * n("b") + m("e") * n("e"), "mf": m("d") * n("c") + m("e") * n("f") + m("f")}
        down = level.join(nested, ["path", "name"]).filter(~F.array_contains("way", F.col("child")))
        level = down.select("path", "ord", F.col("child").alias("name"), F.concat("way", F.array("child")).alias("way"), *(v.alias(c) for c, v in both.items()))
    if not level.isEmpty():
        raise ValueError(f"block references are nested deeper than {limit} levels")
    return out


def drawn_edges(parts: DataFrame, tol: float = 0.1, bases: DataFrame | None = None) -> DataFrame:
    """(path, ord, ref, depth, layer, k, x0, y0, x1, y1): the edges of a drawing with its blocks placed; edges without length go.

    Chords are within tol in the block's own coordinates."""
    s = placed_shapes(shapes(parts, tol), parts, bases)
    steps = F.transform(F.slice("points", 1, F.size("points") - 1), lambda a, i: F.struct(a.alias("a"), F.element_at("points", i + 2).alias("b")))
    e = s.filter("size(points) > 1").select("path", "ord", "ref", "depth", "layer", F.posexplode(steps).alias("k", "s"))
    e = e.select("path", "ord", "ref", "depth", "layer", "k", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))
    return e.filter("x0 <> x1 or y0 <> y1")
