"""Validation rules over rings and scenes: one row for each issue, with code, severity and the rule that found it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import drawing, graphs, spatial, topology

#: What to do about an issue, by its code, the setting to change and how urgent it is.
SUGGESTIONS = [
    ("E001", "close the ring, raise the closure tolerance or bridge the gap", "closure_tolerance", 10),
    ("E002", "close the ring, raise the closure tolerance or bridge the gap", "closure_tolerance", 10),
    ("E003", "cut at the crossing, draw anew or simplify", None, 9),
    ("W001", "raise the least edge length or remove short edges", "min_edge_length", 5),
    ("W002", "raise the least angle or round the corner", "min_angle", 5),
    ("W003", "calibrate by two points or name the unit", None, 8),
]
CONVEX_LEAST, DEEP, NARROW = 0.6, 0.5, 0.3


def _issue(rows: DataFrame, code, severity: str, rule: str, ring="ring_id") -> DataFrame:
    return rows.select("drawing", (F.col(ring) if isinstance(ring, str) else ring).alias("ring_id"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))


def check_closure(rings: DataFrame, tol: float) -> DataFrame:
    """E001 for rings of under three points, E002 for rings whose last point is farther than tol from the first."""
    first, last = F.try_element_at("points", F.lit(1)), F.try_element_at("points", F.lit(-1))
    short = F.size("points") < 3
    far = g.distance(first["x"], first["y"], last["x"], last["y"]) > tol
    return _issue(rings.filter(short | far), F.when(short, "E001").otherwise("E002"), "error", "closure")


def ring_edges(rings: DataFrame) -> DataFrame:
    """(drawing, ring_id, n, i, sx0, sy0, sx1, sy1, x0, y0, x1, y1) of each side, the last one back to the first point; a
    first point that is repeated at the end counts once."""
    p = F.col("points")
    closed = (F.size(p) > 1) & (p[0] == F.element_at(p, -1))
    own = rings.select("drawing", "ring_id", F.when(closed, F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p).alias("points"))
    e = own.select("drawing", "ring_id", F.size("points").alias("n"), F.posexplode("points").alias("i", "p"), "points")
    q = F.element_at("points", (F.col("i") + 1) % F.col("n") + 1)
    return spatial.with_envelope(e.select("drawing", "ring_id", "n", "i", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))


def check_self_intersection(rings: DataFrame, cell: float = 50.0) -> DataFrame:
    """E003 for rings of four points or more with a point that comes twice or two sides, not next to each other, that meet.

    Sides meet on the grid, ring by ring, so a long ring is no all-pairs comparison."""
    e = graphs.written(ring_edges(rings).filter("n >= 4"))
    again = e.groupBy("drawing", "ring_id", "sx0", "sy0").agg(F.count("*").alias("k")).filter("k > 1").select("drawing", "ring_id")
    pairs = spatial.overlap_pairs(e, e, cell).filter("drawing = r_drawing and ring_id = r_ring_id and i + 1 < r_i and not (i = 0 and r_i = n - 1)")
    pairs = graphs.written(pairs.select("drawing", "ring_id", *(f"{side}{c}" for side in ("s", "r_s") for c in ("x0", "y0", "x1", "y1"))))
    ends = [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1", "r_sx0", "r_sy0", "r_sx1", "r_sy1")]
    lies = lambda k: (F.least(ends[0], ends[2]) <= ends[k]) & (ends[k] <= F.greatest(ends[0], ends[2])) & (F.least(ends[1], ends[3]) <= ends[k + 1]) & (ends[k + 1] <= F.greatest(ends[1], ends[3])) & (g.orientation(*ends[0:4], ends[k], ends[k + 1]) == 0)
    # One filter each: together their code is too long to be compiled.
    met = [pairs.filter(x).select("drawing", "ring_id") for x in (g.intersection(*ends).isNotNull(), lies(4), lies(6))]
    return _issue(again.union(met[0]).union(met[1]).union(met[2]).distinct(), "E003", "error", "self_intersection")


def _crossing_rings(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(drawing, ring_id, r_ring_id) of rings of one drawing whose sides meet."""
    pairs = spatial.overlap_pairs(ring_edges(left), ring_edges(right), cell).filter("drawing = r_drawing")
    ends = [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1", "r_sx0", "r_sy0", "r_sx1", "r_sy1")]
    return pairs.filter(g.intersection(*ends).isNotNull()).select("drawing", "ring_id", "r_ring_id").distinct()


def check_holes(rings: DataFrame, cell: float = 50.0) -> DataFrame:
    """Of rings with a role: E004 for holes whose centre lies outside the outer ring or that have no points, E005 for holes whose sides meet
    it, E006 for each hole that meets one of a smaller id."""
    outer, holes = rings.filter("role = 'outer'"), rings.filter("role = 'hole'")
    x, y = topology.ring_centre(F.col("points"))
    frame = outer.select("drawing", F.col("points").alias("outer_points"))
    outside = holes.join(frame, "drawing").filter(~g.point_in_ring(x, y, F.col("outer_points")))
    crossing = _crossing_rings(holes, outer, cell)
    each = _crossing_rings(holes, holes, cell).filter("ring_id > r_ring_id").select("drawing", "ring_id").distinct()
    return _issue(outside, "E004", "error", "hole_outside").union(_issue(crossing, "E005", "error", "hole_crosses")).union(_issue(each, "E006", "error", "holes_cross"))


def check_micro_features(rings: DataFrame, least_length: float, least_angle: float) -> DataFrame:
    """W001 for each short side, W002 for each corner whose directions differ by less than least_angle degrees."""
    p = rings.withColumn("own", F.struct("drawing", "ring_id")).select("own", F.posexplode("points").alias("idx", "p")).select("own", "idx", "p.x", "p.y")
    t = drawing.vertex_turns(p, "own", "idx").select("own.drawing", "own.ring_id", "length", "turn")
    return _issue(t.filter(F.col("length") < least_length), "W001", "warning", "short_edge").union(_issue(t.filter(F.abs("turn") < least_angle), "W002", "warning", "sharp_angle"))


def convexity(rings: DataFrame) -> DataFrame:
    """(drawing, ring_id, ratio, depth, width): area over that of the hull, how far points lie inside the hull at most, and the
    distance between the first and last such point."""
    own = rings.withColumn("own", F.struct("drawing", "ring_id"))
    p = own.select("own", F.posexplode("points").alias("i", "p")).select("own", "i", "p.x", "p.y")
    name = F.to_json("own")
    hull = drawing.convex_hulls(p.select(name.alias("key"), "x", "y"), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("hull"))
    area = F.abs(g.ring_area(F.col("hull")))
    base = own.select(name.alias("key"), "drawing", "ring_id", F.abs(g.ring_area(F.col("points"))).alias("area")).join(hull, "key")
    n = F.size("hull")
    side = lambda i: F.element_at("hull", (i + 1) % n + 1)
    pts = p.select(name.alias("key"), "i", "x", "y").join(hull, "key")

    def off(h, i):
        cx, cy = g.closest_on_segment(F.col("x"), F.col("y"), h["x"], h["y"], side(i)["x"], side(i)["y"])
        return g.distance(F.col("x"), F.col("y"), cx, cy)

    depth = pts.withColumn("d", F.array_min(F.transform("hull", off))).filter((n >= 3) & (F.col("d") > 1e-10))
    ends = depth.groupBy("key").agg(F.max("d").alias("depth"), F.min_by(F.struct("x", "y"), "i").alias("f"), F.max_by(F.struct("x", "y"), "i").alias("l"))
    width = g.distance(F.col("f.x"), F.col("f.y"), F.col("l.x"), F.col("l.y"))
    return base.join(ends, "key", "left").select("drawing", "ring_id", F.try_divide("area", F.when(area > 1e-10, area)).alias("ratio"), F.coalesce("depth", F.lit(0.0)).alias("depth"), F.coalesce(width, F.lit(0.0)).alias("width"))


def check_convexity(rings: DataFrame) -> DataFrame:
    """W004 for rings that fill under 0.6 of their hull, E005 for a deep and narrow indentation."""
    c = convexity(rings)
    return _issue(c.filter(F.col("ratio") < CONVEX_LEAST), "W004", "warning", "convexity").union(_issue(c.filter((F.col("depth") > DEEP) & (F.col("width") < NARROW)), "E005", "error", "indentation"))


def check_scene(scenes: DataFrame, rings: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Of scenes (drawing, unit): E000 without an outer ring, W003 without a unit, I001 without boundaries."""
    none = F.lit(None).cast(rings.schema["ring_id"].dataType)
    no_outer = scenes.join(rings.filter("role = 'outer'").select("drawing").distinct(), "drawing", "left_anti")
    no_unit = scenes.filter(needs_calibration(F.col("unit")))
    bare = scenes.join(boundaries.select("drawing").distinct(), "drawing", "left_anti")
    return _issue(no_outer, "E000", "error", "no_outer", none).union(_issue(no_unit, "W003", "warning", "no_unit", none)).union(_issue(bare, "I001", "info", "no_boundaries", none))


def needs_calibration(unit):
    """Two points are needed just where no unit is named."""
    return unit.isNull() | F.lower(unit).isin("", "unspecified")


def with_suggestions(issues: DataFrame) -> DataFrame:
    """issues with text, setting and priority, null for codes without a suggestion."""
    table = issues.sparkSession.createDataFrame(SUGGESTIONS, "code string, text string, setting string, priority int")
    return issues.join(F.broadcast(table), "code", "left")


def summary(issues: DataFrame, scenes: DataFrame) -> DataFrame:
    """(drawing, errors, warnings, infos, passed): counts by severity; a drawing passes without an error."""
    n = issues.groupBy("drawing").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    out = scenes.select("drawing").join(n, "drawing", "left").na.fill(0, ["errors", "warnings", "infos"])
    return out.withColumn("passed", F.col("errors") == 0)


def validate(scenes: DataFrame, rings: DataFrame, boundaries: DataFrame, closure: float = 0.5, least_length: float = 1.0, least_angle: float = 10.0) -> DataFrame:
    """All issues of drawings. rings has drawing, ring_id, points and role (outer or hole)."""
    parts = [check_scene(scenes, rings, boundaries), check_closure(rings, closure), check_self_intersection(rings), check_holes(rings), check_micro_features(rings, least_length, least_angle), check_convexity(rings.filter("role = 'outer'"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return graphs.written(out)
