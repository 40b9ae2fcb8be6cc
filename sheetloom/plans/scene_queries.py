"""Topology, validation, acoustics and scene graph queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acoustics, scene, selection, spatial, topology, validation
from .tables import BOXES, SEGMENTS, boxes, read, segments

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


r6 = lambda c, n: F.round(c, 6).alias(n)
CROSS = """p AS (SELECT a.id AS a, b.id AS b, a.x0 AS ax, a.y0 AS ay, a.x1-a.x0 AS rx, a.y1-a.y0 AS ry, b.x0 AS cx, b.y0 AS cy, b.x1-b.x0 AS qx, b.y1-b.y0 AS qy FROM segments a JOIN segments b ON a.id < b.id),
 t AS (SELECT *, rx*qy-ry*qx AS d FROM p), u AS (SELECT *, ((cx-ax)*qy-(cy-ay)*qx)/d AS t, ((cx-ax)*ry-(cy-ay)*rx)/d AS u FROM t WHERE abs(d) > 1e-10), m AS (SELECT * FROM u WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 cuts AS (SELECT a AS id, t FROM m UNION ALL SELECT b, u FROM m)"""


@register("gr_05_split", f"WITH {SEGMENTS}, {CROSS}, n AS (SELECT id, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS n FROM segments), c AS (SELECT id, t FROM cuts JOIN n USING (id) WHERE t*n > 1e-6 AND (1-t)*n > 1e-6), k AS (SELECT id, count(*) + 1 AS pieces FROM c GROUP BY id) SELECT n.id, coalesce(pieces, 1) AS pieces, round(n, 4) AS length FROM n LEFT JOIN k ON n.id = k.id WHERE n > 1e-6")
def gr_05_split(spark, d):
    from ..functions import geometry as g

    p = topology.split_at_crossings(segments(spark, d), 60.0)
    return p.groupBy("id").agg(F.count("*").alias("pieces"), F.round(F.sum(g.distance(*map(F.col, ("x0", "y0", "x1", "y1")))), 4).alias("length"))


@register("gr_06_faces")
def gr_06_faces(spark, d):
    from ..operators import graphs

    f = topology.faces_of(graphs.written(topology.split_at_crossings(segments(spark, d), 60.0)))
    return f.select("face", "n", F.round("area", 3).alias("area"))


@register("gr_13_topology")
def gr_13_topology(spark, d):
    r = topology.loops_by_area(topology.build(segments(spark, d), 60.0, least_area=1.0))
    return r.select("ring_id", F.size("points").alias("n"), F.round("signed_area", 3).alias("area"))


def _rings(spark, d):
    """Rings of six kinds: a box, a bow tie, an open path, a notched box, a thin comb and a triangle; outer and holes by page."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx = (x0 + x1) / 2
    kinds = [
        F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)), F.array(p(x0, y0), p(x1, y1), p(x1, y0), p(x0, y1), p(x0, y0)), F.array(p(x0, y0), p(x1, y0), p(x1, y1)),
        F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(mx, y1), p(mx, y0 + (y1 - y0) * 0.1), p(x0, y0 + (y1 - y0) * 0.1), p(x0, y0)), F.array(p(x0, y0), p(x0 + 0.5, y0)), F.array(p(x0, y1), p(x1, y1), p(x1, y0), p(x0, y1)),
    ]
    k = F.col("id") % 6
    pts = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).when(k == 2, kinds[2]).when(k == 3, kinds[3]).when(k == 4, kinds[4]).otherwise(kinds[5])
    first = F.col("id") == F.col("page") * 100
    return boxes(spark, d).select(F.col("page").alias("drawing"), F.col("id").alias("ring_id"), pts.alias("points"), F.when(first, "outer").otherwise("hole").alias("role"))


@register("val_01_closure", f"WITH {BOXES} SELECT page AS drawing, id AS ring_id, CASE id % 6 WHEN 4 THEN 'E001' ELSE 'E002' END AS code, 'error' AS severity, 'closure' AS rule FROM boxes WHERE id % 6 = 4 OR (id % 6 = 2 AND sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) > 0.5)")
def val_01_closure(spark, d):
    return validation.check_closure(_rings(spark, d), 0.5)


@register("val_02_self_intersection", f"WITH {BOXES} SELECT page AS drawing, id AS ring_id, 'E003' AS code, 'error' AS severity, 'self_intersection' AS rule FROM boxes WHERE id % 6 = 1")
def val_02_self_intersection(spark, d):
    return validation.check_self_intersection(_rings(spark, d))


@register("val_04_micro_features", f"WITH {BOXES} SELECT page AS drawing, id AS ring_id, 'W001' AS code, 'warning' AS severity, 'short_edge' AS rule FROM boxes, (SELECT unnest([1, 2]) AS k) WHERE id % 6 = 4 OR (k = 1 AND id % 6 IN (0, 1, 3, 5)) UNION ALL SELECT page, id, 'W002', 'warning', 'sharp_angle' FROM boxes, (SELECT unnest([1, 2]) AS k) WHERE (id % 6 IN (0, 1, 3, 5))")
def val_04_micro_features(spark, d):
    return validation.check_micro_features(_rings(spark, d), 1.0, 10.0)


@register("val_05_convexity", f"WITH {BOXES} SELECT page AS drawing, id AS ring_id, 'W004' AS code, 'warning' AS severity, 'convexity' AS rule FROM boxes WHERE id % 6 = 1 UNION ALL SELECT page, id, 'E005', 'error', 'indentation' FROM boxes WHERE id % 6 = 3")
def val_05_convexity(spark, d):
    return validation.check_convexity(_rings(spark, d))


@register("val_03_holes")
def val_03_holes(spark, d):
    return validation.check_holes(_rings(spark, d))


@register("val_06_scene", f"WITH {BOXES}, s AS (SELECT DISTINCT page AS drawing, CASE WHEN page % 2 = 0 THEN 'mm' END AS unit FROM boxes), b AS (SELECT DISTINCT page FROM boxes WHERE page % 3 = 0) SELECT drawing, NULL::BIGINT AS ring_id, 'W003' AS code, 'warning' AS severity, 'no_unit' AS rule FROM s WHERE unit IS NULL UNION ALL SELECT drawing, NULL, 'I001', 'info', 'no_boundaries' FROM s WHERE drawing NOT IN (SELECT page FROM b)")
def val_06_scene(spark, d):
    b = boxes(spark, d).select(F.col("page").alias("drawing")).distinct()
    return validation.check_scene(b.withColumn("unit", F.when(F.col("drawing") % 2 == 0, "mm")), _rings(spark, d), b.filter("drawing % 3 = 0"))


@register("ag_17_validation_summary")
def ag_17_validation_summary(spark, d):
    b = boxes(spark, d).select(F.col("page").alias("drawing")).distinct()
    scenes = b.withColumn("unit", F.lit("mm"))
    return validation.summary(validation.with_suggestions(validation.validate(scenes, _rings(spark, d), b)), scenes)


@register("jn_24_outer_and_holes", f"WITH {BOXES}, r AS (SELECT page, id, (x1-x0)*(y1-y0) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS area, x0, y0, x1, y1 FROM boxes), o AS (SELECT * FROM r WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY area DESC, id DESC) = 1) SELECT page AS drawing, id AS ring_id, 'outer' AS role FROM o UNION ALL SELECT r.page, r.id, 'hole' FROM r JOIN o ON r.page = o.page AND r.area <= 0 AND (r.x0+r.x1)/2 >= o.x0 AND (r.x0+r.x1)/2 < o.x1 AND (r.y0+r.y1)/2 >= o.y0 AND (r.y0+r.y1)/2 < o.y1")
def jn_24_outer_and_holes(spark, d):
    from ..functions import geometry as g

    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    left, right = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")), F.array(p("x0", "y0"), p("x0", "y1"), p("x1", "y1"), p("x1", "y0"))
    r = boxes(spark, d).select(F.col("page").alias("drawing"), F.col("id").alias("ring_id"), F.when(F.col("id") % 2 == 0, left).otherwise(right).alias("points"))
    return topology.outer_and_holes(r.withColumn("signed_area", g.ring_area(F.col("points"))))


@register("gr_08_half_edges", f"WITH {BOXES} SELECT id AS ring_id, count(*) AS n, round(2*(any_value(x1)-any_value(x0)+any_value(y1)-any_value(y0)), 4) AS length FROM boxes, (SELECT unnest([1,2,3,4]) AS k) GROUP BY id")
def gr_08_half_edges(spark, d):
    from ..functions import geometry as g

    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    h = topology.half_edges_of_rings(boxes(spark, d).select(F.col("id").alias("ring_id"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points")))
    nxt = h.select(F.col("h").alias("next"), F.col("prev").alias("back"))
    whole = h.join(nxt, "next").filter("back = h")
    return whole.groupBy("ring_id").agg(F.count("*").alias("n"), F.round(F.sum(g.distance(*map(F.col, ("x0", "y0", "x1", "y1")))), 4).alias("length"))


@register("gr_12_half_edge_problems", "SELECT * FROM (VALUES ('unknown_next', 0::BIGINT), ('broken_next', 0), ('shared_next', 0)) AS t(code, n)")
def gr_12_half_edge_problems(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return topology.half_edge_problems(topology.half_edges_of_rings(boxes(spark, d).select(F.col("id").alias("ring_id"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points"))))


@register("gr_15_adjacent", "WITH e AS (SELECT DISTINCT l_orderkey AS u, l_partkey + 10000000 AS v FROM lineitem), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), p AS (SELECT DISTINCT a.v AS u, b.v AS v FROM s a JOIN s b ON a.u = b.u AND a.v < b.v) SELECT 'line' AS kind, count(*) AS n FROM e UNION ALL SELECT 'adjacent', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.u AND e.v = p.v)")
def gr_15_adjacent(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("u"), (F.col("l_partkey") + 10000000).alias("v")).distinct()
    return topology.with_adjacent(e).groupBy("kind").agg(F.count("*").alias("n"))


@register("gr_21_contours")
def gr_21_contours(spark, d):
    return topology.joined_contours(segments(spark, d), 20.0)


@register("gr_18_line_types")
def gr_18_line_types(spark, d):
    return topology.line_types(segments(spark, d), 25.0)


@register("gr_22_collinear_merge")
def gr_22_collinear_merge(spark, d):
    return topology.merged_collinear(segments(spark, d), 20.0, 0.99).select("contour", "n", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@register("gr_03_component_sizes", "WITH e AS (SELECT o_orderkey AS a, -1 - o_custkey AS b FROM orders) SELECT min(a) AS first, count(*) + 1 AS nodes, count(*) AS edges, count(*) AS most FROM e GROUP BY b")
def gr_03_component_sizes(spark, d):
    from ..operators import graphs

    e = read(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b"))
    first = e.groupBy(F.col("b").alias("component")).agg(F.min("a").alias("first"))
    return graphs.component_sizes(e).join(first, "component").select("first", "nodes", "edges", "most")


@register("jn_18_lasso", f"WITH {SEGMENTS} SELECT 'l' AS name, id FROM segments WHERE ((x0+x1)/2 BETWEEN -60 AND 80 AND (y0+y1)/2 BETWEEN -50 AND 70) OR EXISTS (SELECT 1 FROM (VALUES (-60,-50,80,-50), (80,-50,80,70), (80,70,-60,70), (-60,70,-60,-50)) AS s(a, b, c, e) WHERE ((x1-x0)*(e-b)-(y1-y0)*(c-a)) <> 0 AND ((a-x0)*(e-b)-(b-y0)*(c-a))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) BETWEEN 0 AND 1 AND ((a-x0)*(y1-y0)-(b-y0)*(x1-x0))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) BETWEEN 0 AND 1)")
def jn_18_lasso(spark, d):
    ring = [(-60.0, -50.0), (80.0, -50.0), (80.0, 70.0), (-60.0, 70.0)]
    r = spark.createDataFrame([("l", -60.0, -50.0, 80.0, 70.0, ring)], "name string, lo_x double, lo_y double, hi_x double, hi_y double, points array<struct<x:double,y:double>>")
    return spatial.in_regions(segments(spark, d), r, lasso=True).select("name", "id")


MATERIALS = [("concrete", 125, 0.01), ("concrete", 500, 0.02), ("brick", 500, 0.03), ("carpet", 500, 0.3), ("carpet", 1000, 0.4), ("gypsum", 500, 0.06)]
MAT_SQL = "m(name, band, alpha) AS (VALUES ('concrete', 125, 0.01), ('concrete', 500, 0.02), ('brick', 500, 0.03), ('carpet', 500, 0.3), ('carpet', 1000, 0.4), ('gypsum', 500, 0.06))"


def _materials(spark):
    return spark.createDataFrame(MATERIALS, "name string, band int, alpha double")


@register("ag_03_equivalent_absorption", f"WITH {BOXES}, {MAT_SQL}, a AS (SELECT page AS room, ['concrete','brick','none'][id % 3 + 1] AS name, (x1-x0)*(y1-y0) AS area FROM boxes) SELECT room, band, round(sum(area*alpha), 4) AS absorption FROM a JOIN m USING (name) GROUP BY ALL")
def ag_03_equivalent_absorption(spark, d):
    names = F.element_at(F.array(F.lit("concrete"), F.lit("brick"), F.lit("none")), (F.col("id") % 3 + 1).cast("int"))
    a = boxes(spark, d).select(F.col("page").alias("room"), names.alias("material"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return acoustics.equivalent_absorption(a, _materials(spark)).select("room", "band", F.round("absorption", 4).alias("absorption"))


@register("ag_09_room_reverberation", f"WITH {BOXES}, {MAT_SQL}, bands AS (SELECT unnest([125,250,500,1000,2000,4000]) AS band, unnest([0.02,0.03,0.04,0.05,0.06,0.07]) AS def), r AS (SELECT page AS drawing, (row_number() OVER (PARTITION BY page ORDER BY id) - 1)::INT AS room, 100*(x1-x0)*100*(y1-y0)/1e6 AS area, 2*100*((x1-x0)+(y1-y0))/1e3 AS per FROM boxes), s AS (SELECT *, area*3 AS volume, per*3+2*area AS surface FROM r), f AS (SELECT drawing, room, volume, surface, unnest([CASE WHEN drawing % 2 = 0 THEN 'brick' ELSE 'concrete' END, 'carpet', 'gypsum']) AS name, unnest([per*3, area, area]) AS part FROM s), a AS (SELECT drawing, room, volume, surface, bands.band, sum(part*coalesce(alpha, def)) AS a FROM f JOIN bands ON true LEFT JOIN m ON m.name = f.name AND m.band = bands.band GROUP BY ALL), k AS (SELECT *, max(CASE WHEN band = 500 THEN a/surface END) OVER (PARTITION BY drawing, room) < 0.2 AS low FROM a) SELECT drawing, room, band, CASE WHEN low THEN 'sabine' ELSE 'eyring' END AS formula, round(coalesce(CASE WHEN low THEN CASE WHEN a > 0.01 THEN 0.161*volume/a END WHEN a > 0.01 AND surface > 0.01 AND -surface*ln(1-greatest(0.01, least(0.99, a/surface))) > 0.01 THEN 0.161*volume/(-surface*ln(1-greatest(0.01, least(0.99, a/surface)))) END, 10), 5) AS t60 FROM k")
def ag_09_room_reverberation(spark, d):
    p = lambda x, y: F.struct((100 * F.col(x)).alias("x"), (100 * F.col(y)).alias("y"))
    b = boxes(spark, d)
    rings = b.select(F.col("page").alias("drawing"), F.col("id").alias("ring_id"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points"), F.when(F.col("id") == F.col("page") * 100, "outer").otherwise("hole").alias("role"))
    first = b.select(F.col("page").alias("drawing")).distinct().select("drawing", F.lit(1).alias("ord"), F.when(F.col("drawing") % 2 == 0, "brick").alias("material"))
    out = acoustics.room_reverberation(rings, first, _materials(spark), 3.0)
    return out.select("drawing", F.col("room").cast("int").alias("room"), "band", "formula", F.round("t60", 5).alias("t60"))


@register("ag_18_seat_zones")
def ag_18_seat_zones(spark, d):
    names = F.element_at(F.array(F.lit("SEAT-A"), F.lit("desk"), F.lit("chair_2")), (F.col("id") % 3 + 1).cast("int"))
    i = boxes(spark, d).select(names.alias("block"), "id", (F.col("x0") * 10).alias("x"), (F.col("y0") * 10).alias("y"))
    return acoustics.seat_zones(i).select("block", "n", "kind", F.round("area", 3).alias("area"))


LABELS = ["wall", "door", "room", "dimension_text", "dimension_line"]


def _nodes(spark, d):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int"))
    return boxes(spark, d).select("page", "id", pick(LABELS).alias("label"), pick(["boundary", "boundary", "space", "text", "text"]).alias("family"), F.col("score").alias("confidence"), "x0", "y0", "x1", "y1")


NODES = f"{BOXES}, nodes AS (SELECT page, id, ['wall','door','room','dimension_text','dimension_line'][id % 5 + 1] AS label, ['boundary','boundary','space','text','text'][id % 5 + 1] AS family, score AS confidence, x0, y0, x1, y1 FROM boxes), edges AS (SELECT page, id AS source, id + 1 AS target, ['attached_to','interrupted_by','bounded_by','labels'][id % 4 + 1] AS relation FROM boxes WHERE id % 3 = 0)"


def _edges(spark, d):
    pick = F.element_at(F.array(*map(F.lit, ["attached_to", "interrupted_by", "bounded_by", "labels"])), (F.col("id") % 4 + 1).cast("int"))
    return boxes(spark, d).filter("id % 3 = 0").select("page", F.col("id").alias("source"), (F.col("id") + 1).alias("target"), pick.alias("relation"))


@register("gr_28_all_constraints", f"WITH {NODES}, e AS (SELECT page, source AS id, relation FROM edges UNION SELECT page, target, relation FROM edges) SELECT page, 'opening_without_wall_relation' AS warning, id FROM nodes n WHERE label = 'door' AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = n.page AND e.id = n.id AND relation IN ('attached_to','interrupted_by','touches')) UNION ALL SELECT page, 'room_without_boundary_relation', id FROM nodes n WHERE label = 'room' AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = n.page AND e.id = n.id AND relation IN ('bounded_by','bounds','contains','inside')) UNION ALL SELECT page, 'dimension_text_without_link', id FROM nodes n WHERE label = 'dimension_text' AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = n.page AND e.id = n.id AND relation IN ('labels','dimension_of','attached_to')) UNION ALL SELECT DISTINCT e.page, 'invalid_interrupted_by_relation', NULL::BIGINT FROM edges e LEFT JOIN nodes s ON s.page = e.page AND s.id = e.source LEFT JOIN nodes t ON t.page = e.page AND t.id = e.target WHERE relation = 'interrupted_by' AND coalesce(s.label, '') <> 'wall' AND coalesce(t.label, '') <> 'door'")
def gr_28_all_constraints(spark, d):
    return scene.constraint_warnings(_nodes(spark, d), _edges(spark, d))


@register("gr_27_fusion", f"WITH {NODES} SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges")
def gr_27_fusion(spark, d):
    rel = _edges(spark, d).groupBy("page", F.col("source").alias("id")).agg(F.collect_list(F.struct("source", "target", "relation")).alias("relations"))
    nodes, edges, _ = scene.fuse(_nodes(spark, d).join(rel, ["page", "id"], "left"))
    n = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(nodes, "node").union(n(edges, "edge"))


@register("gr_29_repairs")
def gr_29_repairs(spark, d):
    return scene.repairs(_nodes(spark, d), _edges(spark, d), 30.0)


@register("gr_23_clusters")
def gr_23_clusters(spark, d):
    return scene.clusters(_nodes(spark, d), 0.3)


@register("gr_24_relation_suppression")
def gr_24_relation_suppression(spark, d):
    n = _nodes(spark, d)
    pairs = scene.contained(n.filter("label = 'room'"), n.filter("label <> 'room'"), 64)
    rel = pairs.select("page", F.lit("contains").alias("relation"), F.col("room").alias("source"), "target", "score")
    return scene.relation_suppression(rel, scene.clusters(n, 0.3), {"contains": 20}, 10).select("page", "relation", "source", "target", "n", r6("score", "score"))


@register("jn_32_contains_scored", f"WITH {NODES}, c AS (SELECT r.page, r.id AS room, t.id AS target, 0.35*(1-least(1, sqrt(power((r.x0+r.x1-t.x0-t.x1)/2,2)+power((r.y0+r.y1-t.y0-t.y1)/2,2))/greatest(sqrt(power(r.x1-r.x0,2)+power(r.y1-r.y0,2)),1e-9))) + 0.25*r.confidence*t.confidence + 0.25*least(1, 40*(t.x1-t.x0)*(t.y1-t.y0)/greatest((r.x1-r.x0)*(r.y1-r.y0),1e-9)) + 0.15 AS score FROM nodes r JOIN nodes t ON r.page = t.page AND r.label = 'room' AND t.label = 'dimension_text' AND (t.x0+t.x1)/2 BETWEEN r.x0-2 AND r.x1+2 AND (t.y0+t.y1)/2 BETWEEN r.y0-2 AND r.y1+2) SELECT page, room, target, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY page, room ORDER BY score DESC, target) <= 5")
def jn_32_contains_scored(spark, d):
    n = _nodes(spark, d)
    return scene.contained(n.filter("label = 'room'"), n.filter("label = 'dimension_text'"), 5).select("page", "room", "target", r6("score", "score"))


@register("jn_34_adjacent_scored", f"WITH {NODES}, p AS (SELECT a.page, a.id AS a, b.id AS b, a.confidence*b.confidence AS c, greatest(0, greatest(a.x0,b.x0)-least(a.x1,b.x1)) AS hg, greatest(0, greatest(a.y0,b.y0)-least(a.y1,b.y1)) AS vg, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))/greatest(least(a.x1-a.x0,b.x1-b.x0),1e-9) AS xr, greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0))/greatest(least(a.y1-a.y0,b.y1-b.y0),1e-9) AS yr FROM nodes a JOIN nodes b ON a.page = b.page AND a.id < b.id AND a.label = 'room' AND b.label = 'room'), q AS (SELECT *, CASE WHEN xr = 0 THEN hg WHEN yr = 0 THEN vg ELSE least(hg, vg) END AS gap, greatest(CASE WHEN hg <= 8 THEN xr ELSE 0 END, CASE WHEN vg <= 8 THEN yr ELSE 0 END) AS s FROM p), r AS (SELECT page, a, b, 0.55*s + 0.25*greatest(0, 1-gap/10) + 0.2*c AS score FROM q WHERE s >= 0.25 AND gap <= 10), e AS (SELECT *, unnest([a, b]) AS room FROM r) SELECT DISTINCT page, a, b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, room ORDER BY score DESC, a, b) AS k FROM e) WHERE k <= 8")
def jn_34_adjacent_scored(spark, d):
    return scene.adjacent_rooms(_nodes(spark, d).filter("label = 'room'")).select("page", "a", "b", r6("score", "score"))


@register("jn_35_contains_policy", f"WITH {NODES}, p AS (SELECT r.page, r.id AS room, s.id AS symbol, greatest(0, least(r.x1,s.x1)-greatest(r.x0,s.x0))*greatest(0, least(r.y1,s.y1)-greatest(r.y0,s.y0))/greatest(1e-9,(s.x1-s.x0)*(s.y1-s.y0)) AS ratio, sqrt(power((r.x0+r.x1-s.x0-s.x1)/2,2)+power((r.y0+r.y1-s.y0-s.y1)/2,2)) AS d, (r.x1-r.x0)*(r.y1-r.y0) AS area FROM nodes r JOIN nodes s ON r.page = s.page AND r.label = 'room' AND s.label = 'door' AND (s.x0+s.x1)/2 BETWEEN r.x0 AND r.x1 AND (s.y0+s.y1)/2 BETWEEN r.y0 AND r.y1) SELECT page, room, symbol FROM p WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY page, symbol ORDER BY ratio DESC, d, area DESC, room) = 1")
def jn_35_contains_policy(spark, d):
    n = _nodes(spark, d)
    return scene.room_of_symbol(n.filter("label = 'room'"), n.filter("label = 'door'"), 1, 0.5)


@register("jn_38_room_of_label", f"WITH {NODES}, p AS (SELECT r.page, t.id AS label, r.id AS room, (t.x0+t.x1)/2 AS x, (t.y0+t.y1)/2 AS y, r.x0, r.y0, r.x1, r.y1, t.x0 >= r.x0 AND t.x1 <= r.x1 AND t.y0 >= r.y0 AND t.y1 <= r.y1 AS whole FROM nodes r JOIN nodes t ON r.page = t.page AND r.label = 'room' AND t.label = 'dimension_text'), q AS (SELECT *, sqrt(power(greatest(0, x0-x, x-x1),2)+power(greatest(0, y0-y, y-y1),2)) AS d, (x1-x0)*(y1-y0) AS area FROM p) SELECT page, label, room, CASE WHEN d = 0 AND whole THEN 'box_whole' WHEN d = 0 THEN 'box_centre' ELSE 'near' END AS method, round(d, 6) AS d FROM q WHERE d <= 25 QUALIFY row_number() OVER (PARTITION BY page, label ORDER BY d, area, room) = 1")
def jn_38_room_of_label(spark, d):
    n = _nodes(spark, d)
    rooms = n.filter("label = 'room'").withColumn("points", F.lit(None).cast("array<struct<x:double,y:double>>"))
    return scene.room_of_label(rooms, n.filter("label = 'dimension_text'"), 25.0).select("page", "label", "room", "method", r6("d", "d"))


@register("jn_26_text_lines", f"WITH {NODES}, t AS (SELECT page, id, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, 1.5*(y1-y0) AS far FROM nodes WHERE label = 'dimension_text'), v AS (SELECT page, id % 7 AS poly, x0 AS x, y0 AS y FROM boxes), h AS (SELECT t.page, t.id, list_sort(list(DISTINCT poly)) AS l FROM t JOIN v ON t.page = v.page AND sqrt(power(x-cx,2)+power(y-cy,2)) <= far GROUP BY ALL) SELECT t.page, t.id AS text, coalesce(array_to_string(l, ','), '') AS lines FROM t LEFT JOIN h ON h.page = t.page AND h.id = t.id")
def jn_26_text_lines(spark, d):
    v = boxes(spark, d).select("page", (F.col("id") % 7).alias("poly"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    out = scene.texts_near_lines(_nodes(spark, d).filter("label = 'dimension_text'"), v, 1.5)
    return out.select("page", "text", F.coalesce(F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), F.lit("")).alias("lines"))


@register("jn_13_boundary_entities", f"WITH {SEGMENTS}, e AS (SELECT id, x0 + 1 AS x0, y0 - 1 AS y0, x1, y1 FROM segments WHERE id % 2 = 0), t AS (SELECT id, x0, y0, x1, y1 FROM e UNION ALL SELECT id, x1, y1, x0, y0 FROM e) SELECT s.id, min(t.id) AS entity FROM segments s LEFT JOIN t ON sqrt(power(s.x0-t.x0,2)+power(s.y0-t.y0,2)) <= 5 AND sqrt(power(s.x1-t.x1,2)+power(s.y1-t.y1,2)) <= 5 GROUP BY s.id")
def jn_13_boundary_entities(spark, d):
    s = segments(spark, d)
    e = s.filter("id % 2 = 0").select("id", (F.col("x0") + 1).alias("x0"), (F.col("y0") - 1).alias("y0"), "x1", "y1")
    return scene.boundary_entities(s, e)


@register("jn_44_overlap_exists", "WITH o AS (SELECT l_orderkey*10+l_linenumber AS id, l_partkey AS line, l_quantity::DOUBLE AS lo, l_quantity::DOUBLE + 5 AS hi, l_linenumber AS k FROM lineitem) SELECT DISTINCT a.id FROM o a WHERE k > 1 AND EXISTS (SELECT 1 FROM o b WHERE b.k = 1 AND a.line = b.line AND least(a.hi,b.hi)-greatest(a.lo,b.lo) > 1e-6)")
def jn_44_overlap_exists(spark, d):
    q, y = F.col("l_quantity").cast("double"), F.col("l_partkey").cast("double")
    s = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("x0"), y.alias("y0"), (q + 5).alias("x1"), y.alias("y1"), "l_linenumber")
    return spatial.overlap_exists(s.filter("l_linenumber > 1"), s.filter("l_linenumber = 1")).select("id").distinct()


@register("jn_46_fused_streams")
def jn_46_fused_streams(spark, d):
    b = boxes(spark, d)
    return scene.fused_streams(b.filter("label < 5"), b.filter("label >= 5"), 0.02, (100.0, 1e6), 0.2, 10).select("side", "page", "id")


def _costs(spark, d):
    b = boxes(spark, d)
    p = spatial.overlap_pairs(b.filter("label < 4"), b.filter("label >= 4"), pad=20.0).filter("page = r_page")
    d2 = F.abs(F.col("x0") - F.col("r_x0")) + F.abs(F.col("y0") - F.col("r_y0"))
    return p.select("page", F.col("id").alias("a"), F.col("r_id").alias("b"), F.round(d2, 3).alias("cost"))


@register("jn_30_optimal_assignment")
def jn_30_optimal_assignment(spark, d):
    return scene.optimal_assignment(_costs(spark, d), ["page"])


@register("jn_31_greedy_assignment")
def jn_31_greedy_assignment(spark, d):
    return selection.match_one_to_one(_costs(spark, d).withColumn("score", -F.col("cost")), ["page"]).select("page", "a", "b", "cost")


@register("gr_25_centroid_clusters")
def gr_25_centroid_clusters(spark, d):
    return scene.centroid_clusters(boxes(spark, d).select("page", "id", "x0", "y0", "x1", "y1"), 40.0)


@register("gr_26_overlap_clusters")
def gr_26_overlap_clusters(spark, d):
    return scene.overlap_clusters(boxes(spark, d).select("page", "id", "x0", "y0", "x1", "y1"))


@register("gr_31_tracks")
def gr_31_tracks(spark, d):
    b = boxes(spark, d).withColumn("win", F.col("id") % 4)
    p = spatial.overlap_pairs(b, b).filter("page = r_page and r_win = win + 1")
    from ..functions import geometry as g

    o = g.iou([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    s = scene.identity_similarity(F.lit(1.0), o)
    return scene.identity_tracks(b, p.select(F.col("id").alias("a"), F.col("r_id").alias("b"), s.alias("score")), 0.7)


def _instances(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("label"), F.avg("l_discount").cast("double").alias("score"), F.collect_set("l_partkey").alias("items"))


@register("gr_33_item_owners", "WITH i AS (SELECT l_orderkey AS id, avg(l_discount)::DOUBLE AS score, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), f AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), w AS (SELECT item, f.id, row_number() OVER (PARTITION BY item ORDER BY round(score + 0.1*ln(1+n), 9) DESC, f.id) AS k FROM f JOIN i ON i.id = f.id) SELECT id, count(*) AS n FROM w WHERE k = 1 GROUP BY id")
def gr_33_item_owners(spark, d):
    kept, _ = scene.item_owners(_instances(spark, d).withColumn("score", F.col("score")))
    return kept.select("id", F.size("items").cast("long").alias("n"))


@register("gr_32_merged_tracks", "WITH i AS (SELECT l_orderkey AS id, avg(l_discount)::DOUBLE AS score FROM lineitem GROUP BY 1), t AS (SELECT id, id // 32 AS track, score FROM i), s AS (SELECT track, coalesce(sum(score*score)/nullif(sum(score),0), NULL) AS score FROM t GROUP BY 1), n AS (SELECT l_orderkey // 32 AS track, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT track, round(score, 6) AS score, n FROM s JOIN n USING (track)")
def gr_32_merged_tracks(spark, d):
    i = _instances(spark, d)
    out = scene.merged_tracks(i, i.select("id", F.floor(F.col("id") / 32).alias("track")))
    return out.select("track", r6("score", "score"), F.size("items").cast("long").alias("n"))


@register("tk_05_diverse")
def tk_05_diverse(spark, d):
    return selection.suppress_and_fill(boxes(spark, d), ["page"], 0.3, 40).select("page", "id")


@register("st_05_box_dedup")
def st_05_box_dedup(spark, d):
    from ..functions import geometry as g

    b = boxes(spark, d).withColumn("lies", g.box_orientation([F.col(c) for c in ("x0", "y0", "x1", "y1")])).withColumn("score", -F.col("id").cast("double"))
    return selection.suppress(b, ["page", "lies"], 0.5).select("page", "id")


@register("st_06_proposal_dedup")
def st_06_proposal_dedup(spark, d):
    return selection.suppress(boxes(spark, d), ["page"], 0.98, inclusive=True).select("page", "id")


@register("prj_41_candidates", "SELECT l_orderkey AS id, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS source, l_partkey AS item FROM lineitem")
def prj_41_candidates(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("large"), F.collect_list(F.when(F.col("l_quantity") <= 25, F.col("l_partkey"))).alias("small"))
    return scene.exploded(r, ["large", "small"], "id")
