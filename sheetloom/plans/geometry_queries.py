"""Geometry queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graphs, rules, selection, spatial
from .tables import BOXES, SEGMENTS, boxes, segments

QUERIES, ORACLES = {}, {}
LEN = "sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))"


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _length():
    return g.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


@register("sc_segment_measures", f"WITH {SEGMENTS} SELECT id, round({LEN}, 6) AS length, round((x0+x1)/2, 6) AS mx, round((y0+y1)/2, 6) AS my, CASE WHEN abs(y1-y0) <= 5 THEN 'horizontal' WHEN abs(x1-x0) <= 5 THEN 'vertical' ELSE 'sloped' END AS kind FROM segments")
def sc_segment_measures(spark, d):
    return segments(spark, d).select("id", F.round(_length(), 6).alias("length"), F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("mx"), F.round((F.col("y0") + F.col("y1")) / 2, 6).alias("my"), g.direction_class(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 5.0).alias("kind"))


@register("sc_02_ring_area", f"WITH {SEGMENTS} SELECT id, round((x0*y1-x1*y0 + x1*0-100*y1 + 100*y0-x0*0)/2, 6) AS area, round({LEN} + sqrt((100-x1)*(100-x1)+y1*y1) + sqrt((x0-100)*(x0-100)+y0*y0), 6) AS perimeter, CASE WHEN (x1-x0)*(0-y0)-(y1-y0)*(100-x0) > 0 THEN 1 WHEN (x1-x0)*(0-y0)-(y1-y0)*(100-x0) < 0 THEN -1 ELSE 0 END AS turn FROM segments")
def sc_02_ring_area(spark, d):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    hundred, zero = F.lit(100.0), F.lit(0.0)
    s = segments(spark, d).withColumn("points", F.array(p(F.col("x0"), F.col("y0")), p(F.col("x1"), F.col("y1")), p(hundred, zero)))
    return s.select("id", F.round(g.ring_area(F.col("points")), 6).alias("area"), F.round(g.ring_perimeter(F.col("points")), 6).alias("perimeter"), g.orientation(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), hundred, zero).alias("turn"))


@register("sc_10_closest_point", f"WITH {SEGMENTS}, t AS (SELECT *, greatest(0, least(1, coalesce(((50-x0)*(x1-x0)+(60-y0)*(y1-y0))/nullif((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0), 0), 0))) AS t FROM segments) SELECT id, round(x0+t*(x1-x0), 6) AS px, round(y0+t*(y1-y0), 6) AS py FROM t")
def sc_10_closest_point(spark, d):
    x, y = g.closest_on_segment(F.lit(50.0), F.lit(60.0), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return segments(spark, d).select("id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@register("sc_13_box_algebra", f"""WITH {BOXES}, p AS (SELECT a.id, b.id AS other, a.x0, a.y0, a.x1, a.y1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM boxes a JOIN boxes b ON b.id = a.id + 1),
q AS (SELECT *, greatest(0, least(x1,bx1)-greatest(x0,bx0))*greatest(0, least(y1,by1)-greatest(y0,by0)) AS common FROM p)
SELECT id, other, round(common, 6) AS common, round(common/greatest(1e-9, (x1-x0)*(y1-y0)+(bx1-bx0)*(by1-by0)-common), 6) AS iou, round(common/greatest(1e-9, (x1-x0)*(y1-y0)), 6) AS inside,
round(sqrt(power(greatest(0, x0-bx1, bx0-x1),2)+power(greatest(0, y0-by1, by0-y1),2)), 6) AS gap, ((x0+x1)/2 >= bx0-2 AND (x0+x1)/2 <= bx1+2 AND (y0+y1)/2 >= by0-2 AND (y0+y1)/2 <= by1+2) AS covered,
round(exp(-sqrt(power((x0+x1)/2-(bx0+bx1)/2,2)+power((y0+y1)/2-(by0+by1)/2,2)+power(((x1-x0)-(bx1-bx0))/2,2)+power(((y1-y0)-(by1-by0))/2,2))/32), 6) AS similarity, CASE WHEN x1-x0 >= y1-y0 THEN 'horizontal' ELSE 'vertical' END AS lies FROM q""")
def sc_13_box_algebra(spark, d):
    a, b = boxes(spark, d), boxes(spark, d)
    b = b.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    p, q = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1")]
    r = lambda c: F.round(c, 6)
    return a.join(b, "id").select("id", "other", r(g.box_intersection(p, q)).alias("common"), r(g.iou(p, q)).alias("iou"), r(g.containment(p, q)).alias("inside"), r(g.box_gap(p, q)).alias("gap"), g.centre_covered(p, q).alias("covered"), r(g.wasserstein_similarity(p, q)).alias("similarity"), g.box_orientation(p).alias("lies"))


@register("sc_05_point_in_ring", f"WITH {SEGMENTS} SELECT id FROM segments WHERE abs(x0) + abs(y0) < 120")
def sc_05_point_in_ring(spark, d):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((120, 0), (0, 120), (-120, 0), (0, -120))))
    x, y = F.col("x0"), F.col("y0")
    return segments(spark, d).filter(g.point_in_ring(x, y, ring) & ~g.on_ring(x, y, ring)).select("id")


@register("flt_11_zero_length", f"WITH {SEGMENTS} SELECT id, layer FROM segments WHERE {LEN} >= 100")
def flt_11_zero_length(spark, d):
    return segments(spark, d).filter(_length() >= 100).select("id", "layer")


@register("flt_15_viewport", f"WITH {SEGMENTS} SELECT id, layer FROM segments WHERE greatest(x0,x1) >= -50 AND least(x0,x1) <= 80 AND greatest(y0,y1) >= -40 AND least(y0,y1) <= 90 AND layer IN ('L1','L2','L3')")
def flt_15_viewport(spark, d):
    return segments(spark, d).filter((F.greatest("x0", "x1") >= -50) & (F.least("x0", "x1") <= 80) & (F.greatest("y0", "y1") >= -40) & (F.least("y0", "y1") <= 90) & F.col("layer").isin("L1", "L2", "L3")).select("id", "layer")


@register("flt_17_valid_box", f"WITH {BOXES} SELECT id FROM boxes WHERE x1 > x0 AND y1 > y0 AND (score >= 0.1 OR label = 3)")
def flt_17_valid_box(spark, d):
    return boxes(spark, d).filter("x1 > x0 and y1 > y0").filter((F.col("score") >= 0.1) | (F.col("label") == 3)).select("id")


@register("flt_16_detail_cap", f"WITH {SEGMENTS} SELECT id, layer FROM (SELECT *, (layer = 'L1') AS wall FROM segments WHERE {LEN} > 100 / 0.5) ORDER BY wall DESC, id LIMIT 40")
def flt_16_detail_cap(spark, d):
    return segments(spark, d).filter(_length() > 100 / 0.5).withColumn("wall", F.col("layer") == "L1").orderBy(F.desc("wall"), "id").limit(40).select("id", "layer")


@register("prj_30_area_bucket", f"WITH {BOXES}, a AS (SELECT (x1-x0)*(y1-y0) AS a FROM boxes) SELECT CASE WHEN a <= 64 THEN 'tiny' WHEN a <= 256 THEN 'small' WHEN a <= 1024 THEN 'medium' WHEN a <= 4096 THEN 'large' ELSE 'xlarge' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def prj_30_area_bucket(spark, d):
    a = boxes(spark, d).select(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"))
    return a.groupBy(rules.area_bucket(F.col("a")).alias("bucket")).agg(F.count("*").alias("n"))


@register("prj_31_tiles", f"WITH {BOXES}, t AS (SELECT id, x0, y0, x1, y1, unnest(range(floor(x0/100)::BIGINT, floor(x1/100)::BIGINT + 1)) AS tx FROM boxes), u AS (SELECT *, unnest(range(floor(y0/100)::BIGINT, floor(y1/100)::BIGINT + 1)) AS ty FROM t), c AS (SELECT *, greatest(x0, tx*100) AS cx0, greatest(y0, ty*100) AS cy0, least(x1, tx*100+100) AS cx1, least(y1, ty*100+100) AS cy1 FROM u) SELECT id, tx, ty, round(cx0-tx*100, 6) AS lx0, round(cy0-ty*100, 6) AS ly0, round(cx1-tx*100, 6) AS lx1, round(cy1-ty*100, 6) AS ly1 FROM c WHERE (cx1-cx0)*(cy1-cy0) >= 0.25*(x1-x0)*(y1-y0)")
def prj_31_tiles(spark, d):
    return rules.clip_to_tiles(boxes(spark, d), 100.0, 0.25).select("id", "tx", "ty", *(F.round(c, 6).alias(c) for c in ("lx0", "ly0", "lx1", "ly1")))


NEAR = "p AS (SELECT id, x0 AS x, y0 AS y FROM segments), pairs AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM p a JOIN p b ON a.id < b.id AND abs(a.x-b.x) < 12 AND abs(a.y-b.y) < 12)"


@register("jn_01_near_points", f"WITH {SEGMENTS}, {NEAR} SELECT a, b, round(d, 6) AS d FROM pairs WHERE d < 12")
def jn_01_near_points(spark, d):
    p = segments(spark, d).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return spatial.near_pairs(p, 12.0, salts=2).select("a", "b", F.round("d", 6).alias("d"))


@register("jn_03_snap_components", f"WITH RECURSIVE {SEGMENTS}, {NEAR}, e AS (SELECT a AS u, b AS v FROM pairs WHERE d < 12 UNION SELECT b, a FROM pairs WHERE d < 12), r AS (SELECT id AS n, id AS c FROM p UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.n), c AS (SELECT n AS id, min(c) AS component FROM r GROUP BY n), m AS (SELECT component, avg(x) AS cx, avg(y) AS cy FROM c JOIN p USING (id) GROUP BY component) SELECT id, component, round(cx, 6) AS x, round(cy, 6) AS y FROM c JOIN m USING (component)")
def jn_03_snap_components(spark, d):
    p = segments(spark, d).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return rules.snap(p, 12.0).select("id", "component", F.round("sx", 6).alias("x"), F.round("sy", 6).alias("y"))


CROSS = """s AS (SELECT * FROM segments), p AS (SELECT a.id AS a, b.id AS b, a.x0 AS ax, a.y0 AS ay, a.x1-a.x0 AS rx, a.y1-a.y0 AS ry, b.x0 AS cx, b.y0 AS cy, b.x1-b.x0 AS qx, b.y1-b.y0 AS qy FROM s a JOIN s b ON a.id < b.id
 WHERE NOT (a.x0=b.x0 AND a.y0=b.y0) AND NOT (a.x0=b.x1 AND a.y0=b.y1) AND NOT (a.x1=b.x0 AND a.y1=b.y0) AND NOT (a.x1=b.x1 AND a.y1=b.y1)), t AS (SELECT *, rx*qy-ry*qx AS d FROM p),
 u AS (SELECT *, ((cx-ax)*qy-(cy-ay)*qx)/d AS t, ((cx-ax)*ry-(cy-ay)*rx)/d AS u FROM t WHERE abs(d) > 1e-10)"""


@register("jn_08_crossings", f"WITH {SEGMENTS}, {CROSS} SELECT a, b, round(ax+t*rx, 4) AS x, round(ay+t*ry, 4) AS y FROM u WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
def jn_08_crossings(spark, d):
    s = segments(spark, d)
    return spatial.crossings(s, 60.0).select("a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("jn_15_open_ends", f"WITH {SEGMENTS}, e AS (SELECT id, 0 AS \"end\", x0 AS x, y0 AS y FROM segments UNION ALL SELECT id, 1, x1, y1 FROM segments) SELECT id, \"end\", x, y FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.id <> e.id AND sqrt((o.x-e.x)*(o.x-e.x)+(o.y-e.y)*(o.y-e.y)) <= 15)")
def jn_15_open_ends(spark, d):
    return spatial.open_ends(segments(spark, d), 15.0)


REGIONS = [("a", -100.0, -100.0, 0.0, 0.0), ("b", -20.0, -50.0, 90.0, 120.0), ("c", 200.0, 200.0, 210.0, 210.0)]
REGION_SQL = "regions(name, lx, ly, hx, hy) AS (VALUES ('a', -100, -100, 0, 0), ('b', -20, -50, 90, 120), ('c', 200, 200, 210, 210)), hit AS (SELECT name, s.* FROM segments s JOIN regions ON (x0+x1)/2 BETWEEN lx AND hx AND (y0+y1)/2 BETWEEN ly AND hy)"


def _regions(spark):
    return spark.createDataFrame(REGIONS, "name string, lo_x double, lo_y double, hi_x double, hi_y double")


@register("jn_19_region_select", f"WITH {SEGMENTS}, {REGION_SQL} SELECT name, id, layer FROM hit")
def jn_19_region_select(spark, d):
    return spatial.in_regions(segments(spark, d), _regions(spark)).select("name", "id", "layer")


@register("jn_36_nearest_wall", f"WITH {BOXES}, c AS (SELECT id, label, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM boxes), p AS (SELECT o.id, w.id AS r_id, sqrt((o.x-w.x)*(o.x-w.x)+(o.y-w.y)*(o.y-w.y)) AS d FROM c o JOIN c w ON o.label = 1 AND w.label = 2) SELECT id, r_id, round(d, 6) AS d, round(greatest(0.1, 1 - d/5000), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS r FROM p WHERE d <= 150) WHERE r = 1")
def jn_36_nearest_wall(spark, d):
    c = boxes(spark, d).select("id", "label", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    out = spatial.nearest(c.filter("label = 1"), c.filter("label = 2"), 150.0)
    return out.select("id", "r_id", F.round("d", 6).alias("d"), F.round(F.greatest(F.lit(0.1), 1 - F.col("d") / 5000), 6).alias("confidence"))


@register("jn_07_collinear_overlap", "WITH o AS (SELECT l_orderkey*10+l_linenumber AS id, l_partkey AS line, l_quantity::DOUBLE AS lo, l_quantity::DOUBLE + 5 AS hi FROM lineitem) SELECT a.id AS a, b.id AS b, round(least(a.hi,b.hi)-greatest(a.lo,b.lo), 6) AS length FROM o a JOIN o b ON a.line = b.line AND a.id < b.id AND least(a.hi,b.hi)-greatest(a.lo,b.lo) > 1e-6")
def jn_07_collinear_overlap(spark, d):
    q = F.col("l_quantity").cast("double")
    s = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("x0"), F.col("l_partkey").cast("double").alias("y0"), (q + 5).alias("x1"), F.col("l_partkey").cast("double").alias("y1"))
    return spatial.collinear_overlaps(s).select("a", "b", F.round("length", 6).alias("length"))


PAIR_SQL = f"{BOXES}, pairs AS (SELECT a.page, a.id AS a, b.id AS b, a.label = b.label AS same, i/greatest(1e-9, aa+ab-i) AS score FROM (SELECT *, greatest(0, least(x1,bx1)-greatest(x0,bx0))*greatest(0, least(y1,by1)-greatest(y0,by0)) AS i, (x1-x0)*(y1-y0) AS aa, (bx1-bx0)*(by1-by0) AS ab FROM (SELECT a.*, b.id AS bid, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, b.label AS blabel FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id)) a JOIN boxes b ON b.id = a.bid)"


def _pairs(spark, d):
    b = boxes(spark, d)
    p = spatial.overlap_pairs(b, b, 100.0).filter("page = r_page and id < r_id")
    box, other = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    return p.select("page", F.col("id").alias("a"), F.col("r_id").alias("b"), (F.col("label") == F.col("r_label")).alias("same"), g.iou(box, other).alias("score"))


@register("jn_27_overlap_pairs", f"WITH {PAIR_SQL} SELECT page, a, b, same, round(score, 6) AS score FROM pairs WHERE score >= 0.3")
def jn_27_overlap_pairs(spark, d):
    return _pairs(spark, d).filter("score >= 0.3").select("page", "a", "b", "same", F.round("score", 6).alias("score"))


@register("jn_28_best_match", f"WITH {PAIR_SQL} SELECT a, b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM pairs WHERE score > 0) WHERE r = 1")
def jn_28_best_match(spark, d):
    return selection.best_match(_pairs(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@register("jn_27_greedy_match")
def jn_27_greedy_match(spark, d):
    return selection.match_one_to_one(_pairs(spark, d).filter("score >= 0.3 and same"), ["page"])


@register("jn_42_reciprocal", f"WITH {PAIR_SQL}, f AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS q FROM pairs WHERE score > 0) SELECT a, b, round(score, 6) AS score FROM f WHERE r = 1 AND q = 1")
def jn_42_reciprocal(spark, d):
    return selection.reciprocal(_pairs(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@register("jn_34_adjacent_rooms", f"WITH {BOXES} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id AND a.label = b.label WHERE greatest(a.x0-b.x1, b.x0-a.x1) <= 4 AND greatest(a.y0-b.y1, b.y0-a.y1) <= 4 AND (greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) / least(a.x1-a.x0, b.x1-b.x0) >= 0.03 OR greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) / least(a.y1-a.y0, b.y1-b.y0) >= 0.03)")
def jn_34_adjacent_rooms(spark, d):
    b = boxes(spark, d)
    box, other = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    p = spatial.overlap_pairs(b, b, 100.0, pad=4.0).filter("page = r_page and id < r_id and label = r_label")
    return p.filter(g.adjacent_boxes(box, other)).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


@register("jn_32_contains", f"WITH {BOXES}, c AS (SELECT r.id AS room, s.id AS symbol, s.score FROM boxes r JOIN boxes s ON r.page = s.page AND r.label = 0 AND s.label <> 0 AND (s.x0+s.x1)/2 BETWEEN r.x0-2 AND r.x1+2 AND (s.y0+s.y1)/2 BETWEEN r.y0-2 AND r.y1+2) SELECT room, symbol FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, symbol) AS k FROM c) WHERE k <= 5")
def jn_32_contains(spark, d):
    b = boxes(spark, d)
    s = b.filter("label <> 0").withColumns({"px": (F.col("x0") + F.col("x1")) / 2, "py": (F.col("y0") + F.col("y1")) / 2}).select("id", "page", "score", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    p = spatial.overlap_pairs(b.filter("label = 0"), s, 100.0, pad=2.0).filter("page = r_page")
    best = selection.top_k(p.select(F.col("id").alias("room"), F.col("r_id").alias("symbol"), F.col("r_score").alias("score")), ["room"], [F.desc("score"), "symbol"], 5)
    return best.select("room", "symbol")


@register("tk_01_nms")
def tk_01_nms(spark, d):
    return selection.suppress(boxes(spark, d), ["page"], 0.3)


@register("tk_02_nms_by_label")
def tk_02_nms_by_label(spark, d):
    return selection.suppress(boxes(spark, d), ["page", "label"], 0.3, inclusive=True, cap=20)


@register("tk_06_top_k", f"WITH {BOXES} SELECT page, id, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS r FROM boxes) WHERE r <= 3")
def tk_06_top_k(spark, d):
    return selection.top_k(boxes(spark, d), ["page"], [F.desc("score"), "id"], 3).select("page", "id", "score")


@register("tk_07_budget")
def tk_07_budget(spark, d):
    return selection.budget(boxes(spark, d), "page", 8, 3, 30)


@register("ag_12_bounds", f"WITH {SEGMENTS} SELECT layer, min(least(x0,x1)) AS lo_x, min(least(y0,y1)) AS lo_y, max(greatest(x0,x1)) AS hi_x, max(greatest(y0,y1)) AS hi_y, round(greatest(0.5, 0.001*avg({LEN})), 6) AS tol FROM segments GROUP BY layer")
def ag_12_bounds(spark, d):
    return segments(spark, d).groupBy("layer").agg(F.min(F.least("x0", "x1")).alias("lo_x"), F.min(F.least("y0", "y1")).alias("lo_y"), F.max(F.greatest("x0", "x1")).alias("hi_x"), F.max(F.greatest("y0", "y1")).alias("hi_y"), F.round(F.greatest(F.lit(0.5), 0.001 * F.avg(_length())), 6).alias("tol"))


@register("ag_55_angle_histogram", f"WITH {SEGMENTS} SELECT floor(CASE WHEN a < 0 THEN a + 180 WHEN a >= 180 THEN a - 180 ELSE a END)::BIGINT AS bin, count(*) AS n FROM (SELECT degrees(atan2(y1-y0, x1-x0)) AS a FROM segments) GROUP BY 1")
def ag_55_angle_histogram(spark, d):
    a = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    return segments(spark, d).select(a.alias("a")).groupBy(F.floor(F.when(F.col("a") < 0, F.col("a") + 180).when(F.col("a") >= 180, F.col("a") - 180).otherwise(F.col("a"))).alias("bin")).agg(F.count("*").alias("n"))


@register("gr_16_degree_types", "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), d AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n) SELECT CASE WHEN degree <= 1 THEN 'endpoint' WHEN degree = 2 THEN 'L' WHEN degree = 3 THEN 'T' WHEN degree = 4 THEN 'X' ELSE 'multi' END AS kind, count(*) AS n, max(degree) AS most, round(avg(degree), 6) AS mean FROM d GROUP BY 1")
def gr_16_degree_types(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    return graphs.degrees(e).groupBy(graphs.degree_type(F.col("degree")).alias("kind")).agg(F.count("*").alias("n"), F.max("degree").alias("most"), F.round(F.avg("degree"), 6).alias("mean"))


@register("gr_01_components", "WITH RECURSIVE e AS (SELECT o_orderkey AS a, -1 - o_custkey AS b FROM orders), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT u AS node, u AS c FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def gr_01_components(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return graphs.components(o.select(F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b")))


@register("gr_09_nesting", f"WITH {BOXES}, r AS (SELECT id, page, x0, y0, x1, y1, (x1-x0)*(y1-y0) AS area FROM boxes), p AS (SELECT i.id, o.id AS oid, o.area FROM r i JOIN r o ON o.page = i.page AND o.area > i.area AND i.x0 >= o.x0 AND i.x0 < o.x1 AND i.y0 >= o.y0 AND i.y0 < o.y1) SELECT r.page, r.id AS ring_id, (SELECT oid FROM p WHERE p.id = r.id ORDER BY area, oid LIMIT 1) AS parent_id, (SELECT count(*) FROM p WHERE p.id = r.id) AS depth FROM r")
def gr_09_nesting(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = boxes(spark, d).select("page", F.col("id").alias("ring_id"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points"))
    return graphs.nesting(rings, "page")


@register("wn_09_merge_intervals", f"WITH {BOXES}, o AS (SELECT page, x0 AS lo, x1 AS hi, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT page, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY page, g")
def wn_09_merge_intervals(spark, d):
    return selection.merge_intervals(boxes(spark, d).select("page", F.col("x0").alias("lo"), F.col("x1").alias("hi")), ["page"], 1)


@register("st_02_segment_dedup", f"WITH {SEGMENTS} SELECT DISTINCT round(x0/50)::BIGINT AS a, round(y0/50)::BIGINT AS b, round(x1/50)::BIGINT AS c, round(y1/50)::BIGINT AS e FROM segments")
def st_02_segment_dedup(spark, d):
    return segments(spark, d).select(*(F.round(F.col(c) / 50).cast("long").alias(n) for c, n in (("x0", "a"), ("y0", "b"), ("x1", "c"), ("y1", "e")))).distinct()


@register("val_01_issues", f"WITH {SEGMENTS} SELECT 'W001' AS code, 'warning' AS severity, count(*) AS n FROM segments WHERE {LEN} < 60 UNION ALL SELECT 'W005', 'warning', count(*) FROM segments WHERE abs(x1-x0) <= 1 OR abs(y1-y0) <= 1 UNION ALL SELECT 'E001', 'error', count(*) FROM segments WHERE greatest(abs(x0), abs(x1), abs(y0), abs(y1)) > 350")
def val_01_issues(spark, d):
    checks = [("W001", "warning", _length() < 60), ("W005", "warning", (F.abs(F.col("x1") - F.col("x0")) <= 1) | (F.abs(F.col("y1") - F.col("y0")) <= 1)), ("E001", "error", F.greatest(*(F.abs(c) for c in ("x0", "x1", "y0", "y1"))) > 350)]
    return rules.issue_counts(segments(spark, d), checks)


BAND_SQL = "mats(layer, alpha) AS (VALUES ('L0', 0.02), ('L1', 0.1), ('L2', 0.25), ('L3', 0.5))"


@register("ag_02_selection_materials", f"WITH {SEGMENTS}, {REGION_SQL}, {BAND_SQL}, a AS (SELECT name, layer, sum({LEN} * 3.0 / 1e6) AS area FROM hit GROUP BY name, layer) SELECT name, a.layer, round(area, 9) AS area, round(100 * area / sum(area) OVER (PARTITION BY name), 6) AS share, round(area * alpha, 9) AS absorption FROM a LEFT JOIN mats ON mats.layer = a.layer")
def ag_02_selection_materials(spark, d):
    mats = spark.createDataFrame([("L0", 0.02), ("L1", 0.1), ("L2", 0.25), ("L3", 0.5)], "layer string, alpha double")
    return rules.selection_materials(spatial.in_regions(segments(spark, d), _regions(spark)), mats).select("name", "layer", F.round("area", 9).alias("area"), F.round("share", 6).alias("share"), F.round("absorption", 9).alias("absorption"))


@register("ag_06_reverberation", f"WITH {BOXES}, r AS (SELECT id, (x1-x0)*(y1-y0)/1e4 AS area, 2*((x1-x0)+(y1-y0))/100 AS per, 0.02 + (label % 5) * 0.1 AS alpha FROM boxes), v AS (SELECT id, alpha, area*3 AS vol, per*3+2*area AS surf FROM r), t AS (SELECT *, surf*alpha AS a FROM v) SELECT id, CASE WHEN alpha < 0.2 THEN 'sabine' ELSE 'eyring' END AS formula, round(least(10, CASE WHEN alpha < 0.2 THEN 0.161*vol/a ELSE 0.161*vol/(-surf*ln(1-least(0.99, greatest(0.01, a/surf)))) END), 6) AS t60, round(0.85*least(10, CASE WHEN alpha < 0.2 THEN 0.161*vol/a ELSE 0.161*vol/(-surf*ln(1-least(0.99, greatest(0.01, a/surf)))) END), 6) AS edt FROM t")
def ag_06_reverberation(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    r = boxes(spark, d).select("id", (w * h / 1e4).alias("area"), (2 * (w + h) / 100).alias("perimeter"), (0.02 + (F.col("label") % 5) * 0.1).alias("alpha"))
    return rules.reverberation(r, 3.0).select("id", "formula", F.round("t60", 6).alias("t60"), F.round("edt", 6).alias("edt"))
