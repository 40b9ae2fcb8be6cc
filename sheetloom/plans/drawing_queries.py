"""Drawing, raster and model queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawing, models, raster
from .tables import BOXES, SEGMENTS, boxes, judged, read, segments

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


r6 = lambda c, n: F.round(c, 6).alias(n)
ENDS = "e AS (SELECT id, 0 AS k, x0 AS x, y0 AS y FROM segments UNION ALL SELECT id, 1, x1, y1 FROM segments), p AS (SELECT a.id AS a, a.k AS ea, b.id AS b, b.k AS eb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM e a JOIN e b ON a.id < b.id)"


@register("jn_16_gap_candidates", f"WITH {SEGMENTS}, {ENDS} SELECT a, ea, b, eb, round(d, 6) AS d FROM p WHERE d <= 10")
def jn_16_gap_candidates(spark, d):
    return drawing.gap_candidates(segments(spark, d), 10.0).select("a", "ea", "b", "eb", r6("d", "d"))


@register("jn_17_connectable", f"WITH {SEGMENTS}, {ENDS}, u AS (SELECT id, (x1-x0)/n AS ux, (y1-y0)/n AS uy FROM (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS n FROM segments) WHERE n > 0) SELECT a, ea, b, eb, round(d, 6) AS d FROM p JOIN u ON u.id = a JOIN u v ON v.id = b WHERE d <= 20 AND abs(u.ux*v.ux+u.uy*v.uy) >= 0.95")
def jn_17_connectable(spark, d):
    return drawing.gap_candidates(segments(spark, d), 20.0, 0.95).select("a", "ea", "b", "eb", r6("d", "d"))


@register("gr_20_gap_fill")
def gr_20_gap_fill(spark, d):
    return drawing.fill_gaps(segments(spark, d), 12.0).select("a", "ea", "b", "eb", r6("d", "d"))


def _corners(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes(spark, d).select(F.col("id").alias("ring"), F.posexplode(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).alias("idx", "p")).select("ring", "idx", "p.x", "p.y")


@register("wn_02_vertex_turns", f"WITH {BOXES}, v AS (SELECT id AS ring, unnest([0,1,2,3]) AS idx, unnest([x0,x1,x1,x0]) AS x, unnest([y0,y0,y1,y1]) AS y, unnest([x1-x0,y1-y0,x1-x0,y1-y0]) AS length FROM boxes) SELECT ring, idx, round(length, 6) AS length, 90.0::DOUBLE AS turn FROM v")
def wn_02_vertex_turns(spark, d):
    return drawing.vertex_turns(_corners(spark, d)).select("ring", "idx", r6("length", "length"), r6("turn", "turn"))


@register("ag_20_convex_hull")
def ag_20_convex_hull(spark, d):
    return drawing.convex_hulls(segments(spark, d).select("layer", F.col("x0").alias("x"), F.col("y0").alias("y")), "layer")


@register("sc_34_line_fit", f"WITH {SEGMENTS} SELECT layer, round(regr_slope(y0, x0), 6) AS slope, round(regr_intercept(y0, x0), 6) AS intercept, round(sqrt(greatest(0, var_pop(y0) - regr_slope(y0, x0) * covar_pop(x0, y0))), 6) AS rms, count(*) AS n FROM segments GROUP BY layer")
def sc_34_line_fit(spark, d):
    return drawing.line_fits(segments(spark, d).select("layer", F.col("x0").alias("x"), F.col("y0").alias("y")), "layer").select("layer", r6("slope", "slope"), r6("intercept", "intercept"), r6("rms", "rms"), "n")


@register("sc_31_circle_fit", f"WITH {BOXES} SELECT id AS ring, round((x0+x1)/2, 4) AS cx, round((y0+y1)/2, 4) AS cy, round(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/2, 4) AS r FROM boxes")
def sc_31_circle_fit(spark, d):
    f = drawing.circle_fits(_corners(spark, d), "ring")
    return f.select("ring", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "r")))


@register("jn_33_bounded_by", f"""WITH {BOXES}, p AS (SELECT r.id AS room, w.id AS wall, r.x0, r.y0, r.x1, r.y1, w.x0 AS a, w.y0 AS b, w.x1 AS c, w.y1 AS e FROM boxes r JOIN boxes w ON r.label = 0 AND w.label = 4 AND r.x0 <= w.x1+10 AND w.x0-10 <= r.x1 AND r.y0 <= w.y1+10 AND w.y0-10 <= r.y1),
s AS (SELECT *, [abs((a+c)/2-x0), abs((a+c)/2-x1), abs((b+e)/2-y0), abs((b+e)/2-y1)] AS g FROM p), t AS (SELECT *, list_min(g) AS gap, list_position(g, list_min(g)) AS k FROM s),
u AS (SELECT room, wall, ['left','right','top','bottom'][k] AS side, gap, CASE WHEN k <= 2 THEN greatest(0, least(y1,e)-greatest(y0,b))/least(y1-y0, e-b) ELSE greatest(0, least(x1,c)-greatest(x0,a))/least(x1-x0, c-a) END AS ratio FROM t)
SELECT room, wall, side, round(gap, 6) AS gap, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY gap, ratio DESC, wall) AS n FROM u WHERE gap <= 10 AND ratio >= 0.08) WHERE n <= 12""")
def jn_33_bounded_by(spark, d):
    b = boxes(spark, d)
    return drawing.bounded_by(b.filter("label = 0"), b.filter("label = 4"), 10.0, 0.08, 12).select("room", "wall", "side", r6("gap", "gap"), r6("ratio", "ratio"))


@register("jn_29_cover_recall", f"WITH {BOXES}, p AS (SELECT g.id, g.x0, g.y0, g.x1, g.y1, f.x0 AS a, f.y0 AS b, f.x1 AS c, f.y1 AS e FROM boxes g JOIN boxes f ON g.page = f.page AND g.label = 1 AND f.label = 2), q AS (SELECT *, greatest(0, least(x1,c)-greatest(x0,a))*greatest(0, least(y1,e)-greatest(y0,b)) AS i FROM p) SELECT DISTINCT id FROM q WHERE ((x0+x1)/2 BETWEEN a-2 AND c+2 AND (y0+y1)/2 BETWEEN b-2 AND e+2) OR i/greatest(1e-9, (x1-x0)*(y1-y0)+(c-a)*(e-b)-i) >= 0.3")
def jn_29_cover_recall(spark, d):
    b = boxes(spark, d)
    return drawing.recall_by_cover(b.filter("label = 1"), b.filter("label = 2"))


@register("tk_08_multi_cap")
def tk_08_multi_cap(spark, d):
    return drawing.multi_cap(boxes(spark, d).withColumn("side", F.col("id") % 3), {"label": 4, "side": 9})


@register("sc_11_simplify")
def sc_11_simplify(spark, d):
    p = segments(spark, d).select("layer", F.col("id").alias("idx"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return drawing.simplify(p, "layer", 40.0)


@register("ag_50_hausdorff", f"WITH {SEGMENTS}, p AS (SELECT a.layer, a.id AS i, b.id AS j, sqrt((a.x0-b.x1)*(a.x0-b.x1)+(a.y0-b.y1)*(a.y0-b.y1)) AS d FROM segments a JOIN segments b ON a.layer = b.layer), i AS (SELECT layer, max(d) AS m, avg(d) AS v FROM (SELECT layer, i, min(d) AS d FROM p GROUP BY ALL) GROUP BY layer), j AS (SELECT layer, max(d) AS m, avg(d) AS v FROM (SELECT layer, j, min(d) AS d FROM p GROUP BY ALL) GROUP BY layer) SELECT layer, round(greatest(i.m, j.m), 6) AS hausdorff, round(i.v + j.v, 6) AS chamfer FROM i JOIN j USING (layer)")
def ag_50_hausdorff(spark, d):
    s = segments(spark, d)
    p = lambda x, y: s.select("layer", F.col("id").alias("idx"), F.col(x).alias("x"), F.col(y).alias("y"))
    return drawing.chamfer(p("x0", "y0"), p("x1", "y1"), "layer").select("layer", r6("hausdorff", "hausdorff"), r6("chamfer", "chamfer"))


@register("gr_30_scene_contract", "SELECT * FROM (SELECT 'no_label' AS code, 0::BIGINT AS n UNION ALL SELECT 'bad_box', 0 UNION ALL SELECT 'unknown_end', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT vec_id FROM embeddings) OR l_partkey NOT IN (SELECT vec_id FROM embeddings)) UNION ALL SELECT 'loop', (SELECT count(*) FROM lineitem WHERE l_orderkey = l_partkey) UNION ALL SELECT 'bad_relation', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')))")
def gr_30_scene_contract(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"))
    return drawing.scene_problems(boxes(spark, d), e, ["A", "N"])


@register("prj_12_arc_points", f"WITH {BOXES}, a AS (SELECT id, x0 AS cx, y0 AS cy, x1-x0 AS r, radians(120) AS span, 2*acos(greatest(-1, 1 - 0.5/greatest(x1-x0, 0.5))) AS step FROM boxes), n AS (SELECT *, greatest(1, ceil(span/step))::BIGINT AS n FROM a), k AS (SELECT *, unnest(range(n+1)) AS k FROM n) SELECT id, k, round(cx + r*cos(radians(30)+span*k/n), 5) AS x, round(cy + r*sin(radians(30)+span*k/n), 5) AS y FROM k")
def prj_12_arc_points(spark, d):
    p = drawing.arc_points(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.lit(30.0), F.lit(150.0), 0.5)
    return boxes(spark, d).select("id", F.posexplode(p).alias("k", "p")).select("id", "k", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


GREY = "px AS (SELECT vec_id AS image, i AS k, least(255, greatest(0, floor(embedding[i+1]::DOUBLE * 400 + 128)))::INT AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"


def _images(spark, d):
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 400 + 128))).cast("int"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("image"), grey.alias("grey"))


@register("ra_21_quality", f"WITH {GREY} SELECT image, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS contrast, round(count_if(v < 64) / count(*), 6) AS dark FROM px GROUP BY image")
def ra_21_quality(spark, d):
    return raster.quality(_images(spark, d)).select("image", r6("mean", "mean"), r6("contrast", "contrast"), r6("dark", "dark"))


@register("ra_03_sobel", f"WITH {GREY}, g AS (SELECT image, k // 8 AS r, k % 8 AS c, v FROM px), s AS (SELECT a.image, a.r, a.c, sum(b.v * (b.c - a.c) * (2 - abs(b.r - a.r))) AS gx, sum(b.v * (b.r - a.r) * (2 - abs(b.c - a.c))) AS gy FROM g a JOIN g b ON a.image = b.image AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 WHERE a.r BETWEEN 1 AND 6 AND a.c BETWEEN 1 AND 6 GROUP BY ALL) SELECT image, count_if(sqrt(gx*gx+gy*gy) >= 150) AS edges FROM s GROUP BY image")
def ra_03_sobel(spark, d):
    return raster.sobel(_images(spark, d), 8, 150.0)


@register("ra_01_otsu")
def ra_01_otsu(spark, d):
    return raster.otsu(_images(spark, d))


@register("gr_04_ink_components", f"WITH RECURSIVE {GREY}, g AS (SELECT image, k // 8 AS r, k % 8 AS c, k FROM px WHERE v >= 150), e AS (SELECT a.image, a.k AS u, b.k AS w FROM g a JOIN g b ON a.image = b.image AND abs(a.r-b.r)+abs(a.c-b.c) = 1), t AS (SELECT image, k, k AS m FROM g UNION SELECT e.image, e.w, t.m FROM t JOIN e ON e.image = t.image AND e.u = t.k), m AS (SELECT image, k, min(m) AS m FROM t GROUP BY ALL) SELECT image, count(*) AS n, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1 FROM m JOIN g USING (image, k) GROUP BY image, m")
def gr_04_ink_components(spark, d):
    return raster.ink_components(_images(spark, d), 8, 150).select("image", "n", "r0", "c0", "r1", "c1")


@register("ml_01_logistic")
def ml_01_logistic(spark, d):
    rows, _ = models.standardised(judged(spark, d).withColumn("size", F.log1p(F.col("score"))), ["size", "score"])
    return models.score_logistic(rows, ["size", "score"], models.fit_logistic(rows, ["size", "score"], "gold")).select("id", "gold", "score")


@register("ra_02_threshold", f"WITH {GREY} SELECT image, count_if(v > 150) AS ink, count_if(NOT v > 150) AS paper FROM px GROUP BY image")
def ra_02_threshold(spark, d):
    n = lambda inverse: raster.threshold(_images(spark, d), 150, inverse).select("image", F.size(F.filter("grey", lambda v: v == 255)).cast("long").alias("paper" if inverse else "ink"))
    return n(False).join(n(True), "image")


@register("ra_13_median", f"WITH {GREY}, g AS (SELECT image, k // 8 AS r, k % 8 AS c, v FROM px), w AS (SELECT a.image, a.r, a.c, quantile_cont(b.v, 0.5) AS m FROM g a, (SELECT unnest([-1,0,1]) AS dr) x, (SELECT unnest([-1,0,1]) AS dc) y, g b WHERE b.image = a.image AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc)) GROUP BY ALL) SELECT image, sum(m)::BIGINT AS total FROM w GROUP BY image")
def ra_13_median(spark, d):
    m = raster.median_filter(_images(spark, d), 8)
    return m.select("image", F.aggregate("grey", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@register("ra_32_crops", f"WITH {GREY}, g AS (SELECT image, k // 8 AS r, k % 8 AS c, v FROM px) SELECT image, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM g WHERE r BETWEEN 1 AND 4 AND c BETWEEN 2 AND 6 GROUP BY image")
def ra_32_crops(spark, d):
    i = _images(spark, d)
    crops = i.select("image", F.lit(1).alias("crop"), F.lit(1).alias("r0"), F.lit(2).alias("c0"), F.lit(5).alias("r1"), F.lit(7).alias("c1"))
    return raster.crop_statistics(i, crops, 8).select("image", "n", r6("mean", "mean"), r6("deviation", "deviation"))


@register("wn_15_peaks", f"WITH {GREY}, g AS (SELECT image, k // 8 AS r, k % 8 AS c, v FROM px) SELECT a.image, a.r::INT AS r, a.c::INT AS c, a.v::DOUBLE AS score FROM g a WHERE a.v > 170 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.image = a.image AND abs(b.r-a.r) <= 1 AND abs(b.c-a.c) <= 1 AND b.v > a.v)")
def wn_15_peaks(spark, d):
    return raster.peak_boxes(_images(spark, d), 8, 170, 1, 4.0).select("image", "r", "c", "score")


@register("ra_07_skeleton")
def ra_07_skeleton(spark, d):
    return raster.skeleton(_images(spark, d), 8, 150)


@register("ra_11_junctions")
def ra_11_junctions(spark, d):
    return raster.junctions(raster.without_spurs(raster.skeleton(_images(spark, d), 8, 150, "guo_hall"), 8, 3), 8)


@register("ra_34_mask_boxes")
def ra_34_mask_boxes(spark, d):
    return raster.mask_boxes(_images(spark, d), 8, 150, (2, 40), (1, 8), 3)


@register("prj_13_bulges", f"WITH {SEGMENTS}, b AS (SELECT id, x0, y0, x1, y1, (id % 5 - 2) * 0.25 AS bulge, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS n FROM segments), r AS (SELECT *, n/2/abs(sin(2*atan(bulge))) AS r FROM b WHERE bulge <> 0), k AS (SELECT id, greatest(1, ceil(abs(4*atan(bulge)) / (2*acos(greatest(-1, 1 - 0.5/greatest(r, 0.5))))))::INT + 1 AS points FROM r) SELECT b.id, coalesce(points, 2) AS points FROM b LEFT JOIN k USING (id)")
def prj_13_bulges(spark, d):
    from ..functions import curves

    p = curves.bulge_points(*map(F.col, ("x0", "y0", "x1", "y1")), (F.col("id") % 5 - 2) * 0.25, 0.5)
    return segments(spark, d).select("id", F.size(p).alias("points"))


@register("prj_14_ellipses", f"WITH {BOXES}, e AS (SELECT id, x0, y0, (x1-x0)/2 AS a, 0.5*(x1-x0)/2 AS b FROM boxes), k AS (SELECT *, greatest(8, ceil((a+b)/2*radians(270)/(2*sqrt(2*0.5*(a+b)/2))))::INT AS k FROM e), i AS (SELECT *, unnest(range(k+1)) AS i FROM k) SELECT id, i::INT AS i, round(x0 + a*cos(radians(270)*i/k), 4) AS x, round(y0 + b*sin(radians(270)*i/k), 4) AS y FROM i")
def prj_14_ellipses(spark, d):
    from ..functions import curves

    p = curves.ellipse_points(F.col("x0"), F.col("y0"), (F.col("x1") - F.col("x0")) / 2, F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(270.0), 0.5)
    return boxes(spark, d).select("id", F.posexplode(p).alias("i", "p")).select("id", "i", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@register("prj_15_splines")
def prj_15_splines(spark, d):
    from ..functions import curves

    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = boxes(spark, d).select("id", F.lit(2).alias("degree"), F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0))).alias("knots"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points"), F.lit(None).cast("array<double>").alias("weights"))
    return curves.spline_points(c, 0.5)
