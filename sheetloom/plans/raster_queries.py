"""Queries over drawings that are drawn as images: regions, strokes, faces and the primitives that fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitting, raster, scans, tracing
from .tables import SEGMENTS, read, segments

QUERIES, ORACLES = {}, {}

#: Images of eight segments each.
WIDTH, HEIGHT, PER_IMAGE = 160, 120, 8


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def images(spark: SparkSession, d: str) -> DataFrame:
    """(image, grey): the segments of eight ids each, drawn on 160 x 120 pixels."""
    at = lambda c, side: ((F.col(c) + 600) / 1200 * (side - 1)).alias(c)
    s = segments(spark, d).select(F.floor(F.col("id") / PER_IMAGE).alias("image"), at("x0", WIDTH), at("y0", HEIGHT), at("x1", WIDTH), at("y1", HEIGHT))
    return raster.drawn(s, WIDTH, HEIGHT)


INK = f"""{SEGMENTS}, scaled AS (SELECT id // 8 AS image, (x0 + 600) / 1200 * 159 AS x0, (y0 + 600) / 1200 * 119 AS y0, (x1 + 600) / 1200 * 159 AS x1, (y1 + 600) / 1200 * 119 AS y1 FROM segments),
steps AS (SELECT *, unnest(range(n + 1)) AS k FROM (SELECT *, greatest(ceil(greatest(abs(x1 - x0), abs(y1 - y0))), 1)::BIGINT AS n FROM scaled)),
ink AS MATERIALIZED (SELECT DISTINCT image, r, c FROM (SELECT image, round(x0 + (x1 - x0) * k / n)::BIGINT AS c, round(y0 + (y1 - y0) * k / n)::BIGINT AS r FROM steps) WHERE c BETWEEN 0 AND 159 AND r BETWEEN 0 AND 119)"""

#: Links of ink pixels: straight ones, and diagonal ones beside which no straight way goes.
LINKS = """links AS MATERIALIZED (
    SELECT a.image, a.r, a.c, b.r AS r2, b.c AS c2 FROM ink a, (SELECT unnest([-1, 0, 1]) AS dr) x, (SELECT unnest([-1, 0, 1]) AS dc) y, ink b
    WHERE b.image = a.image AND b.r = a.r + dr AND b.c = a.c + dc AND (dr <> 0 OR dc <> 0)
    AND (dr = 0 OR dc = 0 OR NOT EXISTS (SELECT 1 FROM ink z WHERE z.image = a.image AND ((z.r = a.r + dr AND z.c = a.c) OR (z.r = a.r AND z.c = a.c + dc)))))"""


@register("ra_05_contours", f"WITH {INK} SELECT image, count(*) AS ink, min(r) AS top, max(r) AS bottom, min(c) AS \"left\", max(c) AS \"right\" FROM ink GROUP BY image")
def ra_05_contours(spark, d):
    """Ink of each image, by way of its regions."""
    return tracing.contours(images(spark, d), WIDTH, 128).groupBy("image").agg(F.sum("n").alias("ink"), F.min("r0").cast("long").alias("top"), F.max("r1").cast("long").alias("bottom"), F.min("c0").cast("long").alias("left"), F.max("c1").cast("long").alias("right"))


@register("ra_05_borders")
def ra_05_borders(spark, d):
    """Regions of ten pixels or more with the length of their outer border."""
    return tracing.contours(images(spark, d), WIDTH, 128, least=10).select("image", "contour", "n", "r0", "c0", "r1", "c1", F.size("border").alias("around"))


@register("ra_12_strokes", f"WITH {INK}, {LINKS}, degrees AS (SELECT image, r, c, count(*) AS n FROM links GROUP BY ALL) SELECT image, CAST(count_if(n = 2) AS BIGINT) AS plain, CAST(sum(n) // 2 AS BIGINT) AS links FROM degrees GROUP BY image")
def ra_12_strokes(spark, d):
    """Plain pixels and links of each image, by way of its strokes: each is on one stroke."""
    s = tracing.strokes(images(spark, d), WIDTH)
    first = F.element_at("points", 1)
    ends = s.select("image", F.explode(F.array(first, F.element_at("points", -1))).alias("p")).groupBy("image", "p").agg(F.count("*").alias("ends"))
    rings = ends.filter("ends = 2").groupBy("image").agg(F.count("*").alias("rings"))
    sums = s.groupBy("image").agg(F.sum("n").alias("n"), F.sum(F.size("points") - 1).cast("long").alias("links"))
    return sums.join(rings, "image", "left").select("image", (F.col("n") + F.coalesce("rings", F.lit(0))).alias("plain"), "links")


@register("ra_12_skeleton_strokes")
def ra_12_skeleton_strokes(spark, d):
    """Strokes of the thinned images, their inner points moved to the weighed middle of the line."""
    s = tracing.strokes(raster.skeleton(images(spark, d), WIDTH, 128), WIDTH, refined=True)
    return s.select("image", "stroke", "closed", "n", F.round("length", 6).alias("length"))


@register("gr_19_stroke_faces")
def gr_19_stroke_faces(spark, d):
    """Faces of the thinned drawings, nested."""
    s = tracing.strokes(raster.skeleton(images(spark, d), WIDTH, 128), WIDTH)
    return tracing.stroke_faces(s).select("image", "face", "role", "edges", F.round("area", 6).alias("area"), "parent", "level")


def _points(spark, d):
    e = lambda k: F.round(F.get("embedding", F.lit(k - 1)).cast("double") * 1000, 2)
    return read(spark, d, "embeddings").select("label", F.col("vec_id").alias("k"), e(1).alias("x"), e(2).alias("y"))


@register("sc_33_theil_sen", "WITH p AS (SELECT label, round(embedding[1]::DOUBLE * 1000, 2) AS x, round(embedding[2]::DOUBLE * 1000, 2) AS y FROM embeddings), q AS (SELECT a.label, (b.y - a.y) / (b.x - a.x) AS s, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM p a JOIN p b ON a.label = b.label AND a.x < b.x) SELECT label, round(list_sort(list(s))[count(*) // 2 + 1], 6) AS slope, round(list_sort(list(c))[count(*) // 2 + 1], 4) AS intercept FROM q GROUP BY label")
def sc_33_theil_sen(spark, d):
    return fitting.line_fits(_points(spark, d), "label").select("label", F.round("a", 6).alias("slope"), F.round("c", 4).alias("intercept"))


@register("sc_32_ransac_circles")
def sc_32_ransac_circles(spark, d):
    return fitting.circle_fits(_points(spark, d), "label", limit=20.0)


@register("sc_36_best_primitive")
def sc_36_best_primitive(spark, d):
    """The primitive of each stroke of five points or more of the thinned drawings."""
    s = tracing.strokes(raster.skeleton(images(spark, d), WIDTH, 128), WIDTH).filter(F.size("points") >= 5)
    p = s.select(F.concat_ws("/", "image", "stroke").alias("stroke"), F.posexplode("points").alias("k", "p")).select("stroke", "k", "p.x", "p.y")
    return fitting.primitive_fits(p, "stroke").filter("best").select("stroke", "kind", "n", F.round("rms", 6).alias("rms"), F.round("score", 4).alias("score"))


@register("ra_14_non_local_means")
def ra_14_non_local_means(spark, d):
    """Ink that is left of each drawing after denoising, and its grey sum."""
    v = F.explode("grey").alias("v")
    return scans.non_local_means(images(spark, d), WIDTH, 200.0).select("image", v).groupBy("image").agg(F.count_if(F.col("v") > 0).alias("ink"), F.sum("v").alias("total"))


@register("ra_15_local_contrast")
def ra_15_local_contrast(spark, d):
    soft = raster.gaussian_filter(images(spark, d), WIDTH)
    return scans.local_contrast(soft, WIDTH, 4.0, 40).select("image", F.explode("grey").alias("v")).groupBy("image").agg(F.sum("v").alias("total"), F.max("v").alias("top"))


@register("ra_17_papers")
def ra_17_papers(spark, d):
    """Bright regions of a tenth of the drawing or more, where there are any."""
    return scans.papers(raster.gaussian_filter(images(spark, d), WIDTH, 4.0), WIDTH).select("image", "kind", F.round("share", 6).alias("share"))


@register("ra_18_corrected")
def ra_18_corrected(spark, d):
    """Each drawing seen through the box of its segments, a little turned."""
    box = segments(spark, d).groupBy(F.floor(F.col("id") / PER_IMAGE).alias("image")).agg(*(f(f"{c}0", f"{c}1").alias(f"{c}{k}") for c in "xy" for k, f in ((0, lambda u, v: F.min(F.least(u, v))), (1, lambda u, v: F.max(F.greatest(u, v))))))
    x0, x1 = ((F.col(c) + 600) / 1200 * (WIDTH - 1) for c in ("x0", "x1"))
    y0, y1 = ((F.col(c) + 600) / 1200 * (HEIGHT - 1) for c in ("y0", "y1"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quads = box.select("image", F.array(at(x0, y0), at(x1, y0 + 5), at(x1 - 3, y1), at(x0 + 2, y1 - 4)).alias("corners"))
    return scans.corrected(images(spark, d), quads, WIDTH).select("image", "width", "height", F.size("grey").alias("pixels"), F.aggregate("grey", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@register("ra_20_erased", f"WITH {INK}, b AS (SELECT id // 8 AS image, floor((y0 + 600) / 1200 * 119)::BIGINT AS r, floor((x0 + 600) / 1200 * 159)::BIGINT AS c FROM segments) SELECT image, CAST(count_if(NOT EXISTS (SELECT 1 FROM b WHERE b.image = i.image AND abs(i.r - b.r) <= 5 AND abs(i.c - b.c) <= 5)) AS BIGINT) AS ink FROM ink i GROUP BY image")
def ra_20_erased(spark, d):
    """Ink that is left without the squares around where segments begin."""
    at = lambda c, side: F.floor((F.col(c) + 600) / 1200 * (side - 1))
    m = segments(spark, d).select(F.floor(F.col("id") / PER_IMAGE).alias("image"), at("y0", HEIGHT).alias("r"), at("x0", WIDTH).alias("c"))
    boxes = m.select("image", (F.col("r") - 3).alias("r0"), (F.col("c") - 3).alias("c0"), (F.col("r") + 3).alias("r1"), (F.col("c") + 3).alias("c1"))
    left = scans.erased(images(spark, d), boxes, WIDTH, paper=0).select("image", F.explode("grey").alias("v"))
    return left.groupBy("image").agg(F.count_if(F.col("v") > 0).alias("ink"))
