"""Queries that decode window predictions made from the vectors, and follow chains of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chains, ownership, selection
from .tables import BOXES, SEGMENTS, boxes, read, segments

QUERIES, ORACLES = {}, {}

#: A vector is a query: eight to a window, five windows to a page; the last label stands for no object, the two before are stuff.
PER_WINDOW, WINDOWS, LABELS, IGNORE, STUFF, PRIMITIVES = 8, 5, 6, 5, (3, 4), 16


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _values(first: int, n: int, scale: float):
    return F.transform(F.slice("embedding", first, n), lambda v: v.cast("double") * scale)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select(F.floor(v / (PER_WINDOW * WINDOWS)).alias("page"), F.floor(v % (PER_WINDOW * WINDOWS) / PER_WINDOW).cast("int").alias("win"), (v % PER_WINDOW).cast("int").alias("query"), "embedding")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """queries, masks, owners, nulls; a window shares half of its primitives with the next."""
    w = _windows(spark, d)
    primitive = (F.col("win") * (PRIMITIVES // 2) + F.col("k")).cast("long").alias("primitive")
    rows = lambda first, name: w.select("page", "win", "query", F.posexplode(_values(first, PRIMITIVES, 12.0)).alias("k", name)).select("page", "win", "query", primitive, name)
    queries = w.select("page", "win", "query", _values(1, LABELS, 10.0).alias("logits"), (F.get("embedding", F.lit(14)).cast("double") * 5).alias("quality"), _values(7, 8, 1.0).alias("identity"))
    nulls = rows(49, "null_logit").groupBy("page", "win", "primitive").agg(F.min("null_logit").alias("null_logit"))
    return queries, rows(17, "logit"), rows(33, "logit"), nulls


@register("ml_20_admission", """
WITH q AS (SELECT vec_id // 40 AS page, CAST(vec_id % 40 // 8 AS INT) AS win, CAST(vec_id % 8 AS INT) AS query, list_transform(embedding[1:6], lambda v: v::DOUBLE * 10) AS l, embedding[15]::DOUBLE * 5 AS quality, embedding[17:32] AS m FROM embeddings),
p AS (SELECT *, list_max(l[1:5]) AS top, list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS total, list_filter(list_transform(m, lambda v: 1 / (1 + exp(-12 * v::DOUBLE))), lambda v: v > 0.01) AS held FROM q),
s AS (SELECT page, win, query, CAST(list_position(l[1:5], top) - 1 AS INT) AS label, exp(top - list_max(l)) / total AS class_score, top - l[6] AS margin, 1 / (1 + exp(-quality)) AS quality_score, coalesce(list_avg(held), 0) AS mask_score, l[6] > top AS empty_ FROM p)
SELECT page, win, query, label, round(class_score, 6) AS class_score, round(margin, 6) AS margin, round(class_score * quality_score * mask_score, 6) AS score,
    CASE WHEN empty_ THEN 'no_object' WHEN margin < 0.5 THEN 'low_object_margin' WHEN class_score * quality_score * mask_score < 0.1 THEN 'low_score' END AS reason FROM s""")
def ml_20_admission(spark, d):
    q, m, _, _ = _tables(spark, d)
    judged = ownership.admitted_queries(q, m, IGNORE, least_score=0.1, least_margin=0.5)
    return judged.select("page", "win", "query", "label", F.round("class_score", 6).alias("class_score"), F.round("margin", 6).alias("margin"), F.round("score", 6).alias("score"), "reason")


@register("ml_20_grown_masks")
def ml_20_grown_masks(spark, d):
    """Masks of admitted queries, grown to near primitives; a primitive's points are three places of its window's first query."""
    q, m, _, nulls = _tables(spark, d)
    judged = ownership.admitted_queries(q, m, IGNORE, least_score=0.1)
    v = lambda k: F.col("null_logit") * k % 40.0
    places = nulls.groupBy("page", "primitive").agg(F.min("null_logit").alias("null_logit")).select("page", "primitive", F.array(*(F.struct(v(a).alias("x"), v(b).alias("y")) for a, b in ((7, 11), (13, 17), (10, 14)))).alias("points"))
    return ownership.grown(ownership.selected(m, judged, 0.7), m, places, 0.5, 4.0, 0.5).select(*ownership.QUERY, "primitive", "added", F.round("p", 6).alias("p"))


@register("ml_21_owners")
def ml_21_owners(spark, d):
    """The owner of every primitive over all windows of its page."""
    q, m, o, nulls = _tables(spark, d)
    judged = ownership.admitted_queries(q, m, IGNORE, least_score=0.05)
    owners = ownership.primitive_owners(ownership.query_tracks(judged, m, STUFF), m, o, nulls)
    return owners.select("page", "primitive", "track", F.round("evidence", 6).alias("evidence"))


@register("ml_21_instances")
def ml_21_instances(spark, d):
    q, m, o, nulls = _tables(spark, d)
    judged = ownership.admitted_queries(q, m, IGNORE, least_score=0.05)
    tracks = ownership.query_tracks(judged, m, STUFF)
    return ownership.track_instances(judged, tracks, ownership.primitive_owners(tracks, m, o, nulls))


@register("gr_17_auto_trace", """SELECT min(vec_id) OVER (PARTITION BY label) AS pick, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, vec_id AS id, true AS forward, true AS closed FROM embeddings""")
def gr_17_auto_trace(spark, d):
    """The ring through the points of each label in the order of ids, followed from its first segment."""
    w = W.partitionBy("label").orderBy("vec_id")
    at = F.struct((F.get("embedding", F.lit(0)).cast("double") * 1000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 1000).alias("y"))
    e = read(spark, d, "embeddings").select("label", "vec_id", at.alias("a"))
    ring = e.select("label", F.col("vec_id").alias("id"), "a", F.coalesce(F.lead("a").over(w), F.first("a").over(w)).alias("b"))
    s = ring.select("id", "label", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    return chains.auto_trace(s.drop("label"), s.groupBy("label").agg(F.min("id").alias("id")).select("id"), 1e-6).select("pick", "k", "id", "forward", "closed")


@register("jn_43_ends_on_segments", f"WITH {SEGMENTS}, e AS (SELECT id, 0 AS \"end\", x0 AS x, y0 AS y FROM segments UNION ALL SELECT id, 1, x1, y1 FROM segments) SELECT e.id, e.\"end\", s.id AS \"on\" FROM e JOIN segments s ON e.id <> s.id AND abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 5 AND x BETWEEN least(x0, x1) - 5 AND greatest(x0, x1) + 5 AND y BETWEEN least(y0, y1) - 5 AND greatest(y0, y1) + 5")
def jn_43_ends_on_segments(spark, d):
    return chains.ends_on_segments(segments(spark, d), 5.0)


@register("tk_09_assignments", f"""
WITH {BOXES}, p AS (SELECT a.page, a.id AS item, b.label AS owner, b.id, a.score * b.score AS score, b.score AS second FROM boxes a JOIN boxes b ON a.page = b.page AND a.id <> b.id AND a.label < 2 AND b.label >= 2 AND a.score * b.score >= 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY item, owner ORDER BY score DESC, second DESC, id) AS k, max(score) OVER (PARTITION BY item, owner) AS best FROM p),
f AS (SELECT *, max(CASE WHEN k = 1 THEN second END) OVER (PARTITION BY item, owner) AS best2 FROM r),
o AS (SELECT *, dense_rank() OVER (PARTITION BY item ORDER BY best DESC, best2 DESC, owner) AS n FROM f),
q AS (SELECT *, n <= 3 AND k <= 2 AS chosen FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY item, chosen ORDER BY score DESC, second DESC, id) AS rest FROM q)
SELECT page, item, owner, id, CASE WHEN chosen THEN 'assigned' ELSE 'overflow' END AS reason FROM z WHERE chosen OR rest <= 2""")
def tk_09_assignments(spark, d):
    """Boxes of other labels for each box of the first two, by label: the two best of the three best labels, and two more."""
    b = boxes(spark, d).select("page", "id", "label", "score")
    other = b.filter("label >= 2").select("page", F.col("id").alias("other"), F.col("label").alias("owner"), F.col("score").alias("second"))
    p = b.filter("label < 2").join(other, "page").select("page", F.col("id").alias("item"), "owner", F.col("other").alias("id"), (F.col("score") * F.col("second")).alias("score"), "second")
    return selection.assignments(p, ["item"], "owner", 0.01, 3, 2, 2).select("page", "item", "owner", "id", "reason")
