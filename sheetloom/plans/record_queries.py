"""Entity and record queries over the test tables: attribute rules, calibration, summaries, text classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import rules
from .tables import BOXES, JUDGED, SEGMENTS, boxes, judged, read, segments

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


r6 = lambda c, n: F.round(c, 6).alias(n)
LEN = "sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))"


@register("flt_02_attribute_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') AND (nullif(p_size % 7, 0) IS NULL OR nullif(p_size % 7, 0) IN (1, 2, 3))")
def flt_02_attribute_filter(spark, d):
    return rules.attribute_filter(read(spark, d, "part").withColumn("color", F.nullif(F.col("p_size") % 7, F.lit(0))), F.lower("p_name"), ["e"], F.col("color"), [1, 2, 3]).select("p_partkey")


@register("flt_10_validity", f"WITH {SEGMENTS} SELECT id FROM segments WHERE isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND {LEN} > 1e-6 AND {LEN} < 1e6")
def flt_10_validity(spark, d):
    return segments(spark, d).filter(rules.valid_line("x0", "y0", "x1", "y1")).select("id")


@register("flt_19_line_in_viewport", f"WITH {SEGMENTS}, c AS (SELECT *, x0 BETWEEN -60 AND 40 AND y0 BETWEEN -30 AND 70 OR x1 BETWEEN -60 AND 40 AND y1 BETWEEN -30 AND 70 AS inside FROM segments), s AS (SELECT * FROM (VALUES (-60,-30,40,-30), (40,-30,40,70), (40,70,-60,70), (-60,70,-60,-30)) v(a,b,c,e)), h AS (SELECT DISTINCT id FROM c, s WHERE abs((x1-x0)*(e-b)-(y1-y0)*(c-a)) > 1e-10 AND ((a-x0)*(e-b)-(b-y0)*(c-a))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) > 0 AND ((a-x0)*(e-b)-(b-y0)*(c-a))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) < 1 AND ((a-x0)*(y1-y0)-(b-y0)*(x1-x0))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) > 0 AND ((a-x0)*(y1-y0)-(b-y0)*(x1-x0))/((x1-x0)*(e-b)-(y1-y0)*(c-a)) < 1) SELECT id FROM c WHERE inside UNION SELECT id FROM h")
def flt_19_line_in_viewport(spark, d):
    return segments(spark, d).filter(rules.line_in_view([-60.0, -30.0, 40.0, 70.0])).select("id")


@register("prj_19_pixel_scale", f"WITH {BOXES} SELECT id, CASE WHEN id % 4 = 0 THEN 0.5 WHEN id % 4 = 1 THEN round(25.4/300, 9) WHEN id % 4 = 2 THEN round(25.4/(72 + label), 9) END AS mm_per_px, CASE WHEN id % 4 <= 1 THEN 'high' WHEN id % 4 = 2 THEN 'medium' ELSE 'unknown' END AS trust FROM boxes")
def prj_19_pixel_scale(spark, d):
    k = F.col("id") % 4
    scale, trust = rules.pixel_scale(F.when(k == 0, 0.5), F.when(k == 1, 300.0), F.when(k == 2, 72.0 + F.col("label")))
    return boxes(spark, d).select("id", F.round(scale, 9).alias("mm_per_px"), trust.alias("trust"))


@register("prj_42_confidence", "SELECT event_id, greatest(0, least(1, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (value / 10)::VARCHAR END AS DOUBLE), 0.3))) AS confidence FROM events")
def prj_42_confidence(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("value") / 10).cast("string"))
    return read(spark, d, "events").select("event_id", tx.confidence(raw, 0.3).alias("confidence"))


@register("ag_36_confidence_summary", f"WITH {JUDGED} SELECT source, count(*) AS n, round(min(score), 6) AS lo, round(avg(score), 6) AS mean, round(max(score), 6) AS hi, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90 FROM judged GROUP BY source")
def ag_36_confidence_summary(spark, d):
    return judged(spark, d).groupBy("source").agg(F.count("*").alias("n"), r6(F.min("score"), "lo"), r6(F.avg("score"), "mean"), r6(F.max("score"), "hi"), *(r6(F.percentile("score", q), f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)))


@register("ag_41_split_audit", "SELECT doc_id % 3 AS split, count(*) AS records, count_if(length(trim(coalesce(text, ''))) > 0) AS with_text, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS items FROM documents GROUP BY 1")
def ag_41_split_audit(spark, d):
    text = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").groupBy((F.col("doc_id") % 3).alias("split")).agg(F.count("*").alias("records"), F.count_if(F.length(F.trim(text)) > 0).alias("with_text"), F.sum(F.size(F.split(text, "\n"))).cast("long").alias("items"))


@register("ag_52_rmse", f"WITH {SEGMENTS}, p AS (SELECT layer, x0, x1 FROM segments) SELECT layer, round(sqrt(avg((x0-x1)*(x0-x1))), 6) AS rmse FROM p GROUP BY layer")
def ag_52_rmse(spark, d):
    e = F.col("x0") - F.col("x1")
    return segments(spark, d).groupBy("layer").agg(r6(F.sqrt(F.avg(e * e)), "rmse"))


@register("ag_11_region_compare", f"WITH {SEGMENTS}, a AS (SELECT layer, sum({LEN}) AS total FROM segments GROUP BY layer) SELECT a.layer AS a, b.layer AS b, round(b.total - a.total, 4) AS diff, round(b.total / a.total, 6) AS ratio FROM a JOIN a b ON a.layer < b.layer")
def ag_11_region_compare(spark, d):
    t = segments(spark, d).groupBy("layer").agg(F.sum(g.distance(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).alias("total"))
    o = t.select(F.col("layer").alias("b"), F.col("total").alias("other"))
    return t.join(o, F.col("layer") < F.col("b")).select(F.col("layer").alias("a"), "b", F.round(F.col("other") - F.col("total"), 4).alias("diff"), r6(F.col("other") / F.col("total"), "ratio"))


@register("sf_05_text_class", r"SELECT p_partkey, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+([.][0-9]+)?$') THEN 'number' WHEN contains(t, '+/-') THEN 'tolerance' WHEN regexp_matches(t, '(?i)^(view|section)\b') THEN 'view_label' WHEN regexp_matches(t, '(?i)steel|brass|copper|nickel|tin') THEN 'material' ELSE 'note' END AS class FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size::VARCHAR WHEN p_partkey % 5 = 1 THEN p_size || ' +/- 1' ELSE p_type END AS t FROM part)")
def sf_05_text_class(spark, d):
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(" +/- 1"))).otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", tx.text_class(t).alias("class"))


@register("sf_06_dimension_parse", r"SELECT p_partkey, try_cast(regexp_extract(t, '([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS nominal, try_cast(regexp_extract(t, '(?:±|[+]/-)\s*([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS tolerance, regexp_matches(t, '[ØR]\s*[0-9]') AS round_shape FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Ø' ELSE '' END || p_size || '.5 ± 0.' || (p_partkey % 9) AS t FROM part)")
def sf_06_dimension_parse(spark, d):
    t = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Ø").otherwise(""), F.col("p_size").cast("string"), F.lit(".5 ± 0."), (F.col("p_partkey") % 9).cast("string"))
    return read(spark, d, "part").select("p_partkey", *tx.dimension(t))


@register("st_04_edge_dedup", "SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_returnflag AS relation FROM lineitem")
def st_04_edge_dedup(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation")).distinct()


@register("tk_19_group_precision", f"WITH {JUDGED}, b AS (SELECT source, CASE WHEN score < 0.4 THEN 'small' ELSE 'large' END AS bucket, (gold = pred)::INT AS hit FROM judged) SELECT source, bucket, count(*) AS n, sum(hit)::BIGINT AS tp, round(avg(hit), 6) AS precision FROM b GROUP BY GROUPING SETS ((source), (bucket), (source, bucket))")
def tk_19_group_precision(spark, d):
    b = judged(spark, d).select("source", F.when(F.col("score") < 0.4, "small").otherwise("large").alias("bucket"), F.expr("int(gold = pred)").alias("hit"))
    return b.groupingSets([["source"], ["bucket"], ["source", "bucket"]], "source", "bucket").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"), r6(F.avg("hit"), "precision"))


@register("gr_28_constraints", f"WITH {BOXES}, o AS (SELECT * FROM boxes WHERE label = 1), w AS (SELECT * FROM boxes WHERE label = 2) SELECT page, count(*) AS openings, count_if(NOT EXISTS (SELECT 1 FROM w WHERE w.page = o.page AND w.x0 <= o.x1 AND o.x0 <= w.x1 AND w.y0 <= o.y1 AND o.y0 <= w.y1)) AS without_wall FROM o GROUP BY page")
def gr_28_constraints(spark, d):
    from ..operators import spatial

    b = boxes(spark, d)
    o = b.filter("label = 1")
    met = spatial.overlap_pairs(o, b.filter("label = 2"), 100.0).filter("page = r_page").select(F.col("id").alias("met")).distinct()
    return o.join(met, F.col("id") == F.col("met"), "left").groupBy("page").agg(F.count("*").alias("openings"), F.count_if(F.col("met").isNull()).alias("without_wall"))
