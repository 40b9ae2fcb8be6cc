"""Evaluation, rank, sample and split queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import sets
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
HITS = f"{BOXES}, hits AS (SELECT *, label IN (1, 3) AND score > 0.05 AS hit, floor(log2((x1-x0)*(y1-y0)) / 2)::INT AS bucket FROM boxes)"


def _hits(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes(spark, d).withColumns({"hit": F.col("label").isin(1, 3) & (F.col("score") > 0.05), "bucket": F.floor(F.log2(area) / 2).cast("int")})


@register("ag_27_relations_by_type", "WITH g AS (SELECT DISTINCT l_returnflag AS relation, l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT l_returnflag AS relation, l_partkey AS a, l_suppkey AS b, row_number() OVER (PARTITION BY l_returnflag, l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem WHERE l_linenumber >= 3), j AS (SELECT coalesce(g.relation, f.relation) AS relation, g.relation IS NOT NULL AS is_gold, k FROM g FULL JOIN f USING (relation, a, b)), c AS (SELECT relation, count_if(is_gold AND k = 1)::DOUBLE AS tp, count_if(NOT is_gold)::DOUBLE AS fp, count_if(k IS NULL)::DOUBLE AS fn, count_if(is_gold AND k > 1)::DOUBLE AS duplicates FROM j GROUP BY 1) SELECT *, round(coalesce(tp/nullif(tp+fp,0),0), 6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0), 6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0), 6) AS f1 FROM c")
def ag_27_relations_by_type(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    out = ev.relation_metrics_by_type(r.filter("l_linenumber <= 3"), r.filter("l_linenumber >= 3"), ["a", "b"], "relation", "row")
    return out.select("relation", "tp", "fp", "fn", "duplicates", *(r6(c, c) for c in ("precision", "recall", "f1")))


@register("ag_29_pooled", f"WITH {JUDGED}, c AS (SELECT count_if(gold=1 AND pred=1)::DOUBLE AS tp, count_if(gold=0 AND pred=1)::DOUBLE AS fp, count_if(gold=1 AND pred=0)::DOUBLE AS fn FROM judged) SELECT tp, fp, fn, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall, round(2*tp/(2*tp+fp+fn), 6) AS f1 FROM c")
def ag_29_pooled(spark, d):
    c = judged(spark, d).groupBy("source").agg(F.count_if(F.expr("gold=1 and pred=1")).alias("tp"), F.count_if(F.expr("gold=0 and pred=1")).alias("fp"), F.count_if(F.expr("gold=1 and pred=0")).alias("fn"))
    return ev.pooled(c).select("tp", "fp", "fn", *(r6(x, x) for x in ("precision", "recall", "f1")))


@register("ag_31_paired_bootstrap")
def ag_31_paired_bootstrap(spark, d):
    j = judged(spark, d).select("id", (F.col("pred") == F.col("gold")).cast("double").alias("base"), ((F.col("score") > 0.5).cast("int") == F.col("gold")).cast("double").alias("other"))
    return ev.paired_bootstrap(j, "base", "other", "id")


@register("ag_32_bootstrap")
def ag_32_bootstrap(spark, d):
    return ev.bootstrap_interval(judged(spark, d), "pred", "id")


@register("ag_44_group_statistics", f"WITH {HITS} SELECT label, bucket, count_if(hit) AS tp, count_if(NOT hit) AS fp, round(avg(hit::INT), 6) AS precision FROM hits GROUP BY ALL")
def ag_44_group_statistics(spark, d):
    return ev.group_statistics(_hits(spark, d), ["label", "bucket"]).select("label", "bucket", "tp", "fp", r6("precision", "precision"))


@register("ag_46_cap_sweep", f"WITH {HITS}, r AS (SELECT hit, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY page ORDER BY (x1-x0)*(y1-y0), id) AS b FROM hits), c AS (SELECT unnest([1, 5, 20, 50]) AS cap) SELECT 'score' AS ranking, cap, count_if(hit AND a <= cap) AS hits, round(count_if(hit AND a <= cap) / nullif((SELECT count_if(hit) FROM hits), 0), 6) AS recall FROM r, c GROUP BY cap UNION ALL SELECT 'size', cap, count_if(hit AND b <= cap), round(count_if(hit AND b <= cap) / nullif((SELECT count_if(hit) FROM hits), 0), 6) FROM r, c GROUP BY cap")
def ag_46_cap_sweep(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    out = ev.cap_sweep(_hits(spark, d), "page", {"score": [F.desc("score"), "id"], "size": [area, "id"]}, [1, 5, 20, 50])
    return out.select("ranking", "cap", "hits", r6("recall", "recall"))


@register("ag_56_probability_r2", f"WITH {BOXES}, p AS (SELECT label % 3 AS y, [score, 0.3, 0.7 - score]::DOUBLE[] AS p FROM boxes), f AS (SELECT y, unnest([0,1,2]) AS k, unnest(p) AS p FROM p), t AS (SELECT k, p, (y = k)::INT::DOUBLE AS t FROM f) SELECT round(1 - sum(e) / sum(v * n), 6) AS r2 FROM (SELECT k, sum((t-p)*(t-p)) AS e, var_pop(t) AS v, count(*) AS n FROM t GROUP BY k)")
def ag_56_probability_r2(spark, d):
    p = boxes(spark, d).select((F.col("label") % 3).alias("y"), F.array(F.col("score"), F.lit(0.3), 0.7 - F.col("score")).alias("probs"))
    return ev.probability_r2(p, 3).select(r6("r2", "r2"))


@register("ag_54_vectorise_quality", f"WITH {SEGMENTS}, l AS (SELECT layer, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS length, id % 4 <> 0 AS on_ink FROM segments), a AS (SELECT layer, sum(length) AS s, sum(CASE WHEN on_ink THEN length END) AS i, avg((length > 1)::INT) AS accuracy FROM l GROUP BY layer), b AS (SELECT layer, sum(abs(x0)/10) AS g FROM segments WHERE id % 5 = 0 GROUP BY layer), q AS (SELECT layer, coalesce(i/nullif(s,0),0) AS complete, coalesce(s/nullif(s+coalesce(g,0),0),0) AS whole, accuracy FROM a LEFT JOIN b USING (layer)) SELECT layer, round(complete, 6) AS completeness, round(whole, 6) AS continuity, round(accuracy, 6) AS accuracy, round((complete+whole+accuracy)/3, 6) AS total FROM q")
def ag_54_vectorise_quality(spark, d):
    from ..functions import geometry as g

    s = segments(spark, d)
    lines = s.select("layer", g.distance(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("length"), (F.col("id") % 4 != 0).alias("on_ink"))
    out = ev.vectorise_quality(lines, s.filter("id % 5 = 0").select("layer", (F.abs("x0") / 10).alias("d")), "layer")
    return out.select("layer", *(r6(c, c) for c in ("completeness", "continuity", "accuracy", "total")))


@register("ag_14_graph_statistics", "WITH n AS (SELECT p_partkey AS id FROM part), e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT round(avg(coalesce(k, 0)), 6) FROM n LEFT JOIN d USING (id)) AS mean_degree, (SELECT max(coalesce(k, 0)) FROM n LEFT JOIN d USING (id)) AS max_degree")
def ag_14_graph_statistics(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return ev.graph_statistics(read(spark, d, "part").select(F.col("p_partkey").alias("id")), e).select("nodes", "edges", r6("mean_degree", "mean_degree"), "max_degree")


@register("ag_59_dataset_summary", "SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS size, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY ALL")
def ag_59_dataset_summary(spark, d):
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long")
    return sets.dataset_summary(read(spark, d, "documents").withColumn("size", size), ["lang", "size"], "n_chars")


@register("ag_60_benchmark_summary", "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value) - min(value), 6) AS spread, avg(value) > quantile_cont(value, 0.5) * 1.1 AS slow FROM events GROUP BY event_type")
def ag_60_benchmark_summary(spark, d):
    out = ev.benchmark_summary(read(spark, d, "events").select(F.col("event_type").alias("name"), "value"))
    return out.select("name", "n", r6("mean", "mean"), r6("median", "median"), r6("spread", "spread"), "slow")


@register("ml_05_threshold", f"WITH {JUDGED}, t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count_if(score >= threshold AND gold = 1)::DOUBLE AS tp, count_if(score >= threshold AND gold = 0)::DOUBLE AS fp, count_if(score < threshold AND gold = 1)::DOUBLE AS fn FROM judged, t GROUP BY threshold) SELECT threshold, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0), 6) AS f1 FROM c ORDER BY coalesce(2*tp/nullif(2*tp+fp+fn,0),0) DESC, abs(threshold - 0.7), threshold LIMIT 1")
def ml_05_threshold(spark, d):
    from ..operators import metrics

    sweep = metrics.threshold_sweep(judged(spark, d), [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])
    return ev.select_threshold(sweep).select("threshold", r6("f1", "f1"))


@register("tk_18_policy", f"WITH {HITS}, p(name, cut) AS (VALUES ('a', 0.02), ('b', 0.06), ('c', 0.1), ('d', 0.2)), c AS (SELECT name, cut::DOUBLE AS cut, count_if(hit AND score >= cut) AS hits, count_if(hit AND score >= cut) / nullif(count_if(score >= cut), 0) AS precision FROM hits, p GROUP BY ALL) SELECT name, cut, hits, round(precision, 6) AS precision FROM c WHERE precision >= 0.1 ORDER BY hits DESC, cut DESC LIMIT 1")
def tk_18_policy(spark, d):
    policies = spark.createDataFrame([("a", 0.02), ("b", 0.06), ("c", 0.1), ("d", 0.2)], "name string, cut double")
    return ev.choose_policy(_hits(spark, d), policies, 0.1).select("name", "cut", "hits", r6("precision", "precision"))


LEVELS = [["label", "bucket"], ["label"], ["bucket"]]


@register("ml_04_calibration", f"WITH {HITS}, t AS (SELECT *, hit::INT::DOUBLE AS y FROM hits WHERE id % 2 = 0), p AS (SELECT avg(y) AS p FROM t), a AS (SELECT label, bucket, (sum(y) + 2*any_value(p))/(count(*)+2) AS r FROM t, p GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT label, (sum(y) + 2*any_value(p))/(count(*)+2) AS r FROM t, p GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT bucket, (sum(y) + 2*any_value(p))/(count(*)+2) AS r FROM t, p GROUP BY ALL HAVING count(*) >= 3) SELECT id, round(coalesce(a.r, b.r, c.r, p), 6) AS rate, CASE WHEN a.r IS NOT NULL THEN 0 WHEN b.r IS NOT NULL THEN 1 WHEN c.r IS NOT NULL THEN 2 ELSE 3 END AS level FROM hits h JOIN p ON true LEFT JOIN a ON h.label = a.label AND h.bucket = a.bucket LEFT JOIN b ON h.label = b.label LEFT JOIN c ON h.bucket = c.bucket WHERE id % 2 = 1")
def ml_04_calibration(spark, d):
    h = _hits(spark, d)
    table, keys = ev.fit_calibrator(h.filter("id % 2 = 0"), LEVELS)
    return ev.calibrate(h.filter("id % 2 = 1"), table, keys).select("id", r6("rate", "rate"), "level")


@register("ml_15_back_off", f"WITH {HITS}, t AS (SELECT * FROM hits WHERE id % 2 = 0), a AS (SELECT page, bucket, label, count(*) AS n FROM t GROUP BY ALL), a1 AS (SELECT page, bucket, label AS v FROM a QUALIFY row_number() OVER (PARTITION BY page, bucket ORDER BY n DESC, label) = 1), b AS (SELECT bucket, label, count(*) AS n FROM t GROUP BY ALL), b1 AS (SELECT bucket, label AS v FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, label) = 1) SELECT h.id, coalesce(a1.v, b1.v, -1)::INT AS found, round(CASE WHEN a1.v IS NOT NULL THEN 0.95 WHEN b1.v IS NOT NULL THEN 0.85 ELSE 0.2 END::DOUBLE, 6) AS confidence FROM hits h LEFT JOIN a1 ON h.page = a1.page AND h.bucket = a1.bucket LEFT JOIN b1 ON h.bucket = b1.bucket WHERE h.id % 2 = 1")
def ml_15_back_off(spark, d):
    h = _hits(spark, d)
    out = ev.majority_lookup(h.filter("id % 2 = 0"), h.filter("id % 2 = 1"), [["page", "bucket"], ["bucket"]], "label", "-1")
    return out.select("id", F.col("found").cast("int").alias("found"), r6("confidence", "confidence"))


@register("ml_03_centroids", f"WITH {HITS}, s AS (SELECT stddev_pop(score) AS s1, stddev_pop(bucket) AS s2, avg(CASE WHEN hit THEN score END) AS a1, avg(CASE WHEN NOT hit THEN score END) AS a0, avg(CASE WHEN hit THEN bucket END) AS b1, avg(CASE WHEN NOT hit THEN bucket END) AS b0 FROM hits) SELECT id, round(1/(1+exp(sqrt(power((score-a1)/greatest(s1,1e-6),2)+power((bucket-b1)/greatest(s2,1e-6),2)) - sqrt(power((score-a0)/greatest(s1,1e-6),2)+power((bucket-b0)/greatest(s2,1e-6),2)))), 6) AS chance FROM hits, s")
def ml_03_centroids(spark, d):
    h = _hits(spark, d).select("id", F.col("score").alias("s"), F.col("bucket").cast("double").alias("b"), F.col("hit").cast("int").alias("y"))
    return ev.centroid_scores(h, h, ["s", "b"], "y").select("id", r6("score", "chance"))


@register("wn_07_gold_ranks", f"WITH {HITS} SELECT id, row_number() OVER (PARTITION BY page ORDER BY x1-x0 DESC, id) AS iou_rank, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS score_rank, hit AND sum(hit::INT) OVER (PARTITION BY page) = 1 AS sole FROM hits")
def wn_07_gold_ranks(spark, d):
    h = _hits(spark, d).select("id", F.col("page").alias("gold"), (F.col("x1") - F.col("x0")).alias("iou"), "score", "hit")
    return ev.gold_ranks(h).select("id", "iou_rank", "score_rank", "sole")


@register("wn_06_support_ranks", f"WITH {BOXES} SELECT id, row_number() OVER (PARTITION BY page, label ORDER BY score DESC, id) AS place, row_number() OVER (PARTITION BY page, label ORDER BY score, id DESC) AS tail, count(*) OVER (PARTITION BY page, label) AS size FROM boxes")
def wn_06_support_ranks(spark, d):
    b = boxes(spark, d).withColumn("own", F.struct("page", "label"))
    return ev.support_ranks(b, "own").select("id", "place", "tail", "size")


@register("wn_08_listwise", f"WITH {HITS} SELECT id, rank() OVER (PARTITION BY page ORDER BY score DESC) AS rank_page, count(*) OVER (PARTITION BY page) AS size_page, rank() OVER (PARTITION BY bucket ORDER BY score DESC) AS rank_bucket, count(*) OVER (PARTITION BY bucket) AS size_bucket FROM hits")
def wn_08_listwise(spark, d):
    return ev.listwise_features(_hits(spark, d), ["page", "bucket"]).select("id", "rank_page", "size_page", "rank_bucket", "size_bucket")


@register("wn_11_line_windows", f"WITH {BOXES}, p AS (SELECT page * 100 + (id % 100) // 10 AS line, id AS idx, (id % 10) * 14.0::DOUBLE AS x0, (label % 3) * 3.0::DOUBLE AS y0, (id % 10) * 14.0::DOUBLE + 10 AS x1, (label % 3) * 3.0::DOUBLE + 12 AS y1 FROM boxes), r AS (SELECT a.line, a.idx AS first, b.idx AS last FROM p a JOIN p b ON a.line = b.line AND b.idx BETWEEN a.idx + 1 AND a.idx + 6) SELECT r.line, first, last, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN p ON p.line = r.line AND p.idx BETWEEN first AND last GROUP BY ALL HAVING max(x1) - min(x0) <= 100 AND max(y1) - min(y0) <= 22")
def wn_11_line_windows(spark, d):
    x, y = (F.col("id") % 10) * 14.0, (F.col("label") % 3) * 3.0
    p = boxes(spark, d).select((F.col("page") * 100 + F.floor((F.col("id") % 100) / 10)).alias("line"), F.col("id").alias("idx"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 12).alias("y1"))
    return ev.line_windows(p)


@register("wn_17_history", "WITH h AS (SELECT user_id AS run, event_id AS step, value AS score FROM events) SELECT run, round(min_by(score, step), 6) AS first, round(max_by(score, step), 6) AS last, round(max(score), 6) AS best, (SELECT min(step) FROM h i WHERE i.run = h.run AND i.score = max(h.score)) AS best_step, 0::BIGINT AS broken FROM h GROUP BY run")
def wn_17_history(spark, d):
    h = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("score"), F.col("value").alias("loss"))
    return ev.history_summary(h, "run").select("run", r6("first", "first"), r6("last", "last"), r6("best", "best"), "best_step", "broken")


@register("wn_13_training_window", f"WITH {BOXES}, r AS (SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS place FROM boxes) SELECT page, id, place::INT AS place FROM r WHERE place >= 10 AND place < 30")
def wn_13_training_window(spark, d):
    return ev.training_window(boxes(spark, d), "page", "id", F.lit(10), 20).select("page", "id", F.col("place").cast("int").alias("place"))


@register("st_01_point_dedup", f"WITH {SEGMENTS}, p AS (SELECT id, round(x0/40)*40 AS x, round(y0/40)*40 AS y FROM segments) SELECT id, min(id) OVER (PARTITION BY round(x*1e9), round(y*1e9)) AS first FROM p")
def st_01_point_dedup(spark, d):
    p = segments(spark, d).select("id", (F.round(F.col("x0") / 40) * 40).alias("x"), (F.round(F.col("y0") / 40) * 40).alias("y"))
    return sets.point_map(p).select("id", "first")


@register("st_07_close_points", f"WITH {SEGMENTS} SELECT min(id) AS id, count(*) AS n FROM segments GROUP BY round(x0/25), round(y0/25)")
def st_07_close_points(spark, d):
    p = segments(spark, d).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return sets.merge_on_grid(p, 25.0).select("id", "n")


@register("st_08_union", f"WITH {BOXES} SELECT 'base' AS side, id, round(score + 1, 6) AS score FROM boxes WHERE label < 3 UNION ALL SELECT 'extra', id, round(score * 0.5, 6) FROM boxes WHERE label >= 2")
def st_08_union(spark, d):
    b = boxes(spark, d)
    return sets.union_ranked(b.filter("label < 3"), b.filter("label >= 2"), 0.5).select("side", "id", r6("score", "score"))


@register("st_09_graph_sets", "SELECT 'node' AS kind, l_partkey::VARCHAR AS key FROM lineitem UNION SELECT 'node', l_suppkey::VARCHAR FROM lineitem UNION SELECT 'edge', l_partkey || '>' || l_suppkey || ':' || l_returnflag FROM lineitem")
def st_09_graph_sets(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"))
    return sets.graph_sets(e)


SPLIT = "s AS (SELECT doc_id, source, text, CASE doc_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'locked' ELSE 'train' END AS split FROM documents)"


def _split(spark, d):
    return read(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").when(F.col("doc_id") % 5 == 1, "locked").otherwise("train"))


@register("st_12_leaks_by_source", f"WITH {SPLIT}, k AS (SELECT source, coalesce(text, '') AS t, list(DISTINCT split) AS s FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1), p AS (SELECT source, t, unnest(s) AS a, s FROM k), q AS (SELECT source, t, a, unnest(s) AS b FROM p) SELECT source, a, b, count(*) AS n FROM q WHERE a < b GROUP BY ALL")
def st_12_leaks_by_source(spark, d):
    return sets.leakage_by(_split(spark, d), "source", "text", "split")


@register("st_13_locked_rows", f"WITH {SPLIT} SELECT doc_id FROM s WHERE regexp_matches(split || ' ' || source, 'locked|smoke') ORDER BY doc_id LIMIT 50")
def st_13_locked_rows(spark, d):
    return sets.locked_rows(_split(spark, d), ["split", "source"], "doc_id").select("doc_id")


@register("st_15_shuffled_split")
def st_15_shuffled_split(spark, d):
    return sets.shuffled_split(read(spark, d, "documents").select("doc_id"), "doc_id", {"dev": 0.1, "locked": 0.2, "train": 0.7}, 7)


@register("st_17_manifest_hash", "WITH f AS (SELECT lang AS folder, source AS path, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) SELECT folder, sha256(string_agg(path || chr(0) || h, '' ORDER BY path)) AS hash FROM f WHERE path IS NOT NULL GROUP BY folder")
def st_17_manifest_hash(spark, d):
    f = read(spark, d, "documents").filter("source is not null").groupBy(F.col("lang").alias("folder"), F.col("source").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("content"))
    return sets.manifest_hash(f.select("folder", "path", F.sha2("content", 256).alias("sha")))


@register("tk_10_unique_cap", f"WITH {BOXES}, u AS (SELECT page, label, min(id) AS id FROM boxes GROUP BY ALL) SELECT page, id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM u) WHERE k <= 4")
def tk_10_unique_cap(spark, d):
    return sets.unique_with_cap(boxes(spark, d), "page", "label", "id", 4).select("page", "id")


@register("tk_14_area_sample")
def tk_14_area_sample(spark, d):
    return sets.stratified_sample(_hits(spark, d).withColumn("stratum", F.when(~F.col("hit"), "negative").when(F.col("bucket") <= 5, "small").otherwise("large")), "stratum", {"negative": 20, "small": 15, "large": 15}, "id", 3).select("stratum", "id")


@register("tk_16_weighted_sample")
def tk_16_weighted_sample(spark, d):
    return sets.weighted_sample(_hits(spark, d), F.col("score"), F.col("label") == 3, "id", 50, 11)


@register("tk_12_by_priority", f"WITH {BOXES} SELECT id, label FROM boxes ORDER BY label DESC, id LIMIT 20")
def tk_12_by_priority(spark, d):
    return sets.by_priority(boxes(spark, d), "label", "id", 20).select("id", "label")
