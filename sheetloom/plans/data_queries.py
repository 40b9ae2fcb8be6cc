"""Metric, text, set, window and event queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics, rules, selection, sets
from ..streaming import service
from .tables import BOXES, JUDGED, boxes, judged, read

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


r6 = lambda c, n: F.round(c, 6).alias(n)
PRF = "round(coalesce(tp/nullif(tp+fp,0),0), 6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0), 6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0), 6) AS f1"


def _rounded(df, *keys):
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn")), *(r6(c, c) for c in ("precision", "recall", "f1")))


@register("ag_23_confusion", f"WITH {JUDGED} SELECT gold, pred, count(*) AS n FROM judged GROUP BY ALL")
def ag_23_confusion(spark, d):
    return metrics.confusion(judged(spark, d))


@register("ag_24_per_label", f"WITH {JUDGED}, l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count_if(gold=label AND pred=label)::DOUBLE AS tp, count_if(gold<>label AND pred=label)::DOUBLE AS fp, count_if(gold=label AND pred<>label)::DOUBLE AS fn FROM judged, l GROUP BY label) SELECT label, tp, fp, fn, {PRF} FROM c WHERE tp+fp+fn > 0")
def ag_24_per_label(spark, d):
    return _rounded(metrics.per_label(judged(spark, d)), "label")


@register("ag_30_by_source", f"WITH {JUDGED}, c AS (SELECT source, count_if(gold=1 AND pred=1)::DOUBLE AS tp, count_if(gold=0 AND pred=1)::DOUBLE AS fp, count_if(gold=1 AND pred=0)::DOUBLE AS fn FROM judged GROUP BY source) SELECT source, tp, fp, fn, {PRF} FROM c")
def ag_30_by_source(spark, d):
    c = judged(spark, d).groupBy("source").agg(F.count_if(F.expr("gold=1 and pred=1")).alias("tp"), F.count_if(F.expr("gold=0 and pred=1")).alias("fp"), F.count_if(F.expr("gold=1 and pred=0")).alias("fn"))
    return _rounded(metrics.precision_recall(c, "source"), "source")


@register("ag_26_relation_sets", f"WITH g AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3), c AS (SELECT count_if(gs AND fs)::DOUBLE AS tp, count_if(gs IS NULL)::DOUBLE AS fp, count_if(fs IS NULL)::DOUBLE AS fn FROM (SELECT *, true AS gs FROM g) g FULL JOIN (SELECT *, true AS fs FROM f) f USING (l_partkey, l_suppkey)) SELECT tp, fp, fn, {PRF} FROM c")
def ag_26_relation_sets(spark, d):
    l = read(spark, d, "lineitem")
    return _rounded(metrics.relation_metrics(l.filter("l_linenumber <= 3"), l.filter("l_linenumber >= 3"), ["l_partkey", "l_suppkey"]))


@register("ag_33_wilson", f"WITH {JUDGED}, c AS (SELECT source, avg(pred)::DOUBLE AS p, count(*)::DOUBLE AS n FROM judged GROUP BY source), i AS (SELECT *, p + 1.96*1.96/(2*n) AS m, 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) AS h, 1 + 1.96*1.96/n AS q FROM c) SELECT source, n, round(greatest(0, least(1, (m-h)/q)), 6) AS low, round(greatest(0, least(1, (m+h)/q)), 6) AS high FROM i")
def ag_33_wilson(spark, d):
    c = judged(spark, d).groupBy("source").agg(F.avg("pred").alias("p"), F.count("*").cast("double").alias("n"))
    low, high = metrics.wilson(F.col("p"), F.col("n"))
    return c.select("source", "n", r6(low, "low"), r6(high, "high"))


@register("ag_34_auc", f"WITH {JUDGED} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM judged a JOIN judged b ON a.gold = 1 AND b.gold = 0")
def ag_34_auc(spark, d):
    return metrics.auc(judged(spark, d)).select(r6("auc", "auc"))


@register("ag_35_average_precision", f"WITH {BOXES}, s AS (SELECT (label = 3)::INT AS gold, score FROM boxes), c AS (SELECT sum(gold) OVER w AS tp, count(*) OVER w AS n, (SELECT sum(gold) FROM s) AS p FROM s WINDOW w AS (ORDER BY score DESC)), q AS (SELECT tp/n AS pr, tp/p AS rc FROM c) SELECT round(avg(coalesce(b, 0)), 6) AS ap FROM (SELECT (SELECT max(pr) FROM q WHERE rc >= k/10 - 1e-12) AS b FROM (SELECT unnest(range(11)) AS k))")
def ag_35_average_precision(spark, d):
    return metrics.average_precision_11(boxes(spark, d).select((F.col("label") == 3).cast("int").alias("gold"), "score")).select(r6("ap", "ap"))


SWEEP = [0.1, 0.3, 0.5, 0.7, 0.9]


@register("ag_45_threshold_sweep", f"WITH {JUDGED}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count_if(score >= threshold AND gold = 1)::DOUBLE AS tp, count_if(score >= threshold AND gold = 0)::DOUBLE AS fp, count_if(score < threshold AND gold = 1)::DOUBLE AS fn FROM judged, t GROUP BY threshold) SELECT threshold, tp, fp, fn, {PRF} FROM c")
def ag_45_threshold_sweep(spark, d):
    return _rounded(metrics.threshold_sweep(judged(spark, d), SWEEP), "threshold")


@register("ag_37_percentiles", f"WITH {BOXES}, o AS (SELECT label, list(score ORDER BY score) AS s, count(*) AS n FROM boxes GROUP BY label), p AS (SELECT label, quantile_cont(score, 0.9) AS linear, avg(score) AS mean, min(score) AS lo, max(score) AS hi FROM boxes GROUP BY label) SELECT label, n, round(s[(round_even((n-1)*0.5, 0) + 1)::BIGINT], 6) AS p50, round(linear, 6) AS p90, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM o JOIN p USING (label)")
def ag_37_percentiles(spark, d):
    b = boxes(spark, d)
    s = b.groupBy("label").agg(F.count("*").alias("n"), r6(F.percentile("score", 0.9), "p90"), r6(F.avg("score"), "mean"), r6(F.min("score"), "lo"), r6(F.max("score"), "hi"))
    return s.join(metrics.nearest_rank(b, ["label"], "score", 0.5), "label").select("label", "n", r6("p", "p50"), "p90", "mean", "lo", "hi")


@register("ag_42_coverage", "SELECT source, lang, count(*) AS n, sum(n_chars)::DOUBLE AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def ag_42_coverage(spark, d):
    return read(spark, d, "documents").groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("double").alias("chars"))


@register("ag_40_status_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity)::DOUBLE, 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ag_40_status_rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity").cast("double"), 2).alias("qty"))


@register("ag_57_error_pairs", f"WITH {JUDGED} SELECT gold, pred, count(*) AS n FROM judged WHERE gold <> pred GROUP BY ALL")
def ag_57_error_pairs(spark, d):
    return metrics.confusion(judged(spark, d)).filter("gold <> pred")


@register("ag_61_compare", "WITH m AS (SELECT event_type, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS base, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS now FROM events GROUP BY event_type) SELECT event_type, round(base, 6) AS base, round(now, 6) AS now, round(100*(now-base)/nullif(base,0), 4) AS change, (now-base)/nullif(base,0) > 0.02 AS slower FROM m")
def ag_61_compare(spark, d):
    odd = F.col("event_id") % 2
    m = read(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(odd == 0, F.col("value"))).alias("base"), F.avg(F.when(odd == 1, F.col("value"))).alias("now"))
    change = F.try_divide(F.col("now") - F.col("base"), F.col("base"))
    return m.select("event_type", r6("base", "base"), r6("now", "now"), F.round(100 * change, 4).alias("change"), (change > 0.02).alias("slower"))


@register("jn_39_full_outer", "SELECT coalesce(d.doc_id, l.doc_id) AS id, d.doc_id IS NULL AS extra, l.doc_id IS NULL AS missing FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def jn_39_full_outer(spark, d):
    a, b = read(spark, d, "documents").select(F.col("doc_id").alias("a")), read(spark, d, "labels").select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("id"), F.col("a").isNull().alias("extra"), F.col("b").isNull().alias("missing"))


@register("jn_41_missing_extra", "SELECT 'missing' AS side, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'extra', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def jn_41_missing_extra(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(docs.join(labels, "doc_id", "left_anti"), "missing").union(n(labels.join(docs, "doc_id", "left_anti"), "extra"))


@register("jn_21_material_lookup", "WITH m(brand, alpha) AS (VALUES ('Brand#11', 0.1), ('Brand#22', 0.3)) SELECT p_partkey, round(coalesce(alpha, 0.05)::DOUBLE, 6) AS alpha FROM part LEFT JOIN m ON p_brand = brand")
def jn_21_material_lookup(spark, d):
    m = spark.createDataFrame([("Brand#11", 0.1), ("Brand#22", 0.3)], "p_brand string, a double")
    return read(spark, d, "part").join(m, "p_brand", "left").select("p_partkey", F.round(F.coalesce("a", F.lit(0.05)), 6).alias("alpha"))


WORDS = "CASE WHEN contains(lower(text), 'password') THEN 'door' WHEN contains(lower(text), 'license') THEN 'window' WHEN contains(lower(text), 'token') THEN 'opening' ELSE 'hard_wall' END"


@register("prj_02_unit_conversion", "SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE * CASE l_returnflag WHEN 'A' THEN 10.0 WHEN 'R' THEN 25.4 WHEN 'N' THEN 304.8 ELSE 1.0 END, 4) AS mm FROM lineitem")
def prj_02_unit_conversion(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "cm").when(F.col("l_returnflag") == "R", "Inch").when(F.col("l_returnflag") == "N", "foot").otherwise("none")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(rules.to_mm(F.col("l_quantity").cast("double"), unit), 4).alias("mm"))


@register("prj_29_octave_band", "SELECT p_partkey, (SELECT b FROM (SELECT unnest([125, 250, 500, 1000, 2000, 4000]) AS b) ORDER BY abs(p_size * 37 - b), b LIMIT 1) AS band FROM part")
def prj_29_octave_band(spark, d):
    return read(spark, d, "part").select("p_partkey", rules.octave_band(F.col("p_size") * 37).alias("band"))


@register("flt_09_distinct_layers", "SELECT DISTINCT upper(p_brand) AS layer FROM part WHERE contains(upper(p_name), 'E')")
def flt_09_distinct_layers(spark, d):
    return read(spark, d, "part").filter(F.contains(F.upper("p_name"), F.lit("E"))).select(F.upper("p_brand").alias("layer")).distinct()


@register("sf_03_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS d, round(levenshtein(p_name, p_type) / length(p_name), 6) AS rate FROM part WHERE length(p_name) > 0")
def sf_03_edit_distance(spark, d):
    return read(spark, d, "part").filter(F.length("p_name") > 0).select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"), r6(tx.error_rate(F.col("p_name"), F.col("p_type")), "rate"))


@register("sf_02_normalise", "SELECT p_partkey, trim(regexp_replace(lower(p_type || '/' || p_brand), '[^a-z0-9.]+', ' ', 'g')) AS norm, replace(replace(p_type || '<&', '&', '&amp;'), '<', '&lt;') AS escaped FROM part")
def sf_02_normalise(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.normalise_label(F.concat_ws("/", "p_type", "p_brand")).alias("norm"), tx.xml_escape(F.concat("p_type", F.lit("<&"))).alias("escaped"))


@register("sf_15_json", "SELECT event_id, (props->>'$.k')::INT AS k, coalesce(try_cast(props->>'$.missing' AS DOUBLE), 1.5) AS other FROM events")
def sf_15_json(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), tx.safe_double(F.get_json_object("props", "$.missing"), 1.5).alias("other"))


@register("src_21_markup_scan", "SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_chars FROM pages")
def src_21_markup_scan(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_chars"))


@register("st_03_record_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def st_03_record_dedup(spark, d):
    return sets.first_of_equal(read(spark, d, "documents"), "text", "doc_id")


@register("st_10_leakage", "WITH s AS (SELECT DISTINCT text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'locked' END AS split FROM documents) SELECT a.split AS a, b.split AS b, count(*) AS n FROM s a JOIN s b ON a.text = b.text AND a.split < b.split GROUP BY ALL")
def st_10_leakage(spark, d):
    m = F.col("doc_id") % 10
    return sets.leakage(read(spark, d, "documents").select("text", F.when(m < 7, "train").when(m < 9, "dev").otherwise("locked").alias("split")), "text", "split")


@register("st_14_hash_split", "SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8 AS train FROM documents")
def st_14_hash_split(spark, d):
    return read(spark, d, "documents").select("doc_id", sets.hash_split(F.col("doc_id").cast("string"), 0.8).alias("train"))


@register("st_16_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def st_16_content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@register("tk_15_balanced_sample")
def tk_15_balanced_sample(spark, d):
    return sets.balanced_sample(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, seed=3)


@register("tk_17_worst", f"WITH {JUDGED}, e AS (SELECT source, count_if(gold <> pred) AS errors, count(*) AS n FROM judged GROUP BY source) SELECT source, errors, round(errors / n, 6) AS rate FROM e ORDER BY errors DESC, errors / n DESC, source LIMIT 5")
def tk_17_worst(spark, d):
    e = judged(spark, d).groupBy("source").agg(F.count_if(F.expr("gold <> pred")).alias("errors"), F.count("*").alias("n"))
    rate = F.col("errors") / F.col("n")
    return e.orderBy(F.desc("errors"), rate.desc(), "source").limit(5).select("source", "errors", r6(rate, "rate"))


@register("wn_01_consecutive_turns", "SELECT conv_id, turn, lead(turn) OVER w AS next_turn, length(text) - lag(length(text)) OVER w AS growth, rank() OVER (PARTITION BY conv_id ORDER BY length(text) DESC) AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def wn_01_consecutive_turns(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return read(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), (n - F.lag(n).over(w)).alias("growth"), F.rank().over(W.partitionBy("conv_id").orderBy(n.desc())).alias("place"))


@register("wn_10_runs", "WITH u AS (SELECT DISTINCT user_id, event_id FROM events), g AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM u) SELECT user_id, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM g GROUP BY user_id, g")
def wn_10_runs(spark, d):
    return sets.runs(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@register("wn_14_histogram_peaks", "WITH h AS (SELECT (floor(value)::BIGINT % 180 + 180) % 180 AS bin, count(*) AS n FROM events GROUP BY 1), a AS (SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(180)) AS b) LEFT JOIN h ON b = bin) SELECT bin, n FROM a WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM a o, (SELECT unnest([-2,-1,1,2]) AS k) WHERE o.bin = (a.bin + k + 180) % 180 AND o.n > a.n)")
def wn_14_histogram_peaks(spark, d):
    v = F.floor("value")
    return sets.circular_peaks(read(spark, d, "events").select(F.pmod(v, F.lit(180)).alias("bin")), 180, 2)


@register("wn_05_rank_over_threshold", f"WITH {BOXES} SELECT id, row_number() OVER (PARTITION BY page, label ORDER BY score DESC, id) AS place, row_number() OVER (PARTITION BY page, label ORDER BY score, id DESC) AS tail, count(*) OVER (PARTITION BY page, label) AS n FROM boxes WHERE score > 0.05")
def wn_05_rank_over_threshold(spark, d):
    w = lambda *o: W.partitionBy("page", "label").orderBy(*o)
    return boxes(spark, d).filter("score > 0.05").select("id", F.row_number().over(w(F.desc("score"), "id")).alias("place"), F.row_number().over(w("score", F.desc("id"))).alias("tail"), F.count("*").over(W.partitionBy("page", "label")).alias("n"))


@register("stm_08_request_metrics", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2")
def stm_08_request_metrics(spark, d):
    return service.request_metrics(read(spark, d, "events"), "ts", "value", "event_type")


@register("stm_07_breaker")
def stm_07_breaker(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return service.breaker_states(e, "user_id", ["ts", "event_id"], 2, 3600.0)


@register("stm_05_dirty_boxes", f"WITH RECURSIVE {BOXES}, b AS (SELECT * FROM boxes), e AS (SELECT a.id AS u, c.id AS v FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1), r AS (SELECT id AS n, id AS c FROM b UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.n), g AS (SELECT n, min(c) AS c FROM r GROUP BY n) SELECT page, c AS component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM g JOIN b ON b.id = n GROUP BY page, c")
def stm_05_dirty_boxes(spark, d):
    return service.merged_dirty_boxes(boxes(spark, d))


@register("ml_04_backoff_table", f"WITH {JUDGED}, a AS (SELECT source, count(*) AS n, avg(gold)::DOUBLE AS p FROM judged GROUP BY source), b AS (SELECT avg(gold)::DOUBLE AS q FROM judged) SELECT source, n, round((p * n + 10 * q) / (n + 10), 6) AS precision FROM a, b")
def ml_04_backoff_table(spark, d):
    j = judged(spark, d)
    a = j.groupBy("source").agg(F.count("*").alias("n"), F.avg("gold").alias("p"))
    q = j.agg(F.avg("gold")).first()[0]
    return a.select("source", "n", r6((F.col("p") * F.col("n") + 10 * q) / (F.col("n") + 10), "precision"))
