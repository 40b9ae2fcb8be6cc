"""Evaluation: scores of masks, relations and topology, resampling, calibration tables, thresholds, rank features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import precision_recall

#: Blocks that rows are dealt to, by a hash of their key, before they are resampled.
BLOCKS = 512
#: Cumulative chances of a Poisson(1) draw of 0, 1, 2 ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def topology_score(pairs: list[tuple[Column, Column]]) -> Column:
    """0 to 100 from (expected, found) numbers of vertices, edges and faces, weighted 0.3, 0.4 and 0.3."""
    ratio = lambda want, got: F.greatest(F.lit(0.0), F.when(want > 0, 1 - F.abs(got - want) / want).otherwise(1.0))
    return 100 * sum((w * ratio(*p) for w, p in zip((0.3, 0.4, 0.3), pairs, strict=True)), F.lit(0.0))


def mask_objectness(probabilities: Column, least: float = 0.01) -> Column:
    """Mean of the probabilities above least, 0 if none is."""
    some = F.filter(probabilities, lambda p: p > least)
    return F.aggregate(some, F.lit(0.0), lambda a, p: a + p) / F.greatest(F.size(some), F.lit(1))


def weighted_mask_iou(found: Column, gold: Column, weights: Column) -> Column:
    """Weight of the elements in both masks over that in either; 0 where both are empty."""
    total = lambda f: F.aggregate(F.zip_with(F.zip_with(found, gold, f), weights, lambda m, w: F.when(m, w).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return total(lambda a, b: a & b) / F.greatest(total(lambda a, b: a | b), F.lit(1e-12))


def relation_metrics_by_type(gold: DataFrame, found: DataFrame, keys: list[str], kind: str, order: str) -> DataFrame:
    """(kind, tp, fp, fn, duplicates, precision, recall, f1): of found rows with a gold row's keys and kind the first in
    order is its hit, later ones are duplicates; found rows without a gold row are false."""
    on = [kind, *keys]
    g = gold.select(*on).distinct().withColumn("is_gold", F.lit(True))
    f = found.select(*on, order).withColumn("place", F.row_number().over(W.partitionBy(*on).orderBy(order)))
    both = g.join(f, on, "full")
    c = both.groupBy(kind).agg(
        F.count_if(F.col("is_gold") & (F.col("place") == 1)).cast("double").alias("tp"), F.count_if(F.col("is_gold").isNull()).cast("double").alias("fp"),
        F.count_if(F.col("place").isNull()).cast("double").alias("fn"), F.count_if(F.col("is_gold") & (F.col("place") > 1)).cast("double").alias("duplicates"),
    )
    return precision_recall(c, kind, "duplicates")


def pooled(rows: DataFrame) -> DataFrame:
    """One row: counts summed over all rows (tp, fp, fn), then precision, recall and f1."""
    return precision_recall(rows.agg(*(F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn"))))


def group_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, precision) of judged rows, which have hit."""
    return rows.groupBy(*keys).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"), F.avg(F.col("hit").cast("double")).alias("precision"))


def resampled(rows: DataFrame, values: list[str], key: str, rounds: int, seed: int) -> DataFrame:
    """(round, value ...): means of values under Poisson weights of BLOCKS blocks of rows.

    One pass sums the rows of each block, which a hash of the key picks; only block sums are resampled."""
    blocks = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(BLOCKS)).alias("block")).agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))
    many = blocks.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = (F.pmod(F.xxhash64("round", "block", F.lit(seed)), F.lit(1 << 32)) + 0.5) / (1 << 32)
    w = sum(((u > s).cast("int") for s in POISSON), F.lit(0))
    drawn = many.withColumn("w", w)
    return drawn.groupBy("round").agg(*(F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.col("w") * F.col("n"))).alias(v) for v in values))


def bootstrap_interval(rows: DataFrame, value: str, key: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(mean, low, middle, high, deviation): 2.5, 50 and 97.5 % points of resampled means, and their deviation."""
    mean = rows.agg(F.avg(value).alias("mean"))
    spread = resampled(rows, [value], key, rounds, seed).agg(F.percentile(value, F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("p"), F.stddev_samp(value).alias("deviation"))
    return mean.crossJoin(spread).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("middle"), F.col("p")[2].alias("high"), "deviation")


def paired_bootstrap(rows: DataFrame, base: str, candidate: str, key: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(delta, low, high, chance): mean gain of candidate over base, its 95 % interval and the share of resamples with a gain."""
    gain = rows.select(key, (F.col(candidate) - F.col(base)).alias("gain"))
    drawn = resampled(gain, ["gain"], key, rounds, seed).agg(F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.avg((F.col("gain") > 0).cast("double")).alias("chance"))
    return gain.agg(F.avg("gain").alias("delta")).crossJoin(drawn).select("delta", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "chance")


def cap_sweep(rows: DataFrame, group: str, orders: dict[str, list], caps: list[int]) -> DataFrame:
    """(ranking, cap, hits, recall): gold rows (hit) among the first cap rows of each group, for several rankings."""
    total = rows.agg(F.count_if("hit").alias("all"))
    out = None
    for name, order in orders.items():
        ranked = rows.select("hit", F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("place"))
        counts = ranked.agg(*(F.count_if(F.col("hit") & (F.col("place") <= k)).alias(f"c{k}") for k in caps))
        part = counts.select(F.lit(name).alias("ranking"), F.inline(F.array(*(F.struct(F.lit(k).alias("cap"), F.col(f"c{k}").alias("hits")) for k in caps))))
        out = part if out is None else out.union(part)
    return out.crossJoin(F.broadcast(total)).select("ranking", "cap", "hits", F.try_divide(F.col("hits"), F.col("all")).alias("recall"))


def probability_r2(rows: DataFrame, classes: int) -> DataFrame:
    """One row r2: 1 less squared errors over squared spread of the one-hot labels (y, probs)."""
    flat = rows.select("y", F.posexplode("probs").alias("k", "p")).select("k", "p", (F.col("y") == F.col("k")).cast("double").alias("t"))
    s = flat.groupBy("k").agg(F.sum((F.col("t") - F.col("p")) ** 2).alias("e"), F.var_pop("t").alias("v"), F.count("*").alias("n")).filter(F.col("k") < classes)
    return s.agg((1 - F.try_divide(F.sum("e"), F.sum(F.col("v") * F.col("n")))).alias("r2"))


def vectorise_quality(lines: DataFrame, gaps: DataFrame, drawing: str) -> DataFrame:
    """(drawing, completeness, continuity, accuracy, total) of lines (length, on_ink) and gaps (d) of each drawing.

    Shares of ink-covered length, of length that no gap breaks, and of lines over a unit long."""
    a = lines.groupBy(drawing).agg(F.sum("length").alias("all"), F.sum(F.when(F.col("on_ink"), F.col("length"))).alias("ink"), F.avg((F.col("length") > 1).cast("double")).alias("accuracy"))
    b = gaps.groupBy(drawing).agg(F.sum("d").alias("gap"))
    j = a.join(b, drawing, "left")
    complete, whole = F.coalesce(F.try_divide("ink", "all"), F.lit(0.0)), F.coalesce(F.try_divide(F.col("all"), F.col("all") + F.coalesce("gap", F.lit(0.0))), F.lit(0.0))
    return j.select(drawing, complete.alias("completeness"), whole.alias("continuity"), "accuracy", ((complete + whole + F.col("accuracy")) / 3).alias("total"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and greatest degree."""
    d = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    all_ = nodes.join(d, "id", "left").agg(F.count("*").alias("nodes"), F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree"), F.max(F.coalesce("degree", F.lit(0))).alias("max_degree"))
    return all_.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def benchmark_summary(rows: DataFrame, limit: float = 0.1) -> DataFrame:
    """(name, n, mean, median, spread, slow): runs of each name; slow where the mean is over the median by more than limit."""
    s = rows.groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), (F.max("value") - F.min("value")).alias("spread"))
    return s.withColumn("slow", F.col("mean") > F.col("median") * (1 + limit))


def select_threshold(sweep: DataFrame, near: float = 0.7) -> DataFrame:
    """The sweep's row with the best f1, on ties the threshold nearest to near, then the smaller."""
    return sweep.orderBy(F.desc("f1"), F.abs(F.col("threshold") - near), "threshold").limit(1)


def choose_policy(rows: DataFrame, policies: DataFrame, least_precision: float) -> DataFrame:
    """The policy (name, cut) whose kept rows (score, hit) have the most hits at least_precision or more, on ties the higher cut.

    Policies are a bounded literal table; all are counted in one pass over the rows."""
    table = [(r["name"], float(r["cut"])) for r in policies.orderBy("name").collect()]
    counts = rows.agg(*(F.count_if(F.col("hit") & (F.col("score") >= c)).alias(f"t{i}") for i, (_, c) in enumerate(table)), *(F.count_if(F.col("score") >= c).alias(f"n{i}") for i, (_, c) in enumerate(table)))
    flat = counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("cut"), F.col(f"t{i}").alias("hits"), F.try_divide(F.col(f"t{i}"), F.col(f"n{i}")).alias("precision")) for i, (n, c) in enumerate(table)))))
    return flat.filter(F.col("precision") >= least_precision).orderBy(F.desc("hits"), F.desc("cut")).limit(1)


def fit_calibrator(rows: DataFrame, keys: list[list[str]], smooth: float = 2.0) -> tuple[DataFrame, list[list[str]]]:
    """Precision of judged rows (hit) at each level of keys, the finest first, smoothed toward the overall rate.

    The table has one row for each combination at each level: level, the keys (null where not used), rate."""
    every = sorted({k for level in keys for k in level})
    prior = rows.agg(F.avg(F.col("hit").cast("double"))).first()[0] or 0.0
    out = None
    for i, level in enumerate([*keys, []]):
        s = rows.groupBy(*level).agg(F.sum(F.col("hit").cast("double")).alias("s"), F.count("*").alias("n"))
        part = s.select(F.lit(i).alias("level"), *((F.col(k) if k in level else F.lit(None)).cast("string").alias(k) for k in every), ((F.col("s") + smooth * prior) / (F.col("n") + smooth)).alias("rate"), "n")
        out = part if out is None else out.union(part)
    return out, keys


def calibrate(rows: DataFrame, table: DataFrame, keys: list[list[str]], least: int = 3) -> DataFrame:
    """rows with rate and level of the finest level that has at least least rows; the overall rate if none has."""
    out = rows
    for i, level in enumerate([*keys, []]):
        own = table.filter((F.col("level") == i) & ((F.col("n") >= least) | F.lit(not level))).select(*(F.col(k).alias(f"k_{k}") for k in level), F.col("rate").alias(f"rate_{i}"))
        on = [F.col(k).cast("string") == F.col(f"k_{k}") for k in level]
        out = (out.join(own, on, "left") if level else out.crossJoin(F.broadcast(own))).drop(*(f"k_{k}" for k in level))
    n = len(keys) + 1
    rate = F.coalesce(*(F.col(f"rate_{i}") for i in range(n)))
    level = F.coalesce(*(F.when(F.col(f"rate_{i}").isNotNull(), i) for i in range(n)))
    return out.withColumns({"rate": rate, "level": level}).drop(*(f"rate_{i}" for i in range(n)))


def majority_lookup(train: DataFrame, rows: DataFrame, keys: list[list[str]], label: str, prior: str) -> DataFrame:
    """rows with found and confidence: the commonest label (on ties the least) of the finest keys that train has,
    0.95 less 0.1 a level; prior at 0.2 where no level has any."""
    out = rows
    for i, level in enumerate(keys):
        counts = train.groupBy(*level, label).agg(F.count("*").alias("n"))
        best = counts.groupBy(*level).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("v"))).alias("m")).select(*(F.col(k).alias(f"k_{k}") for k in level), F.col("m.v").alias(f"v_{i}"))
        out = out.join(best, [F.col(k) == F.col(f"k_{k}") for k in level], "left").drop(*(f"k_{k}" for k in level))
    hit = F.coalesce(*(F.when(F.col(f"v_{i}").isNotNull(), F.lit(0.95 - 0.1 * i)) for i in range(len(keys))), F.lit(0.2))
    return out.withColumns({"found": F.coalesce(*(F.col(f"v_{i}") for i in range(len(keys))), F.lit(prior)), "confidence": hit}).drop(*(f"v_{i}" for i in range(len(keys))))


def centroid_scores(train: DataFrame, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with score: sigmoid of the distance to the mean of label 0 less that to label 1, in deviations of all training rows."""
    stats = train.agg(*(F.stddev_pop(f).alias(f"s_{f}") for f in features), *(F.avg(F.when(F.col(label) == k, F.col(f))).alias(f"m{k}_{f}") for f in features for k in (0, 1)))
    z = lambda f, k: F.try_divide(F.col(f) - F.col(f"m{k}_{f}"), F.greatest(F.col(f"s_{f}"), F.lit(1e-6)))
    far = lambda k: F.sqrt(sum((z(f, k) * z(f, k) for f in features), F.lit(0.0)))
    out = rows.crossJoin(F.broadcast(stats)).withColumn("score", 1 / (1 + F.exp(far(1) - far(0))))
    return out.select(*rows.columns, "score")


def gold_ranks(rows: DataFrame) -> DataFrame:
    """Candidates (id, gold, iou, score, hit) with their places by iou and by score among those of one gold row, and whether
    they are its only hit."""
    by = lambda c: F.row_number().over(W.partitionBy("gold").orderBy(F.desc(c), "id"))
    only = F.col("hit") & (F.sum(F.col("hit").cast("int")).over(W.partitionBy("gold")) == 1)
    return rows.withColumns({"iou_rank": by("iou"), "score_rank": by("score"), "sole": only})


def support_ranks(rows: DataFrame, group: str) -> DataFrame:
    """rows (id, score) with place from the top, from the end, and the size of their group."""
    w = W.partitionBy(group)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(F.desc("score"), "id")), "tail": F.row_number().over(w.orderBy("score", F.desc("id"))), "size": F.count("*").over(w)})


def listwise_features(rows: DataFrame, groups: list[str]) -> DataFrame:
    """rows (score) with the rank of the score in each of several groupings, and the grouping's size."""
    for c in groups:
        rows = rows.withColumns({f"rank_{c}": F.rank().over(W.partitionBy(c).orderBy(F.desc("score"))), f"size_{c}": F.count("*").over(W.partitionBy(c))})
    return rows


def line_windows(pieces: DataFrame, least: int = 2, most: int = 7, width: float = 100.0, height: float = 22.0) -> DataFrame:
    """(line, first, last, x0, y0, x1, y1): runs of least to most consecutive pieces (line, idx, box) whose envelope is small."""
    w = W.partitionBy("line").orderBy("idx")
    ahead = pieces.withColumn("next", F.collect_list(F.struct("idx", "x0", "y0", "x1", "y1")).over(w.rowsBetween(0, most - 1)))
    sub = ahead.select("line", F.col("idx").alias("first"), F.posexplode(F.transform("next", lambda p, i: F.slice("next", F.lit(1), i + 1))).alias("k", "run")).filter(F.col("k") >= least - 1)
    edge = lambda f, c: f(F.transform("run", lambda p: p[c])).alias(c)
    out = sub.select("line", "first", F.element_at("run", -1)["idx"].alias("last"), edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    return out.filter((F.col("x1") - F.col("x0") <= width) & (F.col("y1") - F.col("y0") <= height))


def history_summary(rows: DataFrame, run: str) -> DataFrame:
    """(run, first, last, best, best_step, broken): scores of steps of each run, and losses that are no finite numbers."""
    bad = F.isnan("loss") | (F.abs("loss") == float("inf")) | F.col("loss").isNull()
    best = F.max(F.struct("score", (-F.col("step")).alias("s")))
    return rows.groupBy(run).agg(F.min_by("score", "step").alias("first"), F.max_by("score", "step").alias("last"), best.alias("b"), F.count_if(bad).alias("broken")).select(run, "first", "last", F.col("b.score").alias("best"), (-F.col("b.s")).alias("best_step"), "broken")


def training_window(rows: DataFrame, group: str, order: str, start: Column, most: int) -> DataFrame:
    """rows of each group from place start on, most at most, in order."""
    place = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("place", place).filter((F.col("place") >= start) & (F.col("place") < start + most))
