"""Aggregates: confusion counts, ranking metrics, percentiles, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """(gold, pred, n)."""
    return rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def precision_recall(counts: DataFrame, *keys: str) -> DataFrame:
    """precision, recall and f1 of columns tp, fp, fn, each 0 where it is undefined."""
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(c)), F.lit(0.0)) for c in ("fp", "fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def per_label(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) from gold and pred, one row per label of either."""
    c = confusion(rows)
    sides = c.select(F.col("gold").alias("label"), F.when(F.expr("gold = pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.expr("gold <> pred"), F.col("n")).otherwise(0).alias("fn"))
    sides = sides.union(c.filter("gold <> pred").select("pred", F.lit(0), "n", F.lit(0)))
    return precision_recall(sides.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn"))), "label")


def relation_metrics(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 of two sets of key tuples; two empty sets give 1."""
    a, b = gold.select(*keys).distinct().withColumn("g", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    c = a.join(b, keys, "full").agg(F.count_if(F.expr("g = 1 and f = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("f is null")).alias("fn"))
    out = precision_recall(c)
    empty = F.expr("tp + fp + fn = 0")
    return out.withColumns({m: F.when(empty, 1.0).otherwise(F.col(m)) for m in ("precision", "recall", "f1")})


def auc(rows: DataFrame) -> DataFrame:
    """One row auc: the chance that a positive (gold 1) outscores a negative, ties counting half.

    Scores are counted first; ranks are running sums over distinct scores, taken within score ranges."""
    by = rows.groupBy("score").agg(F.count_if(F.col("gold") == 1).alias("p"), F.count_if(F.col("gold") == 0).alias("n"))
    below = running_total(by, "score", "n")
    wins = below.agg(F.sum(F.col("p") * (F.col("before") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def running_total(rows: DataFrame, order: str, value: str, ranges: int = 64) -> DataFrame:
    """rows with before, the sum of value over all rows of lower order, whose values are distinct.

    Rows are cut into ranges of order at quantiles; sums of whole ranges are carried over as a small
    table, so that no single task sees every row."""
    cuts = rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.001) if ranges > 1 else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col(order) > c).cast("int")
    cut = rows.withColumn("__part", part)
    sums = cut.groupBy("__part").agg(F.sum(value).alias("__s"))
    carry = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    own = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__own", own).join(F.broadcast(carry), "__part").withColumn("before", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def average_precision_11(rows: DataFrame) -> DataFrame:
    """One row ap: mean over recalls 0, 0.1 .. 1 of the best precision at that recall or more; scores are distinct."""
    pos = rows.withColumns({"tp": (F.col("gold") == 1).cast("long"), "all": F.lit(1), "down": -F.col("score")})
    run = running_total(running_total(pos, "down", "tp").withColumnRenamed("before", "tp_before"), "down", "all")
    total = rows.agg(F.count_if(F.col("gold") == 1).alias("p"))
    curve = run.crossJoin(F.broadcast(total)).select(((F.col("tp_before") + F.col("tp")) / (F.col("before") + 1)).alias("precision"), F.try_divide(F.col("tp_before") + F.col("tp"), F.col("p")).alias("recall"))
    best = curve.agg(*(F.coalesce(F.max(F.when(F.col("recall") >= k / 10 - 1e-12, F.col("precision"))), F.lit(0.0)).alias(f"p{k}") for k in range(11)))
    return best.select((sum((F.col(f"p{k}") for k in range(11)), F.lit(0.0)) / 11).alias("ap"))


def wilson(p, n, z: float = 1.96):
    """Low and high end of the Wilson interval of a share p of n."""
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    keep = lambda c: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)
    return keep(low), keep(high)


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1): all thresholds in one pass over the rows."""
    counts = rows.agg(*(F.count_if((F.col("score") >= t) & (F.col("gold") == 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)), *(F.count_if((F.col("score") >= t) & (F.col("gold") == 0)).alias(f"fp{i}") for i, t in enumerate(thresholds)), F.count_if(F.col("gold") == 1).alias("p"))
    flat = counts.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)))))
    return precision_recall(flat, "threshold")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, p): the value at index round((n - 1) q) of each group in order, halves rounded to even.

    Equal values are counted first; their ends come from running counts, so no group is gathered into a row."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy(value)
    upto = counts.withColumns({"end": F.sum("c").over(w), "n": F.sum("c").over(W.partitionBy(*keys))})
    at = F.bround((F.col("n") - 1) * q)
    return upto.filter((F.col("end") > at) & (F.col("end") - F.col("c") <= at)).select(*keys, F.col(value).alias("p"))
