"""Greedy selection: suppression, caps, budgets, one-to-one matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _iou(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda b: np.clip(b[..., 2] - b[..., 0], 0, None) * np.clip(b[..., 3] - b[..., 1], 0, None)
    return both / np.maximum(1e-9, area(box) + area(others) - both)


#: Rows of a group that one task takes at a time; larger groups are decided in rounds over the pairs that overlap.
MOST_ROWS = 4096


def suppress(boxes: DataFrame, group: list[str], limit: float = 0.5, inclusive: bool = False, cap: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Non-maximum suppression within each group: by score down, then id, a box stays if its overlap with all
    kept ones is at most limit (inclusive: below it); with cap the first cap of a group.

    Groups of up to most_rows boxes are each one task's. In larger ones a box stays once no better box that it
    overlaps is open, and puts out those it overlaps; rounds go on until none is open. Both give the same."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        xy, kept = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), []
        for i in range(len(pdf)):
            if cap is not None and len(kept) >= cap:
                break
            o = _iou(xy[i], xy[kept]) if kept else np.zeros(0)
            if not (o >= limit if inclusive else o > limit).any():
                kept.append(i)
        return pdf.iloc[kept]

    large = boxes.groupBy(*group).agg(F.count("*").alias("rows")).filter(F.col("rows") > most_rows).drop("rows")
    if large.isEmpty():
        return boxes.groupBy(*group).applyInPandas(work, boxes.schema)
    small = boxes.join(large, group, "left_anti").groupBy(*group).applyInPandas(work, boxes.schema)
    kept = _suppressed_in_rounds(boxes.join(large, group, "left_semi"), group, limit, inclusive)
    if cap is not None:
        kept = top_k(kept, group, [F.desc("score"), "id"], cap)
    return small.unionByName(kept)


def _suppressed_in_rounds(boxes: DataFrame, group: list[str], limit: float, inclusive: bool) -> DataFrame:
    from ..functions import geometry as g
    from . import graphs, spatial

    key = F.struct(*group, "id")
    own = boxes.select(key.alias("key"), F.struct(*group).alias("own"), "id", "score", "x0", "y0", "x1", "y1")
    o = g.iou([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    better = (F.col("score") > F.col("r_score")) | ((F.col("score") == F.col("r_score")) & (F.col("id") < F.col("r_id")))
    pairs = spatial.overlap_pairs(own, own).filter(F.col("own") == F.col("r_own")).filter(better & (o >= limit if inclusive else o > limit))
    pairs = graphs.written(pairs.select(F.col("key").alias("over"), F.col("r_key").alias("under")))
    open_, kept = graphs.written(own.select("key")), None
    while not open_.isEmpty():
        now = graphs.written(open_.join(pairs.select(F.col("under").alias("key")).distinct(), "key", "left_anti"))
        kept = now if kept is None else kept.union(now)
        gone = pairs.join(now, pairs["over"] == now["key"], "left_semi").select(F.col("under").alias("key")).union(now)
        open_ = graphs.written(open_.join(gone, "key", "left_anti"))
        left = pairs.join(open_, pairs["over"] == open_["key"], "left_semi")
        pairs = graphs.written(left.join(open_, left["under"] == open_["key"], "left_semi"))
    return boxes.join(kept, key == F.col("key"), "left_semi")


def suppress_and_fill(boxes: DataFrame, group: list[str], limit: float, cap: int) -> DataFrame:
    """What suppression keeps, up to cap of a group, then the best of the others up to cap, whatever they overlap."""
    first = suppress(boxes, group, limit, cap=cap).select(*group, "id").withColumn("first", F.lit(1))
    ranked = boxes.join(first, [*group, "id"], "left")
    return top_k(ranked, group, [F.desc_nulls_last("first"), F.desc("score"), "id"], cap).drop("first")


def top_k(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in a total order; each task keeps k of a group before the shuffle."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def budget(rows: DataFrame, group: str, per_group: int, per_label: int, total: int) -> DataFrame:
    """Caps per group and per label in it, by score; then groups by their score sum until total rows, skipping
    groups that do not fit. Groups come to the driver in portions of as many as rows are left, so total at most; those that no longer
    fit are left out before they are ordered, so there are per_group portions at most."""
    kept = top_k(top_k(rows, [group, "label"], [F.desc("score"), "id"], per_label), [group], [F.desc("score"), "id"], per_group)
    from . import graphs

    sums = graphs.written(kept.groupBy(group).agg(F.sum("score").alias("s"), F.count("*").alias("n")).filter(F.col(group).isNotNull()))
    left, chosen, after = total, [], None
    while left > 0:
        fit = sums.filter(F.col("n") <= left)
        if after is not None:
            fit = fit.filter((F.col("s") < after["s"]) | ((F.col("s") == after["s"]) & (F.col(group) > after[group])))
        portion = fit.orderBy(F.desc("s"), group).limit(left).collect()
        size = left
        for r in portion:
            if r["n"] <= left:
                chosen.append((r[group],))
                left -= r["n"]
        if len(portion) < size:
            break
        after = portion[-1]
    picked = kept.sparkSession.createDataFrame(chosen, kept.select(group).schema)
    return kept.join(F.broadcast(picked), group, "left_semi")


def match_one_to_one(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy matching of pairs (a, b, score) within groups: highest score first, then a and b, each side once.

    In each round the pairs that are the best of both their sides are taken, which greedy order would take too,
    and all other pairs of these sides go; so a group of any size is spread over its sides."""
    from . import graphs

    worth = F.struct("score", (-F.col("a")).alias("a_"), (-F.col("b")).alias("b_"))
    left, out = graphs.written(pairs.withColumn("worth", worth)), None
    while not left.isEmpty():
        best = lambda side: left.groupBy(*group, side).agg(F.max("worth").alias(f"top_{side}"))  # noqa: B023, E731
        taken = left.join(best("a"), [*group, "a"]).join(best("b"), [*group, "b"]).filter((F.col("worth") == F.col("top_a")) & (F.col("worth") == F.col("top_b")))
        taken = graphs.written(taken.select(*left.columns))
        out = taken if out is None else out.union(taken)
        left = left.join(taken.select(*group, "a"), [*group, "a"], "left_anti").join(taken.select(*group, "b"), [*group, "b"], "left_anti")
        left = graphs.written(left.select(*taken.columns))
    return (out if out is not None else left).select(*pairs.columns)


def best_match(pairs: DataFrame) -> DataFrame:
    """For each a the b of the highest positive score, the smaller b on ties."""
    return pairs.filter("score > 0").groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct("score", (-F.col("b")).alias("b"))).alias("m")).select("a", "m.b", "m.score")


def reciprocal(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best."""
    forth = best_match(pairs)
    back = best_match(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).select(F.col("a").alias("b"), F.col("b").alias("a"))
    return forth.join(back, ["a", "b"])


def merge_intervals(rows: DataFrame, group: list[str], gap) -> DataFrame:
    """(group, lo, hi, n): intervals lo..hi merged where one starts within gap of what precedes it."""
    w = W.partitionBy(*group).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__new", (reach.isNull() | (F.col("lo") > reach + gap)).cast("int"))
    island = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*group, "__i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("__i")


def assignments(rows: DataFrame, item: list[str], owner: str, least: float, owners: int, edges: int, overflow: int = 0) -> DataFrame:
    """rows (id, score, second) chosen for each item, with reason: of its best owners the best rows of each, then the best others.

    Rows under least are left out. An owner counts by its best row, by score and then second; at most owners of them keep at most
    edges rows each (assigned), and overflow more rows of the item are kept whoever owns them (overflow). Equal ones
    go by the smaller owner and id. An item's rows, its candidates, are one window."""
    order = [F.desc("score"), F.desc("second")]
    own = W.partitionBy(*item, owner).orderBy(*order, "id")
    first = F.first(F.struct("score", "second")).over(own)
    r = rows.filter(F.col("score") >= least).withColumns({"__row": F.row_number().over(own), "__best": first})
    r = r.withColumn("__owner", F.dense_rank().over(W.partitionBy(*item).orderBy(F.desc("__best"), owner)))
    r = r.withColumn("__in", (F.col("__owner") <= owners) & (F.col("__row") <= edges))
    r = r.withColumn("__rest", F.row_number().over(W.partitionBy(*item, "__in").orderBy(*order, "id")))
    reason = F.when(F.col("__in"), "assigned").when(F.col("__rest") <= overflow, "overflow")
    return r.withColumn("reason", reason).filter("reason is not null").select(*rows.columns, "reason")
