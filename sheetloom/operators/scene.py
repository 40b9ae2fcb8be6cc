"""Scene graphs: routing, fusion, constraints and repair, clusters, relation suppression, rooms and labels, tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs, spatial
from .selection import suppress, top_k

#: Labels of openings, rooms and boundaries, and the relations that each kind needs one of.
OPENING_LABELS = ["door", "window", "opening"]
ROOM_LABELS = ["room", "space", "corridor", "balcony"]
BOUNDARY_LABELS = ["wall", "hard_wall", "partition_wall"]
NEEDS = [
    ("opening_without_wall_relation", "opening", ["attached_to", "interrupted_by", "touches"]),
    ("room_without_boundary_relation", "room", ["bounded_by", "bounds", "contains", "inside"]),
    ("dimension_text_without_link", "dimension", ["labels", "dimension_of", "attached_to"]),
]
BOX = ("x0", "y0", "x1", "y1")


def _box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def exploded(records: DataFrame, arrays: list[str], key: str) -> DataFrame:
    """(key, source, item) for each entry of several nested arrays of one element type; empty arrays give no row."""
    out = None
    for a in arrays:
        part = records.select(key, F.lit(a).alias("source"), F.explode(a).alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def fuse(predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings of predictions (page, id, label, family, confidence, relations): a node each, the relations
    as edges, and warnings of ids that come twice and of broken constraints."""
    nodes = predictions.drop("relations")
    edges = predictions.select("page", F.inline("relations"))
    twice = predictions.groupBy("page", "id").count().filter("count > 1").select("page", F.lit("duplicate_candidate_id").alias("warning"), "id")
    return nodes, edges, twice.union(constraint_warnings(nodes, edges)).distinct()


def _kind(label: Column, family: Column) -> Column:
    return F.when(label.isin(OPENING_LABELS), "opening").when(label.isin(ROOM_LABELS), "room").when((family == "text") & (label == "dimension_text"), "dimension")


def constraint_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, warning, id): openings without a wall, rooms without a boundary, dimension texts without a link, and pages whose
    interrupted_by runs neither from a boundary nor to an opening (id null)."""
    ends = edges.select("page", F.explode(F.array("source", "target")).alias("id"), "relation").distinct()
    kind = nodes.withColumn("kind", _kind(F.col("label"), F.col("family")))
    out = None
    for name, own, needed in NEEDS:
        lone = kind.filter(F.col("kind") == own).join(ends.filter(F.col("relation").isin(needed)).select("page", "id"), ["page", "id"], "left_anti")
        part = lone.select("page", F.lit(name).alias("warning"), "id")
        out = part if out is None else out.union(part)
    end = lambda s: nodes.select("page", F.col("id").alias(s), F.col("label").alias(f"{s}_label"))
    cut = edges.filter("relation = 'interrupted_by'").join(end("source"), ["page", "source"], "left").join(end("target"), ["page", "target"], "left")
    bad = cut.filter(~F.coalesce(F.col("source_label").isin(BOUNDARY_LABELS), F.lit(False)) & ~F.coalesce(F.col("target_label").isin(OPENING_LABELS), F.lit(False)))
    none = F.lit(None).cast(nodes.schema["id"].dataType)
    return out.union(bad.select("page", F.lit("invalid_interrupted_by_relation"), none)).distinct()


def repairs(nodes: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(page, source, target, relation): for each node of a broken constraint the nearest node within reach that mends it: an
    opening is attached to a boundary, a room is bounded by one, a dimension text is the dimension of a line."""
    lone = constraint_warnings(nodes, edges).filter("id is not null").join(nodes, ["page", "id"])
    out = None
    for name, relation, fit in ((NEEDS[0][0], "attached_to", F.col("family") == "boundary"), (NEEDS[1][0], "bounded_by", F.col("family") == "boundary"), (NEEDS[2][0], "dimension_of", F.col("label") == "dimension_line")):
        pairs = spatial.overlap_pairs(lone.filter(F.col("warning") == name).select("page", "id", *BOX), nodes.filter(fit).select("page", "id", *BOX), pad=reach).filter("page = r_page and id <> r_id")
        gap = g.box_gap(_box(), _box("r_"))
        best = pairs.filter(gap <= reach).groupBy("page", "id").agg(F.min(F.struct(gap.alias("d"), "r_id")).alias("m"))
        part = best.select("page", F.col("id").alias("source"), F.col("m.r_id").alias("target"), F.lit(relation).alias("relation"))
        out = part if out is None else out.union(part)
    return out


def clusters(candidates: DataFrame, limit: float = 0.5) -> DataFrame:
    """(page, id, cluster): greedy clusters of each page and family: by confidence, then area and id, a candidate joins the
    representative that it overlaps by more than limit, the best by overlap and nearness, or becomes one.

    Representatives are what suppression keeps; members then meet them on the grid."""
    own = candidates.withColumns({"area": g.box_area(*_box()), "score": F.col("confidence")})
    kept = graphs.written(suppress(own, ["page", "family"], limit).select("page", "family", "id", "confidence", *BOX))
    pairs = spatial.overlap_pairs(own.select("page", "family", "id", "confidence", *BOX), kept).filter("page = r_page and family = r_family and (r_confidence > confidence or (r_confidence = confidence and r_id <= id))")
    (ax, ay), (bx, by) = g.centre(_box()), g.centre(_box("r_"))
    worth = g.iou(_box(), _box("r_")) + 1 / F.greatest(g.distance(ax, ay, bx, by), F.lit(1.0))
    near = pairs.filter((F.col("id") == F.col("r_id")) | (g.iou(_box(), _box("r_")) > limit))
    best = near.groupBy("page", "family", "id").agg(F.max(F.struct((F.col("id") == F.col("r_id")).alias("self"), worth.alias("w"), (-F.col("r_id")).alias("r"))).alias("m"))
    return best.select("page", "id", (-F.col("m.r")).alias("cluster"))


def cluster_overflow(members: DataFrame, most: int = 40) -> DataFrame:
    """(page, cluster, n) of clusters with so many members or more."""
    return members.groupBy("page", "cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def relation_suppression(relations: DataFrame, members: DataFrame, caps: dict[str, int], default_cap: int) -> DataFrame:
    """Of relations (page, relation, source, target, score) between the same two clusters the one of best score, with the number
    of those it stands for; then the best of each relation on a page up to its cap."""
    m = lambda s: members.select("page", F.col("id").alias(s), F.col("cluster").alias(f"{s}_cluster"))
    named = relations.join(m("source"), ["page", "source"], "left").join(m("target"), ["page", "target"], "left")
    named = named.withColumns({"source_cluster": F.coalesce("source_cluster", "source"), "target_cluster": F.coalesce("target_cluster", "target")})
    keys = ["page", "relation", "source_cluster", "target_cluster"]
    best = named.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("source")).alias("s"), (-F.col("target")).alias("t"))).alias("m"), F.count("*").alias("n"))
    one = best.select(*keys, (-F.col("m.s")).alias("source"), (-F.col("m.t")).alias("target"), "m.score", "n")
    cap = F.coalesce(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("relation")], F.lit(default_cap)) if caps else F.lit(default_cap)
    place = F.row_number().over(W.partitionBy("page", "relation").orderBy(F.desc("score"), "source", "target"))
    return one.withColumn("place", place).filter(F.col("place") <= cap).drop("place")


def contained(rooms: DataFrame, targets: DataFrame, cap: int, margin: float = 2.0) -> DataFrame:
    """(page, room, target, score): targets whose centre a room holds, scored by nearness to its centre, both confidences and
    size, the cap best of each room."""
    cx, cy = g.centre(_box())
    point = targets.withColumns({"tx0": F.col("x0"), "ty0": F.col("y0"), "tx1": F.col("x1"), "ty1": F.col("y1"), "px": cx, "py": cy}).withColumns({"x0": F.col("px"), "y0": F.col("py"), "x1": F.col("px"), "y1": F.col("py")})
    p = spatial.overlap_pairs(rooms, point, pad=margin).filter("page = r_page")
    rx, ry = g.centre(_box())
    far = F.least(F.lit(1.0), g.distance(rx, ry, F.col("r_px"), F.col("r_py")) / F.greatest(g.distance(*_box()), F.lit(1e-9)))
    size = F.least(F.lit(1.0), 40.0 * g.box_area(*(F.col(f"r_t{c}") for c in BOX)) / F.greatest(g.box_area(*_box()), F.lit(1e-9)))
    score = 0.35 * (1 - far) + 0.25 * F.col("confidence") * F.col("r_confidence") + 0.25 * size + 0.15
    rows = p.select("page", F.col("id").alias("room"), F.col("r_id").alias("target"), score.alias("score"))
    return top_k(rows, ["page", "room"], [F.desc("score"), "target"], cap)


def adjacent_rooms(rooms: DataFrame, cap: int = 8) -> DataFrame:
    """(page, a, b, score): rooms side by side within 10 with a quarter of the shorter side in common, the cap best of each room
    from either end."""
    p = spatial.overlap_pairs(rooms, rooms, pad=10.0).filter("page = r_page and id < r_id")
    a, b = _box(), _box("r_")
    gap = lambda i: F.greatest(F.lit(0.0), F.greatest(a[i], b[i]) - F.least(a[i + 2], b[i + 2]))
    ratio = lambda i: g.overlap_1d(a[i], a[i + 2], b[i], b[i + 2]) / F.greatest(F.least(a[i + 2] - a[i], b[i + 2] - b[i]), F.lit(1e-9))
    q = p.withColumns({"hg": gap(0), "vg": gap(1), "xr": ratio(0), "yr": ratio(1)})
    apart = F.when(F.col("xr") == 0, F.col("hg")).when(F.col("yr") == 0, F.col("vg")).otherwise(F.least("hg", "vg"))
    support = F.greatest(F.when(F.col("hg") <= 8, F.col("xr")).otherwise(0.0), F.when(F.col("vg") <= 8, F.col("yr")).otherwise(0.0))
    score = 0.55 * support + 0.25 * F.greatest(F.lit(0.0), 1 - apart / 10.0) + 0.2 * F.col("confidence") * F.col("r_confidence")
    rows = graphs.written(q.filter((support >= 0.25) & (apart <= 10.0)).select("page", F.col("id").alias("a"), F.col("r_id").alias("b"), score.alias("score")))
    ends = rows.withColumn("room", F.explode(F.array("a", "b")))
    return top_k(ends, ["page", "room"], [F.desc("score"), "a", "b"], cap).select("page", "a", "b", "score").distinct()


def room_of_symbol(rooms: DataFrame, symbols: DataFrame, most: int = 1, least: float = 1.0) -> DataFrame:
    """(page, room, symbol): for each symbol the best rooms that hold its centre and at least so much of it: by that share,
    nearness of centres, larger room and id."""
    p = spatial.overlap_pairs(symbols, rooms).filter("page = r_page")
    ratio = g.containment(_box(), _box("r_"))
    (ax, ay), (bx, by) = g.centre(_box()), g.centre(_box("r_"))
    rows = p.filter(g.centre_covered(_box(), _box("r_"), 0.0) & (ratio >= least)).select("page", F.col("r_id").alias("room"), F.col("id").alias("symbol"), ratio.alias("ratio"), g.distance(ax, ay, bx, by).alias("d"), g.box_area(*_box("r_")).alias("area"))
    return top_k(rows, ["page", "symbol"], [F.desc("ratio"), "d", F.desc("area"), "room"], most).select("page", "room", "symbol")


def room_of_label(rooms: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """(page, label, room, method, d): for each label the room whose polygon (points, may be null) or box holds its centre, else
    the nearest within reach; of several the nearest, then the smallest. Labels without a room are left out."""
    p = spatial.overlap_pairs(labels, rooms, pad=reach).filter("page = r_page")
    x, y = g.centre(_box())
    gap = lambda i, c: F.greatest(F.lit(0.0), F.col(f"r_{BOX[i]}") - c, c - F.col(f"r_{BOX[i + 2]}"))
    d = F.sqrt(gap(0, x) * gap(0, x) + gap(1, y) * gap(1, y))
    ring = F.coalesce(g.point_in_ring(x, y, F.col("r_points")), F.lit(False))
    whole = g.box_within(_box(), _box("r_"))
    method = F.when(ring, "polygon").when((d == 0) & F.col("r_points").isNotNull(), "box_polygon_miss").when((d == 0) & whole, "box_whole").when(d == 0, "box_centre").when(d <= reach, "near")
    rows = p.select("page", F.col("id").alias("label"), F.col("r_id").alias("room"), method.alias("method"), F.when(ring, 0.0).otherwise(d).alias("d"), g.box_area(*_box("r_")).alias("area")).filter("method is not null")
    return top_k(rows, ["page", "label"], ["d", "area", "room"], 1).drop("area")


def texts_near_lines(texts: DataFrame, vertices: DataFrame, factor: float) -> DataFrame:
    """(page, text, lines): the polylines with a vertex (page, poly, x, y) within factor text heights of a text's centre."""
    x, y = g.centre(_box())
    far = factor * (F.col("y1") - F.col("y0"))
    reach = texts.select("page", "id", x.alias("cx"), y.alias("cy"), far.alias("far")).withColumns({"x0": F.col("cx") - F.col("far"), "y0": F.col("cy") - F.col("far"), "x1": F.col("cx") + F.col("far"), "y1": F.col("cy") + F.col("far")})
    v = vertices.select("page", "poly", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = spatial.overlap_pairs(reach, v).filter("page = r_page").filter(g.distance(F.col("cx"), F.col("cy"), F.col("r_x0"), F.col("r_y0")) <= F.col("far"))
    found = near.groupBy("page", "id").agg(F.array_sort(F.collect_set("r_poly")).alias("lines"))
    return texts.select("page", "id").join(found, ["page", "id"], "left").select("page", F.col("id").alias("text"), "lines")


def boundary_entities(boundaries: DataFrame, entities: DataFrame, tol: float = 5.0) -> DataFrame:
    """(id, entity): the first entity (id, x0 .. y1, in order of id) whose ends both lie within tol of a boundary's, either way
    round; null where none does."""
    pts = lambda df, side: df.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in BOX))
    tip = lambda df: df.select("id", F.col("x0").alias("px"), F.col("y0").alias("py"), *BOX)
    box = lambda df, pad: tip(df).withColumns({"ax0": F.col("x0"), "ay0": F.col("y0"), "ax1": F.col("x1"), "ay1": F.col("y1")}).withColumns({"x0": F.col("px") - pad, "y0": F.col("py") - pad, "x1": F.col("px") + pad, "y1": F.col("py") + pad})
    turned = entities.select("id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    p = spatial.overlap_pairs(box(boundaries, tol), box(entities.select("id", *BOX).union(turned), 0.0), 4 * tol)
    end = lambda a, b: g.distance(*(F.col(c) for c in (f"a{a}", f"a{b}", f"r_a{a}", f"r_a{b}"))) <= tol
    best = p.filter(end("x0", "y0") & end("x1", "y1")).groupBy("id").agg(F.min("r_id").alias("entity"))
    return boundaries.select("id").join(best, "id", "left")


def fused_streams(base: DataFrame, extra: DataFrame, least_score: float, areas: tuple[float, float], most_overlap: float, cap: int) -> DataFrame:
    """base and those of extra that reach least_score, have an area within areas and overlap no base box of the page by more
    than most_overlap, suppressed among themselves, the cap best of a page."""
    fit = extra.filter((F.col("score") >= least_score) & g.box_area(*_box()).between(*areas))
    hit = spatial.overlap_pairs(fit, base).filter("page = r_page").filter(g.iou(_box(), _box("r_")) > most_overlap).select("page", "id").distinct()
    new = suppress(fit.join(hit, ["page", "id"], "left_anti"), ["page"], most_overlap, cap=cap)
    return base.withColumn("side", F.lit("base")).unionByName(new.withColumn("side", F.lit("extra")))


def optimal_assignment(costs: DataFrame, group: list[str]) -> DataFrame:
    """costs (a, b, cost) of the pairs of least total cost within each group: as many pairs as the smaller side has, each row and
    column once; missing pairs cost more than any other. A group is one page's matrix, and bounded as that."""
    from_schema = costs.schema

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].unique(), pdf["b"].unique()
        a.sort()
        b.sort()
        big = float(np.abs(pdf["cost"]).sum()) + 1.0
        m = np.full((len(a), len(b)), big)
        m[np.searchsorted(a, pdf["a"]), np.searchsorted(b, pdf["b"])] = pdf["cost"]
        turned = m.shape[0] > m.shape[1]
        rows = _assign(m.T if turned else m)
        pairs = {(a[j], b[i]) if turned else (a[i], b[j]) for i, j in rows if (m.T if turned else m)[i, j] < big}
        return pdf[[p in pairs for p in zip(pdf["a"], pdf["b"], strict=True)]]

    return costs.groupBy(*group).applyInPandas(work, from_schema)


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Shortest augmenting paths with potentials; rows are no more than columns."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[col]:
            used[col] = True
            row = owner[col]
            open_ = np.flatnonzero(~used[1:]) + 1
            slack = cost[row - 1, open_ - 1] - u[row] - v[open_]
            better = slack < least[open_]
            least[open_[better]], way[open_[better]] = slack[better], col
            to = open_[least[open_].argmin()]
            step = least[to]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            col = to
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def centroid_clusters(boxes: DataFrame, reach: float) -> DataFrame:
    """(page, id, cluster): in order of id a box joins the first cluster whose running centre is within reach of its own.

    The rule depends on the order, so a page's boxes are one task's; pages are bounded."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xy = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        c = np.column_stack([(xy[:, 0] + xy[:, 2]) / 2, (xy[:, 1] + xy[:, 3]) / 2])
        sums, n, own = np.zeros((len(c), 2)), np.zeros(len(c)), []
        k = 0
        for p in c:
            near = np.flatnonzero(np.hypot(*(sums[:k] / n[:k, None] - p).T) <= reach) if k else []
            j = int(near[0]) if len(near) else k
            k = max(k, j + 1)
            sums[j] += p
            n[j] += 1
            own.append(j)
        return pd.DataFrame({"page": pdf["page"], "id": pdf["id"], "cluster": own})

    return boxes.groupBy("page").applyInPandas(work, "page long, id long, cluster long")


def overlap_clusters(boxes: DataFrame, limit: float = 0.25) -> DataFrame:
    """(page, id, cluster): in order of id a box joins the first earlier cluster box that it overlaps by limit, else begins one.

    The rule depends on the order, so a page's boxes are one task's; pages are bounded."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xy, heads, own = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), [], []
        for i, b in enumerate(xy):
            o = xy[heads]
            w = np.clip(np.minimum(b[2], o[:, 2]) - np.maximum(b[0], o[:, 0]), 0, None) * np.clip(np.minimum(b[3], o[:, 3]) - np.maximum(b[1], o[:, 1]), 0, None)
            area = (b[2] - b[0]) * (b[3] - b[1]) + (o[:, 2] - o[:, 0]) * (o[:, 3] - o[:, 1]) - w
            near = np.flatnonzero(w / np.maximum(area, 1e-9) >= limit)
            if not len(near):
                heads.append(i)
            own.append(int(near[0]) if len(near) else len(heads) - 1)
        return pd.DataFrame({"page": pdf["page"], "id": pdf["id"], "cluster": own})

    return boxes.groupBy("page").applyInPandas(work, "page long, id long, cluster long")


def identity_tracks(proposals: DataFrame, pairs: DataFrame, least: float = 0.55) -> DataFrame:
    """(id, track): proposals (id, win) of consecutive windows that are each other's best at least at least are one track.

    pairs has a, b and score, a in the window before b's."""
    from .selection import reciprocal

    good = reciprocal(pairs.filter(F.col("score") >= least))
    comps = graphs.components(good.select("a", "b"))
    return proposals.select("id").join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("track"))


def identity_similarity(embedding: Column, overlap: Column) -> Column:
    return 0.65 * embedding + 0.35 * overlap


def merged_tracks(proposals: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, score, items): score-weighted mean score of a track's proposals (id, score, items) and the union of their items."""
    j = proposals.join(tracks, "id")
    return j.groupBy("track").agg(F.try_divide(F.sum(F.col("score") * F.col("score")), F.sum("score")).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def item_owners(instances: DataFrame, weight: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Instances (id, label, score, items) with each item given to one of them, by score and weight times its log size, the smaller
    id on ties; emptied ones go. Second, the removals (id, item)."""
    flat = instances.select("id", "label", "score", F.size("items").alias("n"), F.explode("items").alias("item"))
    worth = F.round(F.col("score") + weight * F.log1p(F.col("n")), 9)
    owner = flat.groupBy("item").agg(F.max(F.struct(worth.alias("w"), (-F.col("id")).alias("i"))).alias("m")).select("item", (-F.col("m.i")).alias("id"))
    kept = flat.join(owner, ["item", "id"]).groupBy("id", "label", "score").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return kept, flat.join(owner, ["item", "id"], "left_anti").select("id", "item")
