"""Operators on drawings: gaps, contours, hulls, fits, scene relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs, spatial
from .selection import top_k


def gap_candidates(segments: DataFrame, reach: float, angle: float | None = None) -> DataFrame:
    """(a, ea, b, eb, d): pairs of ends of different segments within reach; angle (cosine) keeps pairs whose
    segments run on in nearly one direction."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.sqrt(dx * dx + dy * dy)
    way = () if angle is None else ("ux", "uy")  # directions go with the ends, so pairs that do not run on are never moved
    rows = segments if angle is None else segments.filter(n > 0).withColumns({"ux": dx / n, "uy": dy / n})
    ends = spatial.endpoints(rows, way).withColumn("pid", F.col("id") * 2 + F.col("end"))
    p = spatial.near_pairs(ends.select(F.col("pid").alias("id"), "x", "y", *way), reach, strict=False, carry=way)
    if angle is not None:
        p = p.filter(F.abs(F.col("ux_a") * F.col("ux_b") + F.col("uy_a") * F.col("uy_b")) >= angle)
    return p.select(F.floor(F.col("a") / 2).alias("a"), (F.col("a") % 2).alias("ea"), F.floor(F.col("b") / 2).alias("b"), (F.col("b") % 2).alias("eb"), "d").filter("a <> b")


def fill_gaps(segments: DataFrame, reach: float, angle: float | None = None) -> DataFrame:
    """(a, ea, b, eb, d): the shortest connections that join components of touching segments until none is left within reach.

    In each round every component takes its nearest other one, by distance and then ids, which is a step of
    the least spanning forest; so it is the same as taking all pairs by distance and keeping those that join
    two components. Pairs that close a ring of shorter ones are left out where they are found, before any is written.
    angle (cosine) keeps pairs whose segments run on in nearly one direction."""
    order = ("d", "a", "ea", "b", "eb")
    links = graphs.written(graphs.least_forests(gap_candidates(segments, reach, angle).select(*order)))
    joins = graphs.written(graphs.least_forests(gap_candidates(segments, 1e-6).select("a", "b")))
    out = None
    while True:
        comps = graphs.components(joins)
        named = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))  # noqa: B023, E731
        open_ = links.join(named("a"), "a", "left").join(named("b"), "b", "left").withColumns({"c_a": F.coalesce("c_a", "a"), "c_b": F.coalesce("c_b", "b")}).filter("c_a <> c_b")
        open_ = graphs.written(open_.select(*order, "c_a", "c_b"))
        if open_.isEmpty():
            break
        one = F.struct(*order)
        best = open_.select(F.col("c_a").alias("c"), one.alias("l")).union(open_.select("c_b", one)).groupBy("c").agg(F.min("l").alias("l"))
        found = graphs.written(best.select("l.*").distinct())
        out = found if out is None else out.union(found)
        joins = joins.union(found.select("a", "b"))
        links = open_.select(*order)
    return (out if out is not None else links.limit(0)).select("a", "ea", "b", "eb", "d")


def vertex_turns(points: DataFrame, ring: str = "ring", order: str = "idx") -> DataFrame:
    """points of closed rings with the previous and next vertex, edge length, turn angle in degrees and curvature.

    The ends of a ring meet: its first row takes the last vertex before it, from one aggregate per ring."""
    w = W.partitionBy(ring).orderBy(order)
    ends = points.groupBy(ring).agg(F.min_by(F.struct("x", "y"), order).alias("f"), F.max_by(F.struct("x", "y"), order).alias("l"))
    p = points.withColumns({"before": F.lag(F.struct("x", "y")).over(w), "after": F.lead(F.struct("x", "y")).over(w)}).join(ends, ring)
    p = p.withColumns({"px": F.coalesce("before.x", "l.x"), "py": F.coalesce("before.y", "l.y"), "nx": F.coalesce("after.x", "f.x"), "ny": F.coalesce("after.y", "f.y")})
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    turn = F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    side = lambda x, y: F.sqrt(x * x + y * y)
    curve = F.try_divide(2 * (ax * by - ay * bx), side(ax, ay) * side(bx, by) * side(ax + bx, ay + by))
    return p.select(ring, order, "x", "y", side(bx, by).alias("length"), turn.alias("turn"), curve.alias("curvature"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull corners by the monotone chain."""
    pts = sorted(set(map(tuple, xy)))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, k, x, y): hull corners of each key's points. Tasks first reduce their own points to hulls, so a
    key of any size brings only few corners together."""
    kind = points.schema[key].dataType.simpleString()

    def partial(frames):
        for pdf in frames:
            for k, own in pdf.groupby(key, dropna=False):
                h = _hull(own[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({key: [k] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf):
        h = _hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(h), "k": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    small = points.select(key, "x", "y").filter("x is not null and y is not null").mapInPandas(partial, f"`{key}` {kind}, x double, y double")
    return small.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, k bigint, x double, y double")


def line_fits(points: DataFrame, key: str) -> DataFrame:
    """(key, slope, intercept, rms, n): least squares of y on x; null slope for vertical or single points."""
    s = points.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(e).alias(n) for n, e in (("mx", F.col("x")), ("my", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))))
    vx, cxy, vy = F.col("xx") - F.col("mx") ** 2, F.col("xy") - F.col("mx") * F.col("my"), F.col("yy") - F.col("my") ** 2
    slope = F.when(vx > 1e-12, cxy / vx)
    return s.select(key, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.sqrt(F.greatest(F.lit(0.0), vy - F.coalesce(slope, F.lit(0.0)) * cxy)).alias("rms"), "n")


def circle_fits(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, r): algebraic circle fit, from moments about each key's mean."""
    mean = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = points.join(mean, key).select(key, "mx", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"))
    u, v = F.col("u"), F.col("v")
    m = c.groupBy(key, "mx", "my").agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * u * u + u * v * v).alias("p"), F.sum(v * v * v + v * u * u).alias("q"), F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    a = F.try_divide(F.col("p") * F.col("vv") - F.col("q") * F.col("uv"), 2 * det)
    b = F.try_divide(F.col("q") * F.col("uu") - F.col("p") * F.col("uv"), 2 * det)
    return m.filter(F.abs(det) > 1e-9).select(key, (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))


def bounded_by(rooms: DataFrame, walls: DataFrame, gap: float, overlap: float, cap: int) -> DataFrame:
    """(room, wall, side, gap, ratio): walls along the nearest room side, the cap nearest for each room."""
    p = spatial.overlap_pairs(rooms, walls, 100.0, pad=gap)
    cx, cy = (F.col("r_x0") + F.col("r_x1")) / 2, (F.col("r_y0") + F.col("r_y1")) / 2
    sides = [("left", F.abs(cx - F.col("x0"))), ("right", F.abs(cx - F.col("x1"))), ("top", F.abs(cy - F.col("y0"))), ("bottom", F.abs(cy - F.col("y1")))]
    near = F.array_min(F.array(*(F.struct(d.alias("gap"), F.lit(i).alias("i"), F.lit(n).alias("side")) for i, (n, d) in enumerate(sides))))
    p = p.withColumn("near", near)
    along = F.when(F.col("near.i") < 2, g.interval_overlap_ratio(F.col("y0"), F.col("y1"), F.col("r_y0"), F.col("r_y1"))).otherwise(g.interval_overlap_ratio(F.col("x0"), F.col("x1"), F.col("r_x0"), F.col("r_x1")))
    rows = p.select(F.col("id").alias("room"), F.col("r_id").alias("wall"), "near.side", "near.gap", along.alias("ratio")).filter((F.col("gap") <= gap) & (F.col("ratio") >= overlap))
    return top_k(rows, ["room"], ["gap", F.desc("ratio"), "wall"], cap)


def recall_by_cover(gold: DataFrame, found: DataFrame, limit: float = 0.3) -> DataFrame:
    """gold boxes (id) that some found box of the page covers at the centre or overlaps by limit."""
    box, other = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    p = spatial.overlap_pairs(gold, found, 100.0, pad=2.0).filter("page = r_page")
    return p.filter(g.centre_covered(box, other) | (g.iou(box, other) >= limit)).select("id").distinct()


def multi_cap(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Rows of each page (page, id, score) taken by score, then id, while none of the counters in caps is full.

    A row is taken once fewer rows before it than the cap are taken or open in each of its counters, and goes once as many are
    taken in one; rounds go on until no row is open. A page's first open row is always decided. Counters are windows
    of running sums over page and value, so no page is held in one task's memory. Null values count as one value."""
    order = [F.desc("score"), F.asc("id")]
    state = graphs.written(rows.withColumns({"__taken": F.lit(False), "__open": F.lit(True)}))
    while not state.filter("__open").isEmpty():
        sure, full = F.col("__open"), F.lit(False)
        for c, cap in caps.items():
            before = W.partitionBy("page", c).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
            count = lambda test: F.coalesce(F.sum(test.cast("long")).over(before), F.lit(0))  # noqa: B023, E731
            sure, full = sure & (count(F.col("__taken") | F.col("__open")) < cap), full | (count(F.col("__taken")) >= cap)
        marked = state.withColumns({"__sure": sure, "__full": F.col("__open") & full})
        state = graphs.written(marked.filter("not __full").select(*rows.columns, F.expr("__taken or __sure").alias("__taken"), F.expr("__open and not __sure").alias("__open")))
    return state.select(*rows.columns)


#: Points of a stretch that one task thins at most; longer ones are cut in rounds first.
MOST_POINTS = 4096


def simplify(points: DataFrame, key: str, tol: float, most: int = MOST_POINTS) -> DataFrame:
    """points (key, idx, x, y) of open polylines thinned by greatest deviation, the first of equal ones.

    Stretches of over most points are cut at their greatest deviation in rounds, each a combined maximum over the stretch, or lose
    all inner points where it is within tol; shorter ones are thinned by a task each. So a polyline of any length is
    spread, with the same result. idx is unique in its polyline; rows with nulls go."""
    p = graphs.written(points.select(F.col(key).alias("k"), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().withColumn("lo", F.lit(0).cast(points.schema["idx"].dataType)))
    p = graphs.written(p.drop("lo").join(p.groupBy("k").agg(F.min("idx").alias("lo")), "k"))
    whole = None
    while True:
        ends = p.groupBy("k", "lo").agg(F.count("*").alias("n"), F.min(F.struct("idx", "x", "y")).alias("a"), F.max(F.struct("idx", "x", "y")).alias("b"))
        ends = graphs.written(ends)
        long_ = ends.filter(F.col("n") > most)
        if long_.isEmpty():
            break
        q = p.join(long_, ["k", "lo"])
        dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        n = F.sqrt(dx * dx + dy * dy)
        ox, oy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
        far = F.when(n > 0, F.abs(dx * oy - dy * ox) / n).otherwise(F.sqrt(ox * ox + oy * oy))
        inner = q.filter((F.col("idx") > F.col("a.idx")) & (F.col("idx") < F.col("b.idx")))
        cut = graphs.written(inner.groupBy("k", "lo").agg(F.max(F.struct(far.alias("far"), (-F.col("idx")).alias("back"))).alias("m")).select("k", "lo", (-F.col("m.back")).alias("cut"), (F.col("m.far") > tol).alias("split")))
        rest = p.join(long_.select("k", "lo"), ["k", "lo"], "left_anti")
        both = p.join(cut, ["k", "lo"]).join(long_.select("k", "lo", F.col("a.idx").alias("first"), F.col("b.idx").alias("last")), ["k", "lo"])
        flat = both.filter("not split and idx in (first, last)").select("k", "idx")
        whole = flat if whole is None else whole.union(flat)
        left = both.filter("split and idx <= cut").select("k", "idx", "x", "y", "lo")
        right = both.filter("split and idx >= cut").select("k", "idx", "x", "y", F.col("cut").alias("lo"))
        p = graphs.written(rest.select("k", "idx", "x", "y", "lo").union(left).union(right))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        at, keep, todo = pdf[["x", "y"]].to_numpy(float), np.zeros(len(pdf), bool), [(0, len(pdf) - 1)]
        keep[[0, -1]] = True
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = at[b] - at[a]
            n = np.hypot(*d)
            off = at[a + 1 : b] - at[a]
            far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n else np.hypot(off[:, 0], off[:, 1])
            k = int(far.argmax())
            if far[k] > tol:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[keep][["k", "idx"]]

    kept = p.groupBy("k", "lo").applyInPandas(work, p.select("k", "idx").schema)
    kept = (kept if whole is None else kept.union(whole)).distinct()
    return points.join(kept.select(F.col("k").alias(key), "idx"), [key, "idx"], "left_semi").select(*points.columns)


def nearest_any(points: DataFrame, others: DataFrame, key: str, cell: float, rounds: int = 40) -> DataFrame:
    """(key, i, d): the distance from each point (key, idx, x, y) to the nearest of others with its key.

    Cells double from round to round; only points that found none within the cell's width go on, so a point
    looks at the crowd around it and not at all others."""
    todo = graphs.written(points.select(F.col(key).alias("k"), F.col("idx").alias("i"), "x", "y").join(others.select(F.col(key).alias("k")).distinct(), "k", "left_semi"))
    right = graphs.written(others.select(F.col(key).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    out = None
    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    for _ in range(rounds):
        at = lambda c, size: F.floor(F.col(c) / size).cast("long")
        look = todo.select("k", "i", "x", "y", at("x", cell).alias("cx"), at("y", cell).alias("cy"), F.explode(steps).alias("s")).select("k", "i", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
        home = right.select("k", "x2", "y2", at("x2", cell).alias("cx"), at("y2", cell).alias("cy"))
        d = g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
        near = look.join(home, ["k", "cx", "cy"]).groupBy("k", "i").agg(F.min(d).alias("d")).filter(F.col("d") <= cell)
        near = graphs.written(near)
        out = near if out is None else out.union(near)
        todo = graphs.written(todo.join(near.select("k", "i"), ["k", "i"], "left_anti"))
        if todo.isEmpty():
            return out.select(F.col("k").alias(key), "i", "d")
        cell *= 4
    raise RuntimeError("points lie too far apart")


def chamfer(points: DataFrame, others: DataFrame, key: str, cell: float = 16.0) -> DataFrame:
    """(key, hausdorff, chamfer) of two point sets (key, idx, x, y) for each key, by nearest points on a grid both ways."""
    side = lambda p, q, s: nearest_any(p, q, key, cell).groupBy(key).agg(F.max("d").alias(f"max_{s}"), F.avg("d").alias(f"avg_{s}"))
    both = side(points, others, "i").join(side(others, points, "j"), key)
    return both.select(key, F.greatest("max_i", "max_j").alias("hausdorff"), (F.col("avg_i") + F.col("avg_j")).alias("chamfer"))


def scene_problems(nodes: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """(code, n): nodes of no label or broken box, edges with an unknown end, a loop or a relation not allowed."""
    bad = nodes.agg(F.count_if(F.col("label").isNull()).alias("no_label"), F.count_if((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))).alias("bad_box"))
    ids = nodes.select(F.col("id").alias("known")).distinct()
    src = edges.join(ids, F.col("source") == F.col("known"), "left").withColumnRenamed("known", "ks")
    both = src.join(ids, F.col("target") == F.col("known"), "left")
    e = both.agg(F.count_if(F.col("ks").isNull() | F.col("known").isNull()).alias("unknown_end"), F.count_if(F.expr("source = target")).alias("loop"), F.count_if(~F.col("relation").isin(relations)).alias("bad_relation"))
    flat = lambda df, names: df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("code"), F.col(n).alias("n")) for n in names))))
    return flat(bad, ["no_label", "bad_box"]).union(flat(e, ["unknown_end", "loop", "bad_relation"]))


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, tol: float) -> Column:
    """Points along an arc (degrees) whose chords stay within tol of it."""
    span = F.radians(F.when(end <= start, end + 360 - start).otherwise(end - start))
    step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - tol / F.greatest(r, F.lit(tol))))
    n = F.greatest(F.lit(1), F.ceil(span / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((cx + r * F.cos(F.radians(start) + span * k / n)).alias("x"), (cy + r * F.sin(F.radians(start) + span * k / n)).alias("y")))
