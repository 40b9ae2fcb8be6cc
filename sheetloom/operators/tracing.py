"""Ink regions, borders and strokes of raster images, and the faces that strokes bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs, raster, spatial, topology

#: Steps to the eight neighbours (row, column), clockwise from the one above.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
POINTS = "array<struct<x:double,y:double>>"


def labels(ink: np.ndarray) -> np.ndarray:
    """The first pixel, in reading order, of each ink pixel's 8-connected region; -1 on paper.

    Every pixel takes the least label around it, then the label of its label, until none changes."""
    far = ink.size
    own = np.where(ink, np.arange(far).reshape(ink.shape), far)
    while True:
        p = np.pad(own, 1, constant_values=far)
        least = np.minimum.reduce([p[1 + r : p.shape[0] - 1 + r, 1 + c : p.shape[1] - 1 + c] for r, c in (*STEPS, (0, 0))])
        new = np.where(ink, np.append(own.reshape(-1), far)[least], far)
        if (new == own).all():
            return np.where(ink, own, -1)
        own = new


def border(region: np.ndarray, r: int, c: int) -> list[tuple[int, int]]:
    """The outer border of region, clockwise from its first pixel in reading order; thin parts are passed on both sides."""
    inside = lambda q: 0 <= q[0] < region.shape[0] and 0 <= q[1] < region.shape[1] and region[q]
    path, at, back, first = [(r, c)], (r, c), 6, None
    while True:
        for k in range(1, 9):
            way = (back + k) % 8
            to = (at[0] + STEPS[way][0], at[1] + STEPS[way][1])
            if inside(to):
                break
        else:
            return path
        if first is None:
            first = (at, to)
        elif (at, to) == first:
            return path[:-1]
        # The paper pixel looked at before lies beside the new one too.
        before = (at[0] + STEPS[way - 1][0], at[1] + STEPS[way - 1][1])
        back = STEPS.index((before[0] - to[0], before[1] - to[1]))
        at = to
        path.append(at)


def contours(images: DataFrame, width: int, limit: int, least: int = 1, dark: bool = False) -> DataFrame:
    """(image, contour, n, r0, c0, r1, c1, border): 8-connected regions of least pixels or more over limit (dark: under it).

    contour is the region's first pixel; border goes around the region from there, closed, as points x, y."""

    def work(a):
        own, out = labels(a < limit if dark else a > limit), []
        flat = own.reshape(-1)
        order = np.argsort(flat, kind="stable")
        names, starts, sizes = np.unique(flat[order], return_index=True, return_counts=True)
        for name, start, n in zip(names, starts, sizes, strict=True):
            if name < 0 or n < least:
                continue
            rows, cols = np.divmod(order[start : start + n], width)
            r0, c0, r1, c1 = (int(x) for x in (rows.min(), cols.min(), rows.max(), cols.max()))
            part = own[r0 : r1 + 1, c0 : c1 + 1] == name
            around = border(part, int(name) // width - r0, int(name) % width - c0)
            out.append({"contour": int(name), "n": int(n), "r0": r0, "c0": c0, "r1": r1, "c1": c1, "border": [{"x": float(c + c0), "y": float(r + r0)} for r, c in around]})
        return out

    found = raster.per_image(images, width, work, "found", f"array<struct<contour:int,n:int,r0:int,c0:int,r1:int,c1:int,border:{POINTS}>>")
    return found.select("image", F.inline("found"))


def links(skeleton: np.ndarray) -> np.ndarray:
    """For each of the eight steps, where a skeleton pixel is joined with the next: diagonally only where no straight way goes."""
    ink = skeleton > 0
    ring = [x > 0 for x in raster._ring(ink.astype(int))]
    return np.array([ink & x & ~(ring[k - 1] | ring[(k + 1) % 8] if k % 2 else np.zeros_like(ink)) for k, x in enumerate(ring)])


def centroids(a: np.ndarray, reach: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """x and y of every pixel moved to the mean of the places around it, weighed by their values; unmoved where all are 0."""
    side = 2 * reach + 1
    w = np.lib.stride_tricks.sliding_window_view(np.pad(a.astype(float), reach), (side, side))
    step = np.arange(-reach, reach + 1)
    total = np.maximum(w.sum(axis=(2, 3)), 1e-300)
    rows, cols = np.indices(a.shape)
    return cols + (w * step).sum(axis=(2, 3)) / total, rows + (w * step[:, None]).sum(axis=(2, 3)) / total


def trace(skeleton: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(closed, pixels) of all strokes: runs of pixels with two links, with the nodes (ends, branch points) that they join.

    Every pixel with two links is on exactly one stroke, once, and every link too; a ring without a node
    begins and ends at its first pixel. Pixels without a link are no stroke."""
    link = links(skeleton)
    degree = link.sum(axis=0)
    ways = {(int(r), int(c)): np.flatnonzero(link[:, r, c]).tolist() for r, c in zip(*np.nonzero(degree), strict=True)}
    used, out = set(), []

    def walk(at, way):
        path = [at]
        while True:
            used.add((at, way))
            at = (at[0] + STEPS[way][0], at[1] + STEPS[way][1])
            used.add((at, (way + 4) % 8))
            path.append(at)
            if len(ways[at]) != 2 or at == path[0]:
                return path
            way = next(w for w in ways[at] if w != (way + 4) % 8)

    nodes = [p for p in ways if len(ways[p]) != 2]
    for start in (nodes, ways):
        for p in start:
            for w in ways[p]:
                if (p, w) not in used:
                    path = walk(p, w)
                    out.append((path[0] == path[-1], path))
    return out


def strokes(skeletons: DataFrame, width: int, refined: bool = False) -> DataFrame:
    """(image, stroke, closed, n, length, points) of skeleton images: n pixels between the ends, points x, y from end to end.

    refined moves points that are no ends to the weighed mean of the pixels around them."""

    def work(a):
        out = []
        x, y = centroids(a) if refined else np.indices(a.shape)[::-1]
        for k, (closed, path) in enumerate(trace(a)):
            inner = [(float(x[q]), float(y[q])) for q in path[1:-1]]
            p = [(float(path[0][1]), float(path[0][0])), *inner, (float(path[-1][1]), float(path[-1][0]))]
            length = sum(float(np.hypot(q[0] - b[0], q[1] - b[1])) for q, b in zip(p, p[1:], strict=False))
            out.append({"stroke": k, "closed": closed, "n": len(inner), "length": length, "points": [{"x": q[0], "y": q[1]} for q in p]})
        return out

    found = raster.per_image(skeletons, width, work, "found", f"array<struct<stroke:int,closed:boolean,n:int,length:double,points:{POINTS}>>")
    return found.select("image", F.inline("found"))


def refined_points(images: DataFrame, points: DataFrame, width: int, reach: int = 2) -> DataFrame:
    """(image, r, c, x, y): points (image, r, c) moved to the weighed mean of the pixels within reach."""
    joined = images.join(points.groupBy("image").agg(F.collect_list(F.struct("r", "c")).alias("p")), "image")
    ident = images.schema["image"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for image, grey, own in zip(pdf["image"], pdf["grey"], pdf["p"], strict=True):
                x, y = centroids(np.asarray(grey).reshape(-1, width), reach)
                rows += [(image, q["r"], q["c"], float(x[q["r"], q["c"]]), float(y[q["r"], q["c"]])) for q in own]
            yield pd.DataFrame(rows, columns=["image", "r", "c", "x", "y"])

    return joined.mapInPandas(run, f"image {ident}, r int, c int, x double, y double")


#: Images lie this far apart on the grid on which their points and boxes meet.
APART = 100_000.0


def _moved(x: Column) -> Column:
    return x + F.pmod(F.xxhash64("image"), F.lit(1 << 20)) * APART


def snapped_strokes(strokes: DataFrame, tol: float | None = None) -> DataFrame:
    """strokes with u, v, the vertices of their ends, and points from vertex to vertex.

    Ends that are joined by steps shorter than tol are one vertex, at their mean; tol None takes a fiftieth of an image's mean
    stroke length, between 1 and 5. A stroke that lies within twice tol of its only vertex goes."""
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    strokes = graphs.written(strokes)
    s = strokes.select("image", "stroke", "points", F.struct("image", first["x"].alias("x"), first["y"].alias("y")).alias("from"), F.struct("image", last["x"].alias("x"), last["y"].alias("y")).alias("to"))
    if tol is None:
        tols = strokes.groupBy("image").agg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.avg("length") / 50)).alias("tol"))
    else:
        tols = strokes.select("image").distinct().withColumn("tol", F.lit(float(tol)))
    places = s.select(F.explode(F.array("from", "to")).alias("id")).distinct().select("id", F.col("id.image").alias("image"), F.col("id.x").alias("px"), F.col("id.y").alias("py"))
    places = graphs.written(places)
    pairs = spatial.near_pairs(places.select("id", _moved(F.col("px")).alias("x"), F.col("py").alias("y")), 5.0 if tol is None else max(float(tol), 0.5))
    pairs = pairs.filter("a.image = b.image").withColumn("image", F.col("a.image")).join(tols, "image").filter("d < tol").select("a", "b")
    comps = graphs.components(pairs)
    named = places.join(comps, F.col("id") == F.col("node"), "left").select("id", "px", "py", F.coalesce("component", "id").alias("vertex"))
    means = named.groupBy("vertex").agg(F.avg("px").alias("x"), F.avg("py").alias("y"))
    at = graphs.written(named.join(means, "vertex").select("id", F.struct("vertex", "x", "y").alias("at")))
    j = s.join(at.select(F.col("id").alias("from"), F.col("at").alias("a")), "from").join(at.select(F.col("id").alias("to"), F.col("at").alias("b")), "to").join(tols, "image")
    end = lambda c: F.array(F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")))
    j = j.withColumn("points", F.concat(end("a"), F.slice("points", 2, F.greatest(F.size("points") - 2, F.lit(0))), end("b")))
    near = F.forall("points", lambda p: F.hypot(p["x"] - F.col("a.x"), p["y"] - F.col("a.y")) <= 2 * F.col("tol"))
    gone = (F.col("a.vertex") == F.col("b.vertex")) & near & (F.col("tol") > 0)
    return j.filter(~gone).select("image", "stroke", F.col("a.vertex").alias("u"), F.col("b.vertex").alias("v"), "tol", "points")


def stroke_half_edges(snapped: DataFrame) -> DataFrame:
    """(image, h, twin, next, u, v, points, part): both ways of each stroke; part is twice its share of a face's area.

    Around a vertex strokes are ordered by where they lead to beyond tol; several strokes may join the same two vertices."""
    name = lambda sign: F.concat(F.col("image").cast("string"), F.lit("/"), F.col("stroke").cast("string"), F.lit(sign))
    forth = snapped.select("image", name("+").alias("h"), name("-").alias("twin"), "u", "v", "tol", "points")
    back = snapped.select("image", name("-").alias("h"), name("+").alias("twin"), F.col("v").alias("u"), F.col("u").alias("v"), "tol", F.reverse("points").alias("points"))
    start = F.element_at("points", 1)
    far = F.filter("points", lambda p: F.hypot(p["x"] - start["x"], p["y"] - start["y"]) > F.col("tol"))
    lead = F.coalesce(F.try_element_at(far, F.lit(1)), F.element_at("points", 2))
    nxt = F.slice("points", 2, F.size("points") - 1)
    part = F.aggregate(F.zip_with(F.slice("points", 1, F.size("points") - 1), nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)
    ways = forth.union(back).withColumns({"angle": F.atan2(lead["y"] - start["y"], lead["x"] - start["x"]), "part": part}).drop("tol")
    w = W.partitionBy("u").orderBy("angle", "h")
    last = F.last("h").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ways = ways.withColumn("clockwise", F.coalesce(F.lag("h").over(w), last))
    return ways.drop("clockwise", "angle").join(ways.select(F.col("twin").alias("h"), F.col("clockwise").alias("next")), "h")


def stroke_faces(strokes: DataFrame, tol: float | None = None, least_edges: int = 3) -> DataFrame:
    """(image, face, role, edges, area, part, parent, level, points) of the faces that the strokes of each image bound.

    Strokes are joined at snapped ends; a face is a cycle of half-edges. Each connected part of an image has inner faces, of
    positive area, and one outer boundary. parent is the smallest face of another part that holds the part, level the
    number of them. A face's points, bounded by its image, are one row. Faces of fewer than least_edges strokes are
    left out at the end."""
    half = graphs.written(stroke_half_edges(graphs.written(snapped_strokes(strokes, tol))))
    order = topology.along(half)
    line = F.slice("points", 1, F.size("points") - 1)
    rows = half.join(order, "h").groupBy("face").agg(F.first("image").alias("image"), F.min("u").alias("u"), F.count("*").alias("edges"), (F.sum("part") / 2).alias("area"), F.array_sort(F.collect_list(F.struct("k", line.alias("points")))).alias("p"))
    comps = graphs.components(half.select("u", "v"))
    rows = rows.join(comps, F.col("u") == F.col("node"), "left").select("face", "image", F.coalesce("component", "u").alias("part"), "edges", "area", F.flatten(F.transform("p", lambda q: q["points"])).alias("points"))
    rows = graphs.written(rows)
    start = rows.groupBy("image", "part").agg(F.min_by(F.element_at("points", 1), "face").alias("s"))
    starts = start.select("image", "part", F.col("s.x").alias("x"), F.col("s.y").alias("y"), _moved(F.col("s.x")).alias("x0"), F.col("s.y").alias("y0"), _moved(F.col("s.x")).alias("x1"), F.col("s.y").alias("y1"))
    rings = graphs.with_box(rows.filter("area > 0").select("image", "part", "face", "area", "points")).withColumns({"x0": _moved(F.col("x0")), "x1": _moved(F.col("x1"))})
    met = spatial.overlap_pairs(starts, rings).filter("image = r_image and part <> r_part").filter(g.point_in_ring(F.col("x"), F.col("y"), F.col("r_points")))
    above = met.groupBy("part").agg(F.min(F.struct("r_area", "r_face")).alias("m"), F.count("*").alias("level"))
    out = rows.join(above, "part", "left").filter(F.col("edges") >= least_edges)
    role = F.when(F.col("area") > 0, "inner").otherwise("outer")
    return out.select("image", "face", role.alias("role"), "edges", "area", F.col("part").alias("part"), F.col("m.r_face").alias("parent"), F.coalesce("level", F.lit(0)).alias("level"), "points")
